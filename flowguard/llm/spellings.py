"""Groups spelling variants of words by asymmetric q-chunks.

Of two words that are one edit apart the longer (either, if they are as long)
contributes two disjoint chunks, its halves, and the other its positional
grams of their lengths. One edit touches one half only; the other half stands
in the other word, shifted by one place at most. Halves of short words are
shared by many words, so the half that the edit touches is cut into two chunks
once more: a word meets others under a half and one half of the rest. Where the
edit lies and how the lengths differ tell the place of each gram exactly.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import ascii_lower, broadcast_if_small

# Fixed values of the task: what a word is, and how often a run loses a character.
RUN = "[A-Za-zÀ-ÿ]+"
LOSES = 97
LEAST_CHARS, LEAST_COUNT, RATIO = 5, 3, 2
# The edit lies in one of so many parts of a word; all others are preserved.
PARTS = 4
ROUNDS = 60


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
          least_count: int = LEAST_COUNT) -> DataFrame:
    """The words of all texts and their occurrences: (word, n, size in code points).

    Words are runs of letters in lower case; a run loses one character where the
    hash of the document and the run says so.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(h % LOSES == 0, less).otherwise(F.col("run")).alias("word")) \
        .withColumn("size", F.length("word")).filter(F.col("size") >= least_chars) \
        .groupBy("word", "size").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count) \
        .select("word", "n", "size")


def _bounds(size: Column) -> list[Column]:
    """Where the four parts of a word of ``size`` begin and end: both halves, halved."""
    half = F.floor(size / 2).cast("int")
    return [F.lit(0), F.floor(half / 2).cast("int"), half, half + F.floor((size - half) / 2).cast("int"), size]


def _around(word: Column, start: Column, end: Column) -> Column:
    """The word without what lies between two places, with a mark there."""
    return F.concat(F.substring(word, F.lit(1), start), F.lit("|"), F.substring(word, end + 1, F.length(word)))


def _keys(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of the longer word of a pair and grams of the other, with (size, part, key) in common.

    A gram of a word that is shorter by one stands one place to the left if it
    follows the edit. ``part`` is the part in which the edit would lie.
    """
    def rows(size: Column, shift: int) -> list[Column]:
        at = _bounds(size)
        return [F.struct(size.alias("long"), F.lit(part).alias("part"),
                         _around(F.col("word"), at[part], at[part + 1] - shift).alias("key"), F.lit(shift).alias("shift"))
                for part in range(PARTS)]

    size = F.col("size")
    chunks = vocabulary.select("word", "n", F.explode(F.array(*rows(size, 0))).alias("k")).select("word", "n", "k.*")
    grams = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"),
                              F.explode(F.array(*rows(size, 0), *rows(size + 1, 1))).alias("k")) \
        .select("other", "other_n", "k.*")
    return chunks.drop("shift"), grams


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """All pairs of words that differ by one inserted, deleted or replaced code point, each in both orders.

    ``vocabulary`` is (word, n, size). Returns (word, n, other, other_n).
    """
    chunks, grams = _keys(vocabulary)
    met = chunks.join(grams, ["long", "part", "key"])
    # A replacement changes one part, so the words meet once. They may meet under several
    # parts if a character is deleted: the first of these counts.
    at = _bounds(F.col("long"))
    earlier = F.lit(False)
    for part in range(PARTS - 1):
        earlier = earlier | ((F.col("part") > part) & (_around(F.col("word"), at[part], at[part + 1])
                                                      == _around(F.col("other"), at[part], at[part + 1] - 1)))
    same_size = F.col("shift") == 0
    found = met.filter(F.when(same_size, F.col("word") < F.col("other")).otherwise(~earlier)) \
        .filter(F.levenshtein("word", "other", 1) == 1)
    both = F.array(F.struct("word", "n", "other", "other_n"),
                   F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
                            F.col("n").alias("other_n")))
    return found.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """Follow forms to the last: (word, root) for all rows (word, form) with a form.

    Pointers double their reach in each round, which is written; only pointers that still move are looked up.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    done = None
    for _ in range(ROUNDS):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(now.join(broadcast_if_small(step, 80), "root", "left")
                            .select("word", F.coalesce("next", "root").alias("root"),
                                    F.col("next").isNotNull().alias("moves")), "roots")
        now = moved.drop("moves")
        done = moved.filter("moves").limit(1).count() == 0
        if done:
            return now
    raise RuntimeError(f"forms did not end in {ROUNDS} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
             least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """Words of a corpus with the form that each is most likely a variant of.

    Returns word, form, root, n, n_near and form_n, a row per word. ``form`` is
    the near word with the most occurrences, ties going to the least in
    code-point order, if it has ``ratio`` times those of the word or more; else
    NULL. ``root`` is the last of a chain of forms. NULL and empty texts have no
    words, repeated rows count each, a NULL id is an empty one in the hash; texts
    may have any length; an empty table gives no rows. Other columns are not read.
    """
    vocabulary = materialise(words(docs, id_col, text_col, least_chars, least_count), "words")
    near = near_pairs(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("other_n").alias("most"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    judged = vocabulary.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("most") >= ratio * F.col("n"), F.lit(False)))
    judged = materialise(judged.select(
        "word", F.when(F.col("is_form"), F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("most")).alias("form_n")), "forms")
    ends = broadcast_if_small(materialise(roots(judged.filter("form IS NOT NULL")), "ends"), 80)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
