"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character 1- to 3-grams of a language by
rank. A document's own list is compared with each profile by the sum of the
distances by which its n-grams are out of place.
"""

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_worker

ORDERS = 3
PROFILE = 300
PART = 1024
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool,
                       sys.maxunicode + 1)


def grams(texts: list[str], is_letter: np.ndarray, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some texts as numbers, and the text that each belongs to.

    Words are runs of letters in lower case with a blank on both sides; no
    n-gram reaches beyond these blanks. A blank counts as code point 1, so
    that 21 bits a character tell all n-grams apart.
    """
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = is_letter[codes]
    kept = letter.copy()
    kept[0] = True
    # Of blanks in a row one stays, and each text begins and ends with its own.
    kept[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    code, owner, letter = np.where(letter, codes, 1)[kept].astype(np.int64), owner[kept], letter[kept]
    found, owners = [code[letter]], [owner[letter]]
    for n in range(2, orders + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        number = np.zeros(size, np.int64)
        for i in range(n):
            number = (number << 21) | code[i:size + i]
        whole = owner[:size] == owner[n - 1:]
        for i in range(1, n - 1):
            whole &= letter[i:size + i]
        if n == 2:
            # Two blanks stand next to each other in a text without letters.
            whole &= letter[:size] | letter[1:]
        found.append(number[whole])
        owners.append(owner[:size][whole])
    return np.concatenate(found), np.concatenate(owners)


def per_text(texts: list[str], is_letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-grams of each text and their counts; long texts are counted part by part."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= BLOCK_CHARS):
            chars += len(texts[end])
            end += 1
        if chars > BLOCK_CHARS:
            yield _long(texts[at], is_letter)
        else:
            number, owner = grams(texts[at:end], is_letter)
            order = np.argsort(owner, kind="stable")
            number = number[order]
            bounds = np.searchsorted(owner[order], np.arange(end - at + 1))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield np.unique(number[a:b], return_counts=True)
        at = end


def _long(text: str, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total: tuple | None = None
    at = 0
    while at < len(text):
        end = min(at + BLOCK_CHARS, len(text))
        # Not inside a word, unless it is as long as a block.
        while at < end < len(text) and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else min(at + BLOCK_CHARS, len(text))
        own = np.unique(grams([text[at:end]], is_letter)[0], return_counts=True)
        total = own if total is None else _summed(*(np.concatenate(p) for p in zip(total, own)))
        at = end
    return total


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, counts, len(keys)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, the smaller number first among equals."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
          size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language in ``docs``: its ``size`` most frequent n-grams in order.

    All n-grams of all given rows are counted. Rows without a language or text
    teach nothing. What reaches the driver is ``size`` numbers a language.
    """
    def count(batches):
        is_letter = per_worker("letters", letters)
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                parts, held = [], 0
                for own in per_blocks(texts, is_letter):
                    parts.append(own)
                    held += len(own[0])
                    if held > 1_000_000:
                        parts = [_summed(*(np.concatenate(p) for p in zip(*parts)))]
                        held = len(parts[0][0])
                keys, counts = _summed(*(np.concatenate(p) for p in zip(*parts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)],
                    names=["lang", "gram", "n"])

    labelled = docs.select(F.col(lang_col).cast("string"), F.col(text_col)) \
        .filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "rank", "gram").collect()):
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


def per_blocks(texts: list[str], is_letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of n-grams, block by block rather than text by text."""
    block, chars = [], 0
    for text in texts:
        if len(text) > BLOCK_CHARS:
            yield _long(text, is_letter)
            continue
        if chars + len(text) > BLOCK_CHARS:
            yield np.unique(grams(block, is_letter)[0], return_counts=True)
            block, chars = [], 0
        block.append(text)
        chars += len(text)
    yield np.unique(grams(block, is_letter)[0], return_counts=True) if block else (np.zeros(0, np.int64),) * 2


class Profiles:
    """Compares n-gram lists with the profiles of all languages at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted(profiles)
        self.known = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) \
            if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.known)), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.known, profiles[lang])] = np.arange(len(profiles[lang]))

    def best(self, own: np.ndarray) -> tuple[str, float]:
        """The closest language and 1 minus its distance, as a share of the largest possible.

        An n-gram that a profile does not have is out of place by the size of
        a profile. The first language by name wins a tie.
        """
        if not self.langs or not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        there = np.flatnonzero(self.known[at] == own)
        rank = self.ranks[:, at[there]]
        gained = np.where(rank >= 0, np.maximum(self.size - np.abs(rank - there[None, :]), 0), 0).sum(axis=1)
        best = int(np.argmax(gained))
        return self.langs[best], float(gained[best]) / (self.size * len(own))


def predictor(profiles: dict[str, list[int]], text_at: int):
    """A function that yields (batch, languages, scores) of Arrow batches."""
    def run(batches):
        is_letter = per_worker("letters", letters)
        known = Profiles(profiles)
        for whole in batches:
            # Few texts are held as Python values at a time.
            for at in range(0, len(whole), PART):
                batch = whole.slice(at, PART)
                texts = ["" if t is None else t for t in batch.column(text_at).to_pylist()]
                found = [known.best(ranked(*own)) for own in per_text(texts, is_letter)]
                yield batch, [f[0] for f in found], [f[1] for f in found]
    return run


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """The language of every text: ``id_col``, lang_pred and score (0 to 1).

    A text that is NULL or has no letter is ``und`` with score 0, and so is
    every text if no language was learned. Repeated rows are judged each; other
    columns are not read.
    """
    predicted = predictor(profiles, 1)

    def run(batches):
        for batch, langs, scores in predicted(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[id_col, "lang_pred", "score"])

    plain = docs.select(F.col(id_col), F.col(text_col))
    kind = plain.schema[id_col].dataType.simpleString()
    return plain.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text",
               least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in some learned language: neither ``und`` nor scored ``least`` or lower."""
    predicted = predictor(profiles, docs.columns.index(text_col))

    def run(batches):
        for batch, langs, scores in predicted(batches):
            yield batch.filter(pa.array([l != UNKNOWN and s > least for l, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(id_column):
    """The fold of a document: crc32 of its id as text, modulo 3; NULL for a NULL id."""
    return F.crc32(id_column.cast("string").cast("binary")) % 3
