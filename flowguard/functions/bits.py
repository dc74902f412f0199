"""Sets as bits that a scan tests by position: exact ones of small numbers, and Bloom filters of text keys."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ports and flag vectors: 65,536 bits, 8 KB at most.
NUMBERS = 1 << 16
_HALF = 1 << 15
_WORD = (1 << 64) - 1

# A Bloom filter has so many bits per key and sets four of them, all in one word: some 0.5 % of other keys pass.
# Beyond the largest size (16 MB; 2 MB in all for filters that are tested together, each of which the driver
# sends with several stages) more of them pass, and nothing else changes.
BLOOM_BITS = 16
BLOOM_WORDS = 1 << 21
BLOOM_SHARED = 1 << 18


def bitmaps(table: DataFrame, by: list[str], number: str) -> DataFrame:
    """One bitmap per group and half of the numbers: (by..., half, bits); at most 8 KB a group."""
    n = F.col(number).cast("bigint")
    return table.filter(n.between(0, NUMBERS - 1)).groupBy(*by, F.shiftright(n, 15).alias("half")) \
        .agg(F.bitmap_construct_agg(n % _HALF).alias("bits"))


def as_bits(half: int, bitmap: bytes) -> int:
    """A half of a bitmap as one whole number, in which bit n stands for the number n."""
    return int.from_bytes(bitmap, "little") << (half * _HALF)


def is_member(column: str, bits: int) -> Column:
    """Whether a column of numbers is in a set of bits; NULL for NULL and beyond the words of the set."""
    if not bits:
        return F.lit(False)
    first = ((bits & -bits).bit_length() - 1) // 64
    words, rest = [], bits >> (64 * first)
    while rest:
        word = rest & _WORD
        words.append(word - (1 << 64) if word >> 63 else word)
        rest >>= 64
    # One text, folded into an array before anything runs: a thousand literals would be a thousand nodes of the plan.
    text = ",".join(map(str, words))
    return F.expr(f"(shiftright(get(CAST(split('{text}', ',') AS ARRAY<BIGINT>), shiftright({column}, 6) - {first}), {column} & 63) & 1L) = 1L")


def bloom_words(keys: int, most: int = BLOOM_WORDS) -> int:
    """The size of a Bloom filter for so many keys: a power of two of 64-bit words, ``most`` of them at most."""
    words = 1
    while words * 64 < keys * BLOOM_BITS and words * 2 <= most:
        words *= 2
    return words


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a key and the bits it sets there."""
    h = F.xxhash64(key)
    one, mask = F.lit(1).cast("bigint"), None
    for by in (0, 6, 12, 18):
        bit = F.call_function("shiftleft", one, F.shiftrightunsigned(h, by).bitwiseAND(63).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.shiftrightunsigned(h, 40).bitwiseAND(words - 1).cast("int"), mask


def bloom_filter(table: DataFrame, key: str, words: int) -> DataFrame:
    """One row with the ``words`` of a Bloom filter over a column of keys, combined per task before the shuffle."""
    word, mask = _place(F.col(key), words)
    found = table.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    every = found.sparkSession.range(words).select(F.col("id").cast("int").alias("word"))
    listed = every.join(found, "word", "left").agg(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask"))).alias("l"))
    return listed.select(F.transform(F.array_sort("l"), lambda x: x["mask"]).alias("words"))


def might_be_in(key: Column, filter_words: Column, words: int) -> Column:
    """False only for keys that are not in the set; NULL for a NULL key.

    The key, which may be a long expression, stands in it twice, not once for each bit.
    """
    def place(k):
        word, mask = _place(k, words)
        return F.when(k.isNotNull(), F.struct(word.alias("word"), mask.alias("mask")))

    at = F.get(F.transform(F.array(key), place), F.lit(0))
    return F.bitwise_not(F.get(filter_words, at["word"])).bitwiseAND(at["mask"]) == 0
