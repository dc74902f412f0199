"""Left joins of packets with rule-side tables, safe for large and hot keys."""

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import BLOOM_SHARED, BLOOM_WORDS, bloom_filter, bloom_words, might_be_in
from ..session import materialise

# A rule-side table is broadcast only when a count shows it has no more rows. Tables that
# are looked up together share this number, since the driver holds all of them at once.
BROADCAST_ROWS = 1_000_000

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are
# never more than HOT_SHARE hot keys.
HOT_SHARE = 1000
SALTS = 256
STREAM_SALTS = 32
# A table keyed by ids of rows is broadcast only up to this share of the bound.
SPREAD_SHARE = 8


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``rows`` rows; a count is combined per task."""
    return rows > 0 and table.count() <= rows


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if its counted size allows one."""
    return F.broadcast(table) if fits_broadcast(table, rows) else table


def null_safe_join(df: DataFrame, other: DataFrame, on: Iterable[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, where NULL meets NULL; the columns are those of ``df``."""
    on = list(on)
    other = other.withColumnsRenamed({c: f"_other_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in on]
    joined = df.join(other, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_other_{c}" for c in on))


@dataclass
class Lookup:
    """A table to be looked up by one text key.

    ``table`` has a column ``key`` and value columns. It holds at most one row
    per key (or, with the condition ``within``, at most one that satisfies it),
    so no packet multiplies; with more, a packet comes with each of them.
    ``rows`` is its size where it is already counted. With ``spread`` the keys
    are ids of rows, so that none is hot and the table grows as the rows do.
    """
    key: Column
    table: DataFrame
    within: Column | None = None
    rows: int | None = None
    spread: bool = False

    def counted(self) -> "Lookup":
        return self if self.rows is not None else replace(self, rows=self.table.count())


def look_up(df: DataFrame, lookups: Iterable[Lookup], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add the value columns of every table, NULL where a key is not found.

    Small tables are broadcast into the scan stage, the smallest ones first and
    no more than ``broadcast_rows`` of all tables. For a larger one a Bloom
    filter of its keys is tested in the scan first, and only packets that may
    have a match count from there on: the table is cut to their keys and
    broadcast if what is left of the bound allows it now. Beyond that those
    packets alone are shuffled, rows with a hot key spread over salts, and the
    few table rows of the hot keys repeated for each salt; all other packets go by.
    A table keyed by ids of rows is joined last and plainly: nothing of it comes
    to the driver, neither a filter of its keys nor hot ones.
    """
    lookups = [look.counted() for look in lookups]
    left, small = broadcast_rows, []
    for i in sorted(range(len(lookups)), key=lambda i: lookups[i].rows):
        if lookups[i].rows <= min(left, broadcast_rows // SPREAD_SHARE if lookups[i].spread else left):
            small.append(i)
            left -= lookups[i].rows
    by_id = [look for i, look in enumerate(lookups) if look.spread and i not in small]
    if by_id and not df.isStreaming:
        out = look_up(df, [look for i, look in enumerate(lookups) if i in small or not look.spread], broadcast_rows)
        for look in by_id:
            keyed = out.withColumn("_key", look.key)
            # Rows without a key would meet in one task.
            salt = F.when(F.col("_key").isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).otherwise(0)
            out = _left_join(keyed.withColumn("_salt", salt.cast("int")), look.table.withColumn("_table_salt", F.lit(0)),
                             F.col("_salt") == F.col("_table_salt"), look.within)
        return out
    large = [i for i in range(len(lookups)) if i not in small]
    tables = {i: F.broadcast(lookups[i].table) for i in small}
    if df.isStreaming:
        # A stream's future keys are unknown: every key is spread, over fewer salts.
        return _joined(df, lookups, tables, dict.fromkeys(large))
    shuffled, may = {}, {}
    if large:
        may = {i: _may_match(lookups[i], BLOOM_WORDS if len(large) == 1 else BLOOM_SHARED // len(large)) for i in large}
        # One pass over the packets, combined per key before its shuffle.
        counts = materialise(key_counts(df, {i: F.when(may[i], lookups[i].key) for i in large}), "keys")
        for i in large:
            occurring = counts.filter(F.col("i") == i).select("key")
            seen = lookups[i].table.join(occurring, "key", "left_semi")
            rows = seen.count() if left > 0 else None
            if rows is not None and rows <= left:
                tables[i] = F.broadcast(seen)
                left -= rows
            else:
                shuffled[i] = None
        if shuffled:
            shuffled = hot_keys(counts, list(shuffled))
    if not shuffled:
        return _joined(df, lookups, tables, {})
    possible = F.lit(False)
    for i in shuffled:
        possible = possible | F.coalesce(may[i], F.lit(False))
    nothing = {name: F.lit(None).cast(kind) for i in shuffled for name, kind in lookups[i].table.dtypes if name != "key"}
    passing = _joined(df.filter(~possible), [look for i, look in enumerate(lookups) if i not in shuffled],
                      dict(enumerate(tables[i] for i in range(len(lookups)) if i not in shuffled)), {}).withColumns(nothing)
    return _joined(df.filter(possible), lookups, tables, shuffled).unionByName(passing)


def _may_match(look: Lookup, most: int) -> Column:
    """Whether a packet's key passes a Bloom filter of the table's keys, which has ``most`` words at most."""
    words = bloom_words(look.rows, most)
    stored = materialise(bloom_filter(look.table.filter("key IS NOT NULL"), "key", words), "bloom")
    return might_be_in(look.key, stored.scalar(), words)


def _joined(df: DataFrame, lookups: list[Lookup], tables: dict[int, DataFrame], hot: dict) -> DataFrame:
    """Join all tables: those in ``tables`` as they are, those in ``hot`` with salts."""
    for i, look in enumerate(lookups):
        keyed, table = df.withColumn("_key", look.key), tables.get(i, look.table)
        if i in hot:
            salted, repeated = _salted(keyed, table, hot[i])
            df = _left_join(salted, repeated, F.col("_salt") == F.col("_table_salt"), look.within)
        else:
            df = _left_join(keyed, table, F.lit(True), look.within)
    return df


def key_counts(df: DataFrame, keys: dict[int, Column]) -> DataFrame:
    """Rows (i, key, n): how often each key of each lookup occurs, and how many rows have none (a NULL key)."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), key.alias("key")) for i, key in keys.items()])
    return df.select(F.explode(cells).alias("c")).groupBy("c.i", "c.key").agg(F.count("*").alias("n"))


def hot_keys(counts: DataFrame, lookups: list[int]) -> dict[int, DataFrame]:
    """Per lookup, the keys with more than 1/HOT_SHARE of all rows.

    A lookup has at most HOT_SHARE of them; they are read now and kept as small
    local tables.
    """
    total = counts.filter(F.col("i") == lookups[0]).select(F.sum("n")).scalar()
    found = counts.filter(F.col("i").isin(lookups) & F.col("key").isNotNull()
                          & (F.col("n") * HOT_SHARE > total)).select("i", "key").collect()
    spark = counts.sparkSession
    return {i: spark.createDataFrame([(key,) for j, key in found if j == i], "hot_key string") for i in lookups}


def _salted(df: DataFrame, table: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    salts = STREAM_SALTS if hot is None else SALTS
    # Taken from the whole row, so that a repeated task salts as before.
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is None:
        return df.withColumn("_salt", salt), table.withColumn("_table_salt", F.explode(every))
    is_hot = F.col("hot_key").isNotNull()
    hot = F.broadcast(hot)
    spread = F.when(is_hot | F.col("_key").isNull(), salt).otherwise(0)
    return (df.join(hot, F.col("_key") == F.col("hot_key"), "left")
            .withColumn("_salt", spread).drop("hot_key"),
            table.join(hot, F.col("key") == F.col("hot_key"), "left")
            .withColumn("_table_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
            .drop("hot_key"))


def _left_join(df: DataFrame, table: DataFrame, salted: Column, within: Column | None) -> DataFrame:
    table = table.withColumnRenamed("key", "_table_key")
    match = (F.col("_key") == F.col("_table_key")) & salted
    if within is not None:
        match = match & within
    return df.join(table, match, "left").drop("_key", "_table_key", "_salt", "_table_salt")
