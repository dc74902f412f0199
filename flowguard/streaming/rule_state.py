"""Rule intervals as versioned state that new rows of a log advance.

A version says what holds after some row of the log: the rules and profiles
that are open at every place, and the intervals that ended since the version
before. A micro-batch reads the rows behind the last version only, puts the open
rules before them as if they were added anew, and writes the next version.
Versions carry the number of their batch, so a replayed batch writes its own again.
"""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from ..operators.rules import (LEVEL_PLACE, intervals_of, judged, judged_by_level, level_places, placed_changes,
                               profiles_of)
from ..operators.screening import drop_reports
from ..session import materialise
from .run import batches_of, per_batch, write_batch

RULE = ("kind", "direction", "value")


class RuleState:
    """Open and ended intervals of rules and profiles at some places, in a folder.

    The log is append-only in the order of ``seq``. What ended is kept for
    packets that come late; a batch reads of it what touches its own time.
    """

    def __init__(self, spark: SparkSession, path: str, places: DataFrame, by: Iterable[str] = ("node_id",)):
        self.spark, self.path, self.places, self.by = spark, path, places, list(by)

    def _version(self, before: int) -> int | None:
        """The last complete version of a batch before the given one; ``seen`` is written last."""
        return max((b for b in batches_of(self.spark, f"{self.path}/seen") if b < before), default=None)

    def _open(self, what: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{what}/batch={version}").filter("end IS NULL")

    def advance(self, read_log: Callable[[], DataFrame], batch_id: int) -> int:
        """Take in the rows that the log has gained; returns their number."""
        last = self._version(batch_id)
        log = read_log()
        if last is not None:
            seen = self.spark.read.parquet(f"{self.path}/seen/batch={last}").first()["seq"]
            log = log.filter(F.col("seq") > F.lit(seen))
        gained = materialise(log, "gained")
        rows, top = gained.agg(F.count("*"), F.max("seq")).first()
        if not rows:
            return 0
        changes = placed_changes(gained, self.places, self.by)
        rules, profiles = changes, changes
        if last is not None:
            # What is open is one change that lies before all new ones.
            rules = changes.unionByName(self._open("rules", last).select(
                *self.by, "seq", F.col("start").alias("ts"), F.lit("add").alias("op"), *RULE))
            profiles = changes.unionByName(self._open("profiles", last).select(
                *self.by, "seq", F.col("start").alias("ts"), F.lit("profile").alias("op"), F.lit(None).cast("string").alias("kind"),
                F.lit(None).cast("string").alias("direction"), F.col("profile").alias("value")))
        write_batch(intervals_of(rules, self.by), f"{self.path}/rules", batch_id)
        write_batch(profiles_of(profiles, self.by), f"{self.path}/profiles", batch_id)
        write_batch(self.spark.createDataFrame([(top,)], "seq long"), f"{self.path}/seen", batch_id)
        return rows

    def _during(self, what: str, columns: list[str], batch_id: int, low, high) -> DataFrame:
        """Intervals that hold at some time between two, under the version of a batch."""
        version = self._version(batch_id + 1)
        if version is None:
            none = self.places.select(*self.by, *(F.lit(None).cast("string").alias(c) for c in columns),
                                      *(F.lit(None).cast("timestamp").alias(c) for c in ("start", "end")))
            return none.limit(0)
        # An interval has its end in the version that saw it end; until then it is open in every version.
        ended = self.spark.read.parquet(f"{self.path}/{what}").filter((F.col("batch") <= version) & F.col("end").isNotNull())
        held = ended.unionByName(self._open(what, version).withColumn("batch", F.lit(version)))
        touches = (F.col("start") <= F.lit(high)) & (F.col("end").isNull() | (F.col("end") > F.lit(low)))
        return held.filter(touches).select(*self.by, *columns, "start", "end")

    def rules(self, batch_id: int, low, high) -> DataFrame:
        """Rule intervals for packets between two times: (by..., kind, direction, value, start, end)."""
        return self._during("rules", list(RULE), batch_id, low, high)

    def profiles(self, batch_id: int, low, high) -> DataFrame:
        """Profile intervals for packets between two times: (by..., profile, start, end)."""
        return self._during("profiles", ["profile"], batch_id, low, high)


def run_with_rule_log(packets: DataFrame, read_log: Callable[[], DataFrame],
                      nodes: DataFrame, path: str, checkpoint: str, levels: dict[int, str] | None = None,
                      reports_path: str | None = None, available_now: bool = False,
                      state_path: str | None = None) -> StreamingQuery:
    """Screen a stream while its rules and profiles change.

    Each micro-batch takes in what the rule log has gained and judges every
    packet by what was in force at the packet's own time: by one full profile
    (``verdict``), or by the given levels (``dropped_at``), with a report for
    each dropped packet if ``reports_path`` names a folder. The intervals are
    state in ``state_path`` (beside the checkpoint unless given), see ``RuleState``.
    """
    if reports_path is not None and levels is None:
        raise ValueError("reports need levels")
    places, by = (nodes, ["node_id"]) if levels is None else (level_places(nodes, levels), LEVEL_PLACE)
    state = RuleState(packets.sparkSession, state_path or f"{checkpoint.rstrip('/')}-rules", materialise(places, "places"), by)

    def step(batch: DataFrame, batch_id: int) -> None:
        state.advance(read_log, batch_id)
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            low, high = batch.agg(F.min("ts"), F.max("ts")).first()
            rules = state.rules(batch_id, low, high)
            out = judged(batch, rules) if levels is None else judged_by_level(batch, rules, state.profiles(batch_id, low, high), levels)
            write_batch(out, path, batch_id)
        finally:
            batch.unpersist()
        if reports_path is not None:
            screened = batch.sparkSession.read.parquet(f"{path}/batch={batch_id}")
            write_batch(drop_reports(screened.filter(F.col("dropped_at").isNotNull())), reports_path, batch_id)

    return per_batch(packets, step, checkpoint, available_now)
