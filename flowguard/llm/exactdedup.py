"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. New data is reduced to one
row per digest, the known digests are removed by a sort-merge anti-join, which
reads the buckets as they lie, and the rest is appended.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import ascii_lower

BUCKETS = 32
# Groups with more than 1 / HOT_SHARE of all rows, at most so many, are joined by broadcast.
HOT_SHARE = 1000


def digest_of(text):
    """SHA-256 of the text with A-Z in lower case; NULL counts as empty."""
    return F.unhex(F.sha2(ascii_lower(text), 256))


class DigestIndex:
    """Digests seen so far: (digest, keep_id, group_size, batch)."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.path = path or scratch_path(spark, "digests")

    def _append(self, rows: DataFrame):
        rows.repartition(self.buckets, "digest").write.format("parquet").mode("append") \
            .option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def table(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            self._append(self.spark.createDataFrame([], "digest binary, keep_id long, group_size long, batch long"))
        return self.spark.table(self.name)

    def ingest(self, digests: DataFrame, batch: int = 0) -> DataFrame:
        """Append the digests of a table (id, digest) that are not there yet; returns all rows of the index.

        Of equal texts of one batch the largest id stays. A text that an
        earlier batch brought keeps that batch's id; its later copies are
        duplicates, and its group_size remains that of its first batch.
        """
        known = self.table()
        new = digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")) \
            .withColumn("batch", F.lit(batch).cast("long"))
        fresh = new.join(known.hint("merge"), "digest", "left_anti")
        # Written before it is appended to the table that it was compared with.
        self._append(materialise(fresh, "fresh"))
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: int = 0, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Which row of equal texts stays, decided through the index.

    Returns a row per row of ``docs``: ``id_col``, keep_id, group_size, kept
    and text_sha256. Texts are equal if they are identical with A-Z in lower
    case; NULL and empty texts are equal. The row with the largest id stays;
    rows that repeat that id are all marked as kept, and a group of NULL ids
    keeps NULL. Other columns are not read.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, f"flowguard_digests_{uuid.uuid4().hex}")
    digests = materialise(docs.select(F.col(id_col).cast("long").alias("id"), digest_of(F.col(text_col)).alias("digest")),
                          "digests")
    known = index.ingest(digests, batch).select("digest", "keep_id", "group_size")
    # Large groups, of which there are at most HOT_SHARE, never meet in one task.
    many = max(1, digests.count() // HOT_SHARE)
    hot = F.broadcast(known.filter(F.col("group_size") > many))
    digests_in = digests.join(hot, "digest", "left_anti").join(known.hint("merge"), "digest")
    both = digests.join(hot, "digest").unionByName(digests_in)
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size",
                       F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))
