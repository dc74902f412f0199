"""Session settings the library depends on."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 1 << 20


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event-time slots are cut on UTC; pin the session to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> SparkSession:
    """Have Spark hand batches of at most so many bytes to Python; one row always goes whole.

    Spark counts rows, 10,000 to a batch, so that whole texts make batches of
    any size, several copies of which exist outside the heap at a time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables and stream checkpoints.

    It lies under the shared ``spark.checkpoint.dir``. Only a local session,
    whose executors live on this machine, may do without that setting; any
    other is refused, since its executors would not see a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master!r} share")
        base = tempfile.mkdtemp(prefix="flowguard-")
    return f"{base.rstrip('/')}/flowguard-{name}-{uuid.uuid4().hex}"


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table that Spark makes by itself.

    One that is made of an empty Python list is read by Python workers with a
    daemon of their own, which every executor then keeps in memory.
    """
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the scratch folder and read it back, cutting its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
