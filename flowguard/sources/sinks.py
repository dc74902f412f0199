"""Sinks for reports, passed packets and evaluation rows."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVAL, PACKET_TYPES


def merge_reports(*reports: DataFrame) -> DataFrame:
    """One report table from those of several components."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    reports.write.mode(mode).partitionBy("report_type").parquet(path)


def write_by_proto(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write packets into a folder per type; unknown types are not written."""
    df.filter(F.col("proto").isin(*PACKET_TYPES)).write.mode(mode).partitionBy("proto").parquet(path)


def write_eval(rows: DataFrame, path: str) -> None:
    """Append evaluation rows as text lines ``run,component,number,kind``."""
    rows.select(*EVAL.fieldNames()).write.mode("append").csv(path)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL).csv(path)
