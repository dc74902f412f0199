"""A pipeline that turns raw documents into training sequences.

Every stage reads what the stage before it has written and keeps all columns
of ``documents``; the last returns the packed pieces. Each stage works on all
documents that reach it, and on nothing else. All set the size of the batches
that Spark hands to Python, which is counted in rows otherwise.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm import langid, linededup, neardup, packing, secrets
from flowguard.session import bound_batches, materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that labelled documents teach.

    Profiles are learned from all given documents with a language outside the
    held-out fold. Documents without text or letters go, and so do those that
    share no frequent n-gram with any profile. If no document is labelled,
    nothing can be judged and all documents stay.
    """
    bound_batches(spark)
    fold = langid.fold(F.col("doc_id"))
    profiles = langid.learn(docs.filter(fold != 1))
    return langid.keep_known(docs, profiles) if profiles else docs


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document or line has; n_chars follows."""
    bound_batches(spark)
    return linededup.drop_duplicate_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies."""
    bound_batches(spark)
    return neardup.drop_near_duplicates(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars follows."""
    bound_batches(spark)
    columns = docs.columns
    out = secrets.redact(docs)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").contains(secrets.MARK), F.length("text").cast("long"))
                             .otherwise(F.col("n_chars")))
    return out.select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of up to 4096 tokens."""
    bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near copies", near_copies),
    ("secrets", redacted),
    ("packing", packed),
]

# Language profiles, alignments and packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
