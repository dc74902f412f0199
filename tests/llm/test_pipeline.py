"""The pipeline stage by stage, each against its own input."""

import re

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from edge import FOLDER, empty, odd, rows, with_clashes
from pyspark.sql import functions as F
from test_bpe_and_packing import check_packing
from test_near_duplicates import classes, without_copies
from test_text_operators import base_spans

from flowguard.llm import langid, queries
from flowguard.session import BATCH_BYTES, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage returns over the small documents, beginning with these; every ninth holds a secret."""
    planted = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("\nThe password = hunter2hunter2"), F.col("doc_id"))).otherwise(F.col("text"))
    made = [spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("text", planted).withColumn("n_chars", F.length("text").cast("long"))]
    for name, stage in corpus_pipeline.STAGES:
        made.append(materialise(stage(spark, made[-1], FOLDER), "stage"))
    return made


def test_batches_of_long_texts_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words "), 2000).alias("text"))
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(0).withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(0).cast("long")), FOLDER)
        assert docs.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0] < 2 * BATCH_BYTES


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near copies", "secrets", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert {re.match(r"op\d+_|pipeline", name)[0] for name in queries.queries()} \
        == {*(f"op{n}_" for n in range(1, 14)), "pipeline"}


def test_columns_stay(stages):
    for df in stages[:-1]:
        assert df.columns == COLUMNS
    assert stages[-1].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_language_keeps_documents_with_words(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert {i for i, r in before.items() if re.search(r"[^\W\d_]{2}", r.text)} <= set(after)
    assert all(after[i] == before[i] for i in after)


def test_lines_and_near_copies(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    assert {i: r.text for i, r in after.items()} == without_copies(sorted((i, r.text) for i, r in before.items()))
    kept = by_id(stages[3])
    assert set(kept) == set(classes([(i, r.text) for i, r in after.items()]).values())
    assert all(kept[i] == after[i] for i in kept)


def test_secrets_are_gone(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert set(before) == set(after)
    found = 0
    for i, r in after.items():
        spans = base_spans(before[i].text)
        found += bool(spans)
        assert not base_spans(r.text)
        assert spans or r == before[i]
        assert r.n_chars == len(r.text)
    assert found


def test_packing(stages):
    source = [(i, r.text) for i, r in by_id(stages[4]).items()]
    used, least = check_packing(rows(stages[5]), source, 4096, 64)
    assert used <= 1.05 * least + 1


def test_odd_and_empty_tables(spark):
    for df in (with_clashes(odd(spark)), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            columns, n = df.columns, df.count()
            df = materialise(stage(spark, df, FOLDER), "stage")
            assert df.count() <= n or name == "packing"
            if name != "packing":
                assert df.columns == columns


def test_unlabelled_documents_stay(spark):
    df = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, df, FOLDER).count() == df.count()
    assert langid.learn(df) == {}
