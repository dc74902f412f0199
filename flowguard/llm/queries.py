"""Registered queries over the corpus tables, and their SQL where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dialogue, exactdedup, langid, licenses, linededup, neardup, packing, records, secrets, sharding, spellings, vectors
from .common import LOWER, UPPER

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(run):
    _QUERIES[run.__name__] = run
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_SQL["op8_exact_dedup"] = f"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents) x
    WINDOW same AS (PARTITION BY t)"""

# All pairs, and all vectors that links reach.
_SQL["op7_vector_near_dup"] = """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
      reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT id, b FROM reach JOIN links ON a = r)
    SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, min(r) AS component_id,
      min(r) = id AS kept
    FROM reach GROUP BY id"""


def _secrets_sql() -> str:
    """Matches and what lies between them, as lists; places are sums of lengths."""
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    rules = ", ".join(f"({i}, '{r.kind}', {quoted(r.pattern)}, {r.value}, {r.least}, {str(r.base).lower()})"
                      for i, r in enumerate(secrets.RULES))
    per_rule = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS rule, string_split_regex(t, {quoted(r.pattern)}) AS apart,
              regexp_extract_all(t, {quoted(r.pattern)}, 0) AS found, regexp_extract_all(t, {quoted(r.pattern)}, {r.value}) AS val
            FROM texts""" for i, r in enumerate(secrets.RULES))
    joined = lambda where: f"""coalesce(string_agg(kind || ':' || (ends - size) || ':' || ends, ',' ORDER BY ends - size, rule)
        {where}, '')"""
    counts = ", ".join(f"count(*) FILTER (rule = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.RULES) if r.base)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      rules AS (SELECT * FROM (VALUES {rules}) r(rule, kind, pattern, val, least, base)),
      lists AS ({per_rule}),
      places AS (SELECT doc_id, rule, unnest(range(1, len(found) + 1)) AS i, apart, found, val FROM lists),
      spans AS (SELECT p.doc_id, r.kind, r.base, p.rule, length(found[i]) AS size,
          CAST(list_sum([length(x) for x in apart[1:i]]) + list_sum([length(x) for x in found[1:i]]) AS BIGINT) AS ends
        FROM places p JOIN rules r ON r.rule = p.rule WHERE length(p.val[i]) >= r.least)
    SELECT d.doc_id, {counts}, sha256({joined("FILTER (base)")}) AS base_sha256, {joined("FILTER (kind IS NOT NULL)")} AS spans
    FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


_SQL["op6_secrets"] = _secrets_sql()


@query
def op1_bpe(spark, d):
    return bpe.round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_license_scan(spark, d):
    return licenses.scan(table(spark, d, "documents"))


@query
def op6_secrets(spark, d):
    return secrets.findings(table(spark, d, "documents"))


@query
def op5_minhash_near_dup(spark, d):
    return neardup.near_duplicates(table(spark, d, "documents"))


@query
def op2_line_dedup(spark, d):
    return linededup.drop_duplicate_lines(table(spark, d, "documents"))


@query
def op7_vector_near_dup(spark, d):
    return vectors.near_duplicates(table(spark, d, "embeddings"))


@query
def op8_exact_dedup(spark, d):
    return exactdedup.deduplicate(table(spark, d, "documents"))


SHARDS = [f"shard-{i:03d}" for i in range(100)]


@query
def op9_sharding(spark, d):
    return sharding.place(table(spark, d, "documents"), SHARDS)


@query
def op10_language_id(spark, d):
    docs = table(spark, d, "documents")
    fold = langid.fold(F.col("doc_id"))
    profiles = langid.learn(docs.filter(fold != 1))
    return langid.predict(docs, profiles) \
        .select("doc_id", F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op11_token_records(spark, d):
    return records.described(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_spelling_variants(spark, d):
    return spellings.variants(table(spark, d, "documents"))


@query
def op13_conversation_repair(spark, d):
    return dialogue.repair(table(spark, d, "conversations"))


@query
def pipeline(spark, d):
    return corpus_pipeline.run(spark, d)
