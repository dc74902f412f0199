"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its content. The ledger has a row for
each blob and rule version that was scanned; only unseen pairs are scanned,
and findings are joined back to all rows that hold the blob. Built from
DataFrame functions alone.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import materialise, no_rows, scratch_path
from .common import broadcast_if_small

RULE_VERSION = "2"
MARK = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``value`` has at least ``least`` characters."""
    kind: str
    pattern: str
    least: int
    value: int = 0
    base: bool = True


# What counts as a secret.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]+", 32),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40, base=False),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, base=False),
)

# What is searched for instead where a match is a whole run of characters: only runs that are long enough.
# An assignment is no such run. A short one is found and dropped, for it may cover the start of another.
_SEARCHED = {"hex": "[0-9a-f]{32,}", "access": "AKIA[A-Z0-9]{12,}", "github": "gh[pousr]_[A-Za-z0-9]{36,}"}

_BLOB = "blob binary, version string, spans array<struct<start:int,rule:int,end:int>>"


def blob_of(text):
    """The address of a text: the SHA-256 of its UTF-8 bytes; NULL counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def find_spans(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All matches in a table (blob, text): rows (blob, rule, start, end) in code points, end exclusive.

    What lies between matches (``split``) and the matches themselves come as
    arrays of lengths; running sums over them, one row per match, give places.
    """
    per_rule = []
    for number, rule in enumerate(rules):
        searched = _SEARCHED.get(rule.kind, rule.pattern)
        pattern = F.lit(searched)
        zipped = F.arrays_zip(F.split("text", searched, -1),
                              F.regexp_extract_all("text", pattern, F.lit(0)),
                              F.regexp_extract_all("text", pattern, F.lit(rule.value)))
        lengths = F.transform(F.filter(zipped, lambda x: x["1"].isNotNull()), lambda x, i: F.struct(
            F.lit(number).alias("rule"), i.alias("i"), F.length(x["0"]).alias("before"),
            F.length(x["1"]).alias("size"), F.length(x["2"]).alias("value")))
        per_rule.append(F.when(F.col("text").rlike(searched), lengths))
    empty = F.array().cast("array<struct<rule:int,i:int,before:int,size:int,value:int>>")
    rows = texts.select("blob", F.explode(F.flatten(F.array(*(F.coalesce(x, empty) for x in per_rule)))).alias("m")) \
        .select("blob", "m.*")
    along = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("rule") + 1)
    return rows.withColumn("end", F.sum(F.col("before") + F.col("size")).over(along)) \
        .filter(F.col("value") >= least) \
        .select("blob", "rule", (F.col("end") - F.col("size")).cast("int").alias("start"), F.col("end").cast("int"))


class Ledger:
    """A folder with one row per scanned blob and rule version; it only grows."""

    def __init__(self, spark, path: str, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION):
        self.spark, self.path, self.rules, self.version = spark, path, rules, version

    def scanned(self) -> DataFrame:
        """What is known under this rule version: (blob, spans)."""
        try:
            table = self.spark.read.schema(_BLOB).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            table = no_rows(self.spark, _BLOB)
        return table.filter(F.col("version") == self.version).select("blob", "spans")

    def scan(self, history: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Scan the blobs of ``history`` that were not scanned before; returns their number."""
        paths = history.select(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob"))
        # One row per blob before anything is joined, whatever the number of its copies.
        new = paths.groupBy("blob").agg(F.min("id").alias("id")).join(self.scanned(), "blob", "left_anti")
        new = materialise(new, "blobs")
        number = new.count()
        plain = history.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
        texts = plain.alias("h").join(broadcast_if_small(new, 64).alias("n"), F.col("h.id").eqNullSafe(F.col("n.id"))) \
            .select("blob", "text").filter(blob_of(F.col("text")) == F.col("blob"))
        found = find_spans(texts, self.rules).distinct().groupBy("blob").agg(
            F.sort_array(F.collect_list(F.struct("start", "rule", "end"))).alias("spans"))
        done = new.select("blob").join(found, "blob", "left") \
            .select("blob", F.lit(self.version).alias("version"),
                    F.coalesce("spans", F.array().cast("array<struct<start:int,rule:int,end:int>>")).alias("spans"))
        if number:
            done.write.mode("append").parquet(self.path)
        return number

    def found(self) -> DataFrame:
        """Blobs with findings, ready to be joined."""
        return broadcast_if_small(self.scanned().filter(F.size("spans") > 0), 256)


def findings(docs: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Secrets in every text, scanned through a ledger.

    Returns a row per row of ``docs``: ``id_col``, the number of matches of
    each base rule (n_assign, n_access, n_hex), base_sha256 (of the base spans
    as kind:start:end, by start and then rule, joined by commas) and spans
    (all spans in that form). NULL and empty texts have none; repeated rows
    each have their findings; other columns are not read.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, scratch_path(spark, "ledger"))
    ledger.scan(docs, id_col, text_col)
    rules = ledger.rules
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    base = F.array(*(F.lit(i) for i, r in enumerate(rules) if r.base))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,rule:int,end:int>>"))
    paths = docs.select(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob"))
    joined = paths.join(ledger.found(), "blob", "left").withColumn("spans", spans)

    def of_rule(number):
        return F.filter("spans", lambda s: s["rule"] == number)

    counts = [F.size(of_rule(n)).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(rules) if r.base]
    return joined.select(F.col("id").alias(id_col), *counts,
                         F.sha2(text(F.filter("spans", lambda s: F.array_contains(base, s["rule"]))), 256)
                         .alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ledger: Ledger | None = None, mark: str = MARK, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mark``; all rows and other columns stay.

    Overlapping spans become one mark. A text without findings is unchanged.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, scratch_path(spark, "ledger"))
    ledger.scan(docs, id_col, text_col)
    # Merge overlapping spans of a blob: a new cut begins where no earlier span reaches.
    before = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    cuts = ledger.scanned().filter(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).select("blob", "s.*") \
        .withColumn("begins", F.coalesce((F.col("start") >= F.max("end").over(before)).cast("int"), F.lit(1))) \
        .withColumn("cut", F.sum("begins").over(along)) \
        .groupBy("blob", "cut").agg(F.min("start").alias("start"), F.max("end").alias("end")) \
        .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_flowguard_cuts"))
    cuts = broadcast_if_small(materialise(cuts.withColumnRenamed("blob", "_flowguard_blob"), "cuts"), 256)
    text = F.col(text_col)
    starts = F.concat(F.transform("_flowguard_cuts", lambda c: c["start"]), F.array(F.length(text)))
    ends = F.concat(F.array(F.lit(0)), F.transform("_flowguard_cuts", lambda c: c["end"]))
    kept = F.array_join(F.zip_with(ends, starts, lambda a, b: text.substr(a + 1, b - a)), mark)
    columns = [F.when(F.col("_flowguard_cuts").isNotNull(), kept).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")
               for c in docs.columns]
    return docs.withColumn("_flowguard_blob", blob_of(text)).join(cuts, "_flowguard_blob", "left").select(*columns)
