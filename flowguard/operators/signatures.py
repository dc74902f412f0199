"""Many payload signatures at once: an index of required text, and regular expressions on candidates only.

A signature can match only payloads that hold the longest text it requires. Of
the four-character grams of that text the one that the fewest signatures share
is its anchor. Payload grams are looked up among the anchors inside the scan,
and a regular expression runs only where the anchor and then the whole required
text were found. Signatures that require no such text are tried on all payloads.
"""

import sys
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packet import payload_text
from ..session import materialise
from .lookup import BROADCAST_ROWS, Lookup, bounded, look_up

# Functions of this module travel to the workers by value, which therefore need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 4
# So many signatures without required text are tried as one regular expression.
SIGNATURES_JOINED = 100
# A row that holds a signature is about so many times as wide as the keys that bounds of broadcasts are made for.
SIGNATURE_WIDTH = 8

# Pairs of brackets, and the quantifiers after which a character may be missing.
_CLOSING = {"(": ")", "[": "]", "{": "}"}
_OPTIONAL = "*?{"


def signature(pattern: str, mode: str) -> str:
    if mode not in ("full", "find"):
        raise ValueError(f"unknown signature mode {mode!r}")
    # \A..\z, since $ would also accept a trailing line break.
    return f"\\A(?:{pattern})\\z" if mode == "full" else pattern


def joined_signatures(patterns, mode: str) -> list[str]:
    """Regular expressions of which one matches if any of the patterns does.

    Plain patterns become alternatives of a few large expressions. Those that
    count or name their groups, that set flags or quote, stay alone.
    """
    alone = [p for p in sorted(patterns) if any(x in p for x in ("(?<", "(?i", "#", "\\Q", "\\E", "\\k"))
             or any(f"\\{d}" in p for d in range(1, 10))]
    plain = sorted(set(patterns) - set(alone))
    parts = [plain[i:i + SIGNATURES_JOINED] for i in range(0, len(plain), SIGNATURES_JOINED)]
    return [signature("|".join(f"(?:{p})" for p in part), mode) for part in parts] + [signature(p, mode) for p in alone]


def compiles(pattern: Column) -> Column:
    """Whether the regular expression engine takes a pattern; it is asked once per rule, never per packet."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def required_text(pattern: str) -> str:
    """The longest text that stands in whatever a pattern matches; '' if none is certain.

    Only plain characters outside of groups and classes count. A pattern with
    alternatives at its top, with flags or with quotes has none.
    """
    best, run, at, n = "", "", 0, len(pattern)

    def end(run, best):
        return run if len(run) > len(best) else best

    while at < n:
        c = pattern[at]
        if c == "|" or pattern.startswith(("(?i", "(?x", "(?s", "(?m", "(?u", "(?d", "(?U", "(?-"), at):
            return ""
        if c == "\\":
            escaped = pattern[at + 1:at + 2]
            if escaped in ("Q", "E"):
                return ""
            if escaped and not escaped.isalnum():
                run, at = run + escaped, at + 2
                continue
            best, run, at = end(run, best), "", at + 2
            # What belongs to an escape is no text: \\x41, \\u0041, \\0101, \\12, \\cA, \\p{L}, \\k<name>.
            if escaped in "xu0123456789":
                while at < n and pattern[at] in "0123456789abcdefABCDEF":
                    at += 1
            elif escaped == "c":
                at += 1
            elif escaped in "pP" and at < n and pattern[at] != "{":
                at += 1
            elif escaped == "k":
                at = pattern.find(">", at) + 1 or n
            if at < n and pattern[at] == "{" and escaped in "pPxN":
                at = pattern.find("}", at) + 1 or n
            continue
        if c in "([":
            # Over a whole group or class, whatever it holds.
            best, run, depth = end(run, best), "", []
            while at < n:
                c = pattern[at]
                if c == "\\":
                    if pattern[at + 1:at + 2] == "Q":
                        return ""
                    at += 1
                elif c == "(" and (not depth or depth[-1] == ")") or c == "[":
                    depth.append(_CLOSING[c])
                    if c == "[" and pattern[at + 1:at + 2] == "^":
                        at += 1
                    if c == "[" and pattern[at + 1:at + 2] == "]":
                        at += 1
                elif depth and c == depth[-1]:
                    depth.pop()
                    if not depth:
                        break
                at += 1
            at += 1
            continue
        if c in ".^$)":
            best, run = end(run, best), ""
        elif c in _OPTIONAL:
            best, run = end(run[:-1], best), ""
            if c == "{":
                at = pattern.find("}", at)
                if at < 0:
                    return ""
        elif c == "+":
            best, run = end(run, best), ""
        else:
            run += c
        at += 1
    return end(run, best)


def _grams(text) -> Column:
    """All runs of GRAM characters of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def signature_index(patterns: DataFrame) -> DataFrame:
    """A written index over a column ``value`` of patterns: (value, required, gram); no gram if too little is required."""
    find = required_text

    def required(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([find(p) for p in batch.column(0).to_pylist()], pa.string())],
                                             names=["value", "required"])

    known = materialise(patterns.select("value").distinct().mapInArrow(required, "value string, required string"), "required")
    grams = known.select("value", F.explode(_grams("required")).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"))
    anchors = grams.join(bounded(materialise(shared, "grams")), "gram").groupBy("value").agg(F.min(F.struct("n", "gram")).alias("anchor"))
    return materialise(known.join(anchors, "value", "left").select("value", "required", F.col("anchor.gram").alias("gram")), "signatures")


def unindexed(patterns: DataFrame) -> DataFrame:
    """An index for a few patterns, which are all tried on all payloads."""
    return patterns.select("value", F.lit("").alias("required"), F.lit(None).cast("string").alias("gram"))


def signature_matches(df: DataFrame, index: DataFrame, mode: str = "full", payload: str = "payload",
                      broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row per row of ``df`` and signature that its payload matches: all columns, ``_text`` and ``_signature``."""
    texts = df.withColumn("_text", payload_text(payload)).filter("_text IS NOT NULL")
    # A row per signature, so that a gram which many share is neither one wide row nor counted as one.
    anchors = index.filter("gram IS NOT NULL").select(F.col("gram").alias("key"), F.struct("value", "required").alias("_candidate"))
    anchored = look_up(texts.withColumn("_gram", F.explode(_grams("_text"))), [Lookup(F.col("_gram"), anchors)],
                       broadcast_rows // SIGNATURE_WIDTH)
    candidates = anchored.filter("_candidate IS NOT NULL").select(*texts.columns, "_candidate") \
        .filter(F.contains("_text", "_candidate.required"))
    # The pattern is a column: it is compiled for each candidate, of which few are left.
    around = ("\\A(?:", ")\\z") if signature("", mode) else ("", "")
    whole = F.concat(F.lit(around[0]), F.col("_candidate.value"), F.lit(around[1]))
    found = candidates.filter(F.regexp_like(F.col("_text"), whole)).select(*texts.columns, F.col("_candidate.value").alias("_signature"))

    # What an index has no anchor for comes to the driver and into the plan.
    free = sorted(r["value"] for r in index.filter("gram IS NULL").collect())
    if not free:
        return found
    parts = []
    for at in range(0, len(free), SIGNATURES_JOINED):
        part = free[at:at + SIGNATURES_JOINED]
        each = F.array(*(F.when(F.col("_text").rlike(signature(p, mode)), F.lit(p)) for p in part))
        # Which of them it is asked only where one of them matches.
        hit = reduce(lambda a, b: a | b, (F.col("_text").rlike(p) for p in joined_signatures(part, mode)))
        parts.append(F.when(hit, F.array_compact(each)))
    return found.unionByName(texts.withColumn("_signature", F.explode(F.flatten(F.array_compact(F.array(*parts))))))
