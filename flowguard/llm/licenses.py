"""License scans by diagonal voting.

Every rolling word 3-gram of every text is hashed and joined to the positions
of that 3-gram in the license templates. Hits with one offset between text
and template lie on one diagonal and are counted together; neighbouring
diagonals, which small insertions and omissions cause, are merged, and the
spans that gather enough votes are verified word by word.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import UPPER, LOWER, WordHasher, broadcast_if_small, lists, per_worker

GRAM = 3
SIMILARITY = 0.8
# 3-grams of a very long text are sent on in rows of at most so many.
GRAMS_PER_ROW = 1 << 16

# Phrases that count as they stand, and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Openings of license notices, which count if at least SIMILARITY of their words are there.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                 "compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
              "published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans(UPPER, LOWER)
_PER_TEXT = -7046029254386353131  # stands for a text itself among its 3-grams


def words_of(text: str | None) -> list[str]:
    """The words of a text, A-Z in lower case."""
    return WORD.findall((text or "").translate(_FOLD))


def grams_of(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    """The hash of each run of k words, from the hashes of the words."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:n + i]
    return out.view(np.int64)


def templates(phrases=PHRASES, notices=NOTICES, similarity: float = SIMILARITY) -> list[dict]:
    """Label, words and allowed edits of every template."""
    made = [{"label": label, "words": words_of(text), "edits": 0, "base": True} for label, text in phrases]
    for label, text in notices:
        words = words_of(text)
        made.append({"label": label, "words": words, "edits": int(len(words) * (1 - similarity) + 1e-9), "base": False})
    if any(len(t["words"]) < GRAM for t in made):
        raise ValueError(f"a template needs at least {GRAM} words")
    return made


def scan(docs: DataFrame, known: list[dict] | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Find license phrases and notices in every text.

    Returns ``id_col``, n_words, n_base, first_word, last_word, base_labels,
    labels and score: how many words the text has, at how many places a phrase
    stands, the smallest and largest first word of these (NULL without any),
    the labels of phrases and of everything found (sorted, joined by commas),
    and the best similarity of a place with its template (0 without any).

    NULL and empty texts have no words. Rows that repeat id and text give one
    row. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    known = templates() if known is None else known
    hasher = WordHasher(1 << 12)
    positions = []
    for number, t in enumerate(known):
        _, h, _ = next(hasher.texts(pa.array([" ".join(t["words"])])))
        least = max(1, len(t["words"]) - GRAM + 1 - GRAM * t["edits"])
        positions += [(int(g), number, at, least, t["edits"]) for at, g in enumerate(grams_of(h))]
    positions.append((_PER_TEXT, -1, 0, 1, 0))
    # As large as the templates, whatever the input: a few hundred rows.
    template_grams = F.broadcast(spark.createDataFrame(
        positions, "gram long, template int, at int, least int, edits int"))

    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                        F.xxhash64(F.col(text_col)).alias("_key"))
    kind = plain.schema["_id"].dataType.simpleString()
    grams = plain.mapInArrow(_grams, f"_id {kind}, _key long, n_words int, base int, grams array<bigint>")
    hits = grams.select("_id", "_key", "n_words", "base", F.posexplode("grams").alias("place", "gram")) \
        .join(template_grams, "gram")
    diagonal = F.when(F.col("template") < 0, 0).otherwise(F.col("base") + F.col("place") - F.col("at"))
    votes = hits.groupBy("_id", "_key", "template", diagonal.alias("diagonal"), "least", "edits") \
        .agg(F.count_distinct("at").alias("votes"), F.max("n_words").alias("n_words"))
    votes = materialise(votes, "diagonals")

    # Merge diagonals that lie no further apart than the template's edits.
    along = Window.partitionBy("_id", "_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("edits"), F.lit(True))
    spans = votes.filter("template >= 0") \
        .withColumn("group", F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("_id", "_key", "template", "group", "least") \
        .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high")) \
        .filter(F.col("votes") >= F.col("least"))
    spans = materialise(spans.groupBy("_id", "_key").agg(
        F.collect_list(F.struct("template", "low", "high")).alias("spans")), "spans")

    same = [plain["_id"].eqNullSafe(F.col("s._id")), plain["_key"] == F.col("s._key")]
    found = plain.join(broadcast_if_small(spans, 256).alias("s"), same) \
        .select(plain["_id"], plain["_key"], "_text", "spans") \
        .mapInArrow(_verifier(known), f"_id {kind}, _key long, n_base long, first_word long, last_word long, "
                                      "base_labels string, labels string, score double") \
        .dropDuplicates(["_id", "_key"])
    texts = votes.filter("template < 0").select("_id", "_key", F.col("n_words").cast("long"))
    return texts.alias("t").join(found.alias("f"), F.col("t._id").eqNullSafe(F.col("f._id"))
                                 & (F.col("t._key") == F.col("f._key")), "left") \
        .select(F.col("t._id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"),
                "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _grams(batches):
    hasher = per_worker("words", WordHasher)
    for batch in batches:
        ids, keys = batch.column(0), batch.column(2)
        for first, h, bounds in hasher.texts(batch.column(1)):
            rows, bases, parts = [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                own = grams_of(h[a:b])
                for base in range(0, max(1, len(own)), GRAMS_PER_ROW):
                    part = own[base:base + GRAMS_PER_ROW]
                    parts.append(part if base else np.append(part, np.int64(_PER_TEXT)))
                    rows.append(i)
                    bases.append(base)
            at = np.array(rows)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at + first)), keys.take(pa.array(at + first)),
                 pa.array(np.diff(bounds)[at], pa.int32()), pa.array(bases, pa.int32()),
                 lists(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))],
                names=["_id", "_key", "n_words", "base", "grams"])


def _verifier(known):
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words, places, base, labels, best = words_of(text), [], set(), set(), 0.0
                for span in spans:
                    t = known[span["template"]]
                    size = len(t["words"])
                    if t["base"]:
                        if words[span["low"]:span["low"] + size] == t["words"]:
                            places.append(span["low"])
                            base.add(t["label"])
                            labels.add(t["label"])
                            best = 1.0
                        continue
                    window = words[max(0, span["low"] - t["edits"]):span["high"] + size + t["edits"]]
                    edits = edits_within(t["words"], window)
                    if edits <= t["edits"]:
                        labels.add(t["label"])
                        best = max(best, 1 - edits / size)
                out.append((len(places), min(places, default=None), max(places, default=None),
                            ",".join(sorted(base)), ",".join(sorted(labels)), best))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns],
                names=["_id", "_key", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return run


def edits_within(template: list[str], window: list[str]) -> int:
    """The fewest word edits that turn some part of the window into the template."""
    row = [0] * (len(window) + 1)
    for i, word in enumerate(template, 1):
        diagonal, row[0] = row[0], i
        for j, other in enumerate(window, 1):
            diagonal, row[j] = row[j], min(diagonal + (word != other), row[j] + 1, row[j - 1] + 1)
    return min(row)
