"""Near-duplicate documents by Order MinHash and banded alignment.

A sketch value holds, for one hash function, the few smallest of a text's
occurrence-labelled five-word shingles in the order in which the text has them.
Unlike a set's minima it changes when passages change places. Texts that share
a value are candidates, however many share it; candidates are verified by
aligning their shingles, except for those that are in one class already.
"""

import hashlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import WordHasher, broadcast_if_small, components, lists, mix, per_worker, ragged

SHINGLE = 5
SIMILARITY = 0.8
# Minima per value and values per text: a pair at 0.8 shares none of 18 with a chance of 3e-6.
MINIMA, BANDS = 3, 18
# The pairs of a bucket of up to so many texts are made by a join; those of a larger one are compared in chunks.
BUCKET = 16
# Texts of a larger bucket that one task compares with as many others, and rows of such chunks a task reads.
CHUNK = 256
TASK_ROWS = 4096
# Texts that are brought to lower case at a time.
PART = 256
# From so many pairs of two chunks on the shingles that they share are counted for all of them at once, and labels with
# more pairs of texts than COMMON are counted by a matrix product.
COUNTED = 256
COMMON = 64


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Occurrence-labelled k-word shingles; a text of fewer words has one, itself."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i:n - k + 1 + i].astype(np.uint64)
    h = mix(h)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    if new.all():
        return h
    place = np.arange(len(h))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return mix(h + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketch(labels: np.ndarray, bands: int = BANDS, minima: int = MINIMA) -> np.ndarray:
    """One value per hash function: its smallest labels, in text order."""
    out = np.zeros(bands, np.uint64)
    n = len(labels)
    factors = mix(np.arange(1, bands + 1, dtype=np.uint64)) | np.uint64(1)
    step = max(1, min(bands, (1 << 20) // n))
    for j in range(0, bands, step):
        own = factors[j:j + step]
        if n > minima:
            h = labels[None, :] * own[:, None]
            at = np.sort(np.argpartition(h, minima - 1, axis=1)[:, :minima], axis=1)
            chosen = labels[at]
        else:
            chosen = np.broadcast_to(labels, (len(own), n))
        value = own.copy()
        for i in range(chosen.shape[1]):
            value = mix(value * np.uint64(0xD6E8FEB86659FD93) + chosen[:, i])
        out[j:j + step] = value
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """The share of labelled shingles that a banded alignment matches, or 0 below ``least``.

    With m matches it is m / (len(a) + len(b) - m). An alignment that reaches
    ``least`` leaves so few shingles unmatched that no match lies further off
    the diagonal than the band, so the band costs nothing. Labels are distinct
    within a text, hence the best alignment is the longest increasing run of
    positions.
    """
    if not len(a) or not len(b):
        return 0.0
    total = len(a) + len(b)
    needed = least / (1 + least) * total - 1e-9
    _, at, there = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at) < needed:
        return 0.0
    band = total - 2 * needed
    near = np.abs(at - there) <= band
    at, there = at[near], there[near]
    there = there[np.argsort(at)]
    if len(there) and (there[1:] > there[:-1]).all():
        matched = len(there)
    else:
        tails = []
        for x in there.tolist():
            place = bisect_left(tails, x)
            if place == len(tails):
                tails.append(x)
            else:
                tails[place] = x
        matched = len(tails)
    return matched / (total - matched) if matched >= needed else 0.0


def _hashed(hasher, batch):
    """The ids of a few rows at a time with what ``WordHasher.texts`` yields for them; lower case takes further copies of a text."""
    for at in range(0, len(batch), PART):
        part = batch.slice(at, PART)
        for first, h, bounds in hasher.texts(pc.utf8_lower(part.column(1).cast(pa.large_string()))):
            yield part.column(0), first, h, bounds


def _sketches(batches):
    hasher = per_worker("words", WordHasher)
    for batch in batches:
        for ids, first, h, bounds in _hashed(hasher, batch):
            digests, sizes, values = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = h[a:b]
                labels = shingles(own)
                sizes.append(len(labels))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if b > a else None)
                values.append(sketch(labels) if b > a else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(sizes)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
                 lists(np.concatenate(values).view(np.int64), np.cumsum([0, *map(len, values)]))],
                names=["id", "digest", "n", "bands"])


def _word_arrays(batches):
    hasher = per_worker("words", WordHasher)
    for batch in batches:
        for ids, first, h, bounds in _hashed(hasher, batch):
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(bounds) - 1), lists(h.astype(np.uint32).view(np.int32), bounds)],
                names=["id", "words"])


def _verify(least):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            last, labels = None, None
            for i in range(len(batch)):
                # Neighbouring rows often share their first text.
                name = batch.column(0)[i]
                if last is None or name != last:
                    last, labels = name, shingles(left[i].values.to_numpy(zero_copy_only=False).view(np.uint32))
                other = shingles(right[i].values.to_numpy(zero_copy_only=False).view(np.uint32))
                keep.append(aligned(labels, other, least) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))
    return run


def shared_labels(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many labels each text of ``left`` has in common with each of ``right``."""
    out = np.zeros(len(left) * len(right), np.int64)
    x, y = (np.repeat(np.arange(len(side)), [len(own) for own in side]) for side in (left, right))
    _, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    m, k = (np.bincount(part, minlength=at.max(initial=-1) + 1) for part in (at[:len(x)], at[len(x):]))
    by_x, by_y = np.argsort(at[:len(x)], kind="stable"), np.argsort(at[len(x):], kind="stable")
    name = at[:len(x)][by_x]
    starts = np.cumsum(k) - k
    rare = (m * k > 0) & (m * k <= COMMON)
    some, own = x[by_x][rare[name]], name[rare[name]]
    for first in range(0, len(some), 1 << 16):
        part = own[first:first + (1 << 16)]
        others = y[by_y[ragged(starts[part], k[part])]]
        out += np.bincount(np.repeat(some[first:first + (1 << 16)], k[part]) * len(right) + others, minlength=len(out))
    out = out.reshape(len(left), len(right))
    often = m * k > COMMON
    column = np.where(often, np.cumsum(often) - 1, -1)
    for first in range(0, int(often.sum()), 2048):
        dense = []
        for side, texts, places in ((left, x, column[at[:len(x)]]), (right, y, column[at[len(x):]])):
            here = (places >= first) & (places < first + 2048)
            table = np.zeros((len(side), 2048), np.float32)
            table[texts[here], places[here] - first] = 1
            dense.append(table)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _alike(least):
    """Links that join the components of two chunks as all their candidate pairs would.

    A pair that shares several values is there only under the first. Of many
    pairs only those are aligned that have enough shingles in common.
    """
    def run(left, right):
        both = left if right is None else pa.concat_tables([left, right])
        both = both.combine_chunks()
        ids, n, band = both["id"].to_pylist(), both["n"].to_numpy(), both["band"][0].as_py()
        _, label = np.unique(np.array(both["component"].to_pylist()), return_inverse=True)
        values = np.stack([x.values.to_numpy(zero_copy_only=False) for x in both["bands"]])[:, :band]
        words, labels = both["words"], {}
        a, b = [], []
        # The second text of a pair: one that follows within the chunk, or any of the other chunk.
        second = slice(0 if right is None else len(left), len(both))
        one, two = n[:len(left), None], n[None, second]
        near = (np.minimum(one, two) >= least * np.maximum(one, two) - 1e-9) & (label[:len(left), None] != label[None, second])
        for j in range(band):
            near &= values[:len(left), None, j] != values[None, second, j]
        if right is None:
            near = np.triu(near, 1)

        def own(i):
            if i not in labels:
                labels[i] = shingles(words[i].values.to_numpy(zero_copy_only=False).view(np.uint32))
            return labels[i]

        if near.sum() >= COUNTED:
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            common = shared_labels([own(i) for i in rows.tolist()], [own(i) for i in (columns + second.start).tolist()])
            # What ``aligned`` asks for first.
            near[np.ix_(rows, columns)] &= common >= least / (1 + least) * (one[rows] + two[:, columns]) - 1e-9
        for x in np.flatnonzero(near.any(axis=1)).tolist():
            others = np.flatnonzero(near[x]) + second.start
            others = others[label[others] != label[x]]
            while len(others):
                y, others = int(others[0]), others[1:]
                if aligned(own(x), own(y), least) >= least:
                    a.append(ids[x])
                    b.append(ids[y])
                    label[label == label[y]] = label[x]
                    others = others[label[others] != label[x]]
        return a, b
    return run


def bucketed(texts: DataFrame, bucket: int = BUCKET, least: float = SIMILARITY,
             within: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of a table (id, n, bands, ...) that share a sketch value, and the members of large buckets.

    Buckets of up to ``bucket`` texts give all their pairs, but for those whose
    sizes ``n`` are further apart than ``least`` allows or that fail the
    condition ``within`` on the columns of a and b. A larger one gives the pairs
    with its first text only, so that a group of copies is soon known; its
    members (id, band, value, first) are returned for ``crossed``, which
    compares them all.
    """
    own = [c for c in texts.columns if c != "bands"]
    rows = texts.select(*own, F.posexplode("bands").alias("band", "value"))
    close = (F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n")) & (F.col("a.id") < F.col("b.id"))
    close = close if within is None else close & within
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("size"), F.min("id").alias("first")).filter("size > 1")
    # The sizes of buckets that matter are few; written, they make the next join a join of plain scans.
    sizes = materialise(sizes, "buckets")
    shared = materialise(rows.join(broadcast_if_small(sizes, 64), ["band", "value"]), "shared")
    small = shared.filter(F.col("size") <= bucket).select(*own, "band", "value")
    together = small.alias("a").join(small.alias("b"), (F.col("a.band") == F.col("b.band"))
                                     & (F.col("a.value") == F.col("b.value")) & close) \
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    large = shared.filter(F.col("size") > bucket).select("id", "band", "value", "first")
    star = large.filter(F.col("id") > F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    return together.union(star).distinct(), large


def crossed(large: DataFrame, known: DataFrame, payload: DataFrame, compare: Callable, chunk: int = CHUNK,
            task_rows: int = TASK_ROWS) -> DataFrame:
    """What ``compare`` finds among all pairs of a large bucket that lie in different components: (a, b).

    ``large`` has the members of buckets (id, band, value, first), ``known`` the
    components so far (id, component), ``payload`` by id what is compared. The
    members of a bucket are cut into chunks of about ``chunk``. Every two chunks
    meet in one task, which reads few rows however large the bucket is; only
    those inside the component of the first text do not meet each other.

    ``compare`` is called with the two chunks (or with one and None, for the
    pairs within it), tables of id, band, component and the payload, and gives
    lists a and b of ids. It should not give a row for every pair.
    """
    kind = large.schema["id"].dataType.simpleString()
    of = known.select("id", "component")
    members = large.join(of, "id", "left") \
        .join(of.select(F.col("id").alias("first"), F.col("component").alias("main")), "first", "left") \
        .withColumn("component", F.coalesce("component", "id")) \
        .select("id", "band", "value", "component", (F.col("component") == F.coalesce("main", "first")).alias("inside"))
    members = materialise(members, "members")
    counts = members.groupBy("band", "value") \
        .agg(F.count_if("inside").alias("inner"), F.count_if(~F.col("inside")).alias("outer")).filter("outer > 0") \
        .select("band", "value", F.ceil(F.col("inner") / chunk).alias("inner"), F.ceil(F.col("outer") / chunk).alias("outer"))
    counts = materialise(counts, "chunks")
    # Chunks 0, 1, ... are outside and meet all; those inside come after and meet the ones outside.
    place = F.xxhash64("id", F.lit(1))
    own = F.when(F.col("inside"), F.col("outer") + F.pmod(place, "inner")).otherwise(F.pmod(place, "outer"))
    last = F.col("outer") + F.when(F.col("inside"), 0).otherwise(F.col("inner")) - 1
    met = members.join(broadcast_if_small(counts, 64), ["band", "value"]) \
        .select("id", "band", "value", "component", own.alias("own"),
                F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")) \
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")
    met = materialise(met, "met")
    tasks = max(1, -(-met.count() // task_rows))

    def run(table):
        band, value, low, high, own = (table[c].to_numpy() for c in ("band", "value", "low", "high", "own"))
        order = np.lexsort((own, high, low, value, band))
        groups = np.stack([x[order].astype(np.int64) for x in (band, value, low, high)])
        starts = np.flatnonzero(np.append(True, (groups[:, 1:] != groups[:, :-1]).any(axis=0)))
        a, b = [], []
        for at in np.split(order, starts[1:]):
            left, right = at[own[at] == low[at]], at[own[at] != low[at]]
            if not len(left) or (not len(right) and low[at[0]] != high[at[0]]):
                continue
            some = compare(table.take(left), table.take(right) if len(right) else None)
            a += some[0]
            b += some[1]
        return pa.table({"a": pa.array(a, table["id"].type), "b": pa.array(b, table["id"].type)})

    return met.join(payload, "id") \
        .withColumn("task", F.pmod(F.xxhash64("band", "value", "low", "high"), F.lit(tasks))).groupBy("task") \
        .applyInArrow(run, f"a {kind}, b {kind}")


def joined(known: DataFrame, large: DataFrame, payload: DataFrame, compare: Callable) -> DataFrame:
    """The components of ``known`` after ``crossed`` has joined some of them."""
    if large.isEmpty():
        return known
    more = materialise(crossed(large, known, payload, compare).distinct(), "crossed")
    if more.isEmpty():
        return known
    return materialise(components(known.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more)), "component")


def linked(pairs: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The components that those of some stored pairs form which ``verified`` keeps: (id, component).

    First one pair per text is verified; then those that could still join two
    components. A pair inside one component would change nothing.
    """
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialise(verified(first), "verified")
    known = broadcast_if_small(materialise(components(links), "component"), 32)
    rest = pairs.join(first, ["a", "b"], "left_anti") \
        .join(known.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left") \
        .join(known.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left") \
        .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = materialise(verified(rest), "verified")
    if more.isEmpty():
        return known
    return materialise(components(links.union(more)), "component")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The class of near copies that every document belongs to.

    Returns a row per row of ``docs``: ``id_col``, class_id (the smallest id
    that links reach), class_size and kept (whether it is that document). Two
    texts are linked if an alignment of their five-word shingles matches at
    least ``least`` of them; texts of the same words are one from the start, so
    that copies are never compared. Words are runs of letters and digits,
    without case.

    Texts without words (NULL, empty) and rows with a NULL id are alike with
    nothing. Rows that share an id are decided alike. Other columns are not
    read. An empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    sketches = materialise(plain.mapInArrow(_sketches, f"id {kind}, digest binary, n int, bands array<bigint>"), "sketch")
    usable = sketches.filter("n > 0 AND id IS NOT NULL")
    texts = materialise(usable.groupBy("digest").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "texts")
    # Rows of one id with several texts: their classes are linked through the id.
    pairs, large = (materialise(x, name) for x, name in zip(bucketed(texts, least=least), ("pairs", "large")))

    # The members of large buckets are among them: each has a pair with the first.
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    involved = broadcast_if_small(materialise(involved, "involved"), 16)
    words = materialise(plain.join(involved, "id", "left_semi")
                        .mapInArrow(_word_arrays, f"id {kind}, words array<int>"), "words").dropDuplicates(["id"])
    words = materialise(words, "words")

    def verified(some):
        joined = some.join(words.select(F.col("id").alias("a"), F.col("words").alias("left")), "a") \
            .join(words.select(F.col("id").alias("b"), F.col("words").alias("right")), "b") \
            .select("a", "b", "left", "right")
        return joined.mapInArrow(_verify(least), f"a {kind}, b {kind}")

    known = linked(pairs, verified)
    known = joined(known, large, texts.select("id", "n", "bands").join(words, "id"), _alike(least))

    # Classes of more than one document, by digest.
    classes = texts.join(known, "id", "left") \
        .select("digest", "copies", F.coalesce("component", "id").alias("class_id"))
    sizes = classes.groupBy("class_id").agg(F.sum("copies").alias("class_size")).filter("class_size > 1")
    classes = materialise(classes.join(sizes, "class_id"), "classes").select("digest", "class_id", "class_size")
    return sketches.withColumn("digest", F.when(F.col("id").isNotNull(), F.col("digest"))) \
        .join(broadcast_if_small(classes, 64), "digest", "left") \
        .select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"),
                F.coalesce("class_size", F.lit(1)).alias("class_size"),
                F.coalesce(F.col("class_id") == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class of near copies; all columns stay."""
    found = materialise(near_duplicates(docs, least, id_col, text_col), "classes")
    dropped = materialise(found.filter(~F.col("kept")).select(F.col(id_col)).distinct(), "dropped")
    left = docs.join(broadcast_if_small(dropped, 16), id_col, "left_anti").select(*docs.columns)
    # A kept document may be there in several identical rows.
    repeated = found.filter(F.col("kept") & F.col(id_col).isNotNull() & (F.col("class_size") > 1)) \
        .groupBy(id_col).count().filter("count > 1")
    repeated = materialise(repeated.select(id_col), "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col])
    return left.join(repeated, id_col, "left_anti").select(*docs.columns).union(once)
