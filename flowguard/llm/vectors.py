"""Near-duplicate vectors by counting collisions of one-dimensional projections.

All vectors are projected on many random directions and projections held in
steps of a byte. A query's window on a direction holds the vectors whose
projection differs by no more than a fixed width; it is not cut from a sorted
list, but tested for every pair of vectors. Pairs that meet in enough windows are verified. How
many are enough follows from the chance that a pair at the similarity bound
meets in one window.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import broadcast_if_small, components

SIMILARITY = 0.9
DIRECTIONS = 64
RECALL = 0.9999
# Half-width of a window, as a share of the distance of a pair at the bound.
WINDOW = 0.85
BLOCK_ROWS = 4096
PAIRS_AT_ONCE = 1 << 16
QUERIES_AT_ONCE = 32
# With fewer dimensions a projection says little: all pairs of a block are verified.
LEAST_DIMS = 16


def collisions_needed(directions: int = DIRECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the bound reaches with at least this chance.

    On a random direction the difference of two vectors at distance d is about
    normal with deviation d / sqrt(dims), whatever the data, so the counts are
    binomial; a closer pair meets more often.
    """
    p = math.erf(window / math.sqrt(2))
    missed = 0.0
    for count in range(directions + 1):
        missed += math.comb(directions, count) * p ** count * (1 - p) ** (directions - count)
        if missed > 1 - recall:
            return count
    return directions


def directions_for(dims: int, number: int = DIRECTIONS, seed: int = 7) -> np.ndarray:
    """Random directions as columns, orthogonal in groups of ``dims``."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-number // dims))]
    return np.concatenate(groups, axis=1)[:, :number]


def linked_pairs(a: np.ndarray, b: np.ndarray, same: bool, least: float = SIMILARITY, directions: int = DIRECTIONS,
                 window: float = WINDOW, recall: float = RECALL):
    """Yield (rows of a, rows of b) with a cosine of at least ``least``; each pair once if ``same``.

    ``a`` and ``b`` hold unit vectors.
    """
    if not len(a) or not len(b):
        return
    dims = a.shape[1]
    if dims < LEAST_DIMS:
        needed = 0
        steps_a, steps_b = np.zeros((len(a), 0), np.uint8), np.zeros((0, len(b)), np.uint8)
        half = np.uint8(0)
    else:
        needed = collisions_needed(directions, window, recall)
        # Sorted by counting: a projection's place in the order is one of 256 steps, 32 to a deviation of random
        # unit vectors. Windows are rounded up to whole steps and what lies beyond four deviations counts as four,
        # so that no collision is lost.
        d, scale = directions_for(dims, directions), 32 * math.sqrt(dims)
        steps_a, steps_b = (np.clip(np.floor(x @ d * scale) + 128, 0, 255).astype(np.uint8) for x in (a, b))
        steps_b = np.ascontiguousarray(steps_b.T)
        half = np.uint8(math.ceil(window * math.sqrt(2 - 2 * least) * 32))
    for q in range(0, len(a), QUERIES_AT_ONCE):
        low = q if same else 0
        own = steps_a[q:q + QUERIES_AT_ONCE] + half
        counts = np.zeros((len(own), len(b) - low), np.uint8)
        apart, met = np.empty_like(counts), np.empty(counts.shape, bool)
        for j in range(len(steps_b)):
            # In bytes, a difference below 0 is a large one.
            np.subtract(own[:, j, None], steps_b[j, None, low:], out=apart)
            np.less_equal(apart, 2 * half, out=met)
            np.add(counts, met.view(np.uint8), out=counts)
        i, j = np.nonzero(counts >= needed)
        i, j = i + q, j + low
        if same:
            i, j = i[j > i], j[j > i]
        for at in range(0, len(i), PAIRS_AT_ONCE):
            x, y = i[at:at + PAIRS_AT_ONCE], j[at:at + PAIRS_AT_ONCE]
            near = np.einsum("ij,ij->i", a[x], b[y]) >= least
            yield x[near], y[near]


def _block_pair(least, directions, window, recall):
    """Links between two blocks: (id, links of it here, smallest id that links here reach)."""
    def run(key, table):
        ids = np.asarray(table["id"].to_pylist())
        copies = table["copies"].to_numpy()
        block = table["block"].to_numpy()
        flat = table["v"].combine_chunks()
        v = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        # By id, so that the first index of a component is its smallest id.
        order = np.argsort(ids, kind="stable")
        ids, copies, block, v = ids[order], copies[order], block[order], v[order]
        low, high = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in linked_pairs(v[left], v[right], low == high, least, directions, window, recall):
            i, j = left[i], right[j]
            links += np.bincount(i, copies[j], len(ids)).astype(np.int64)
            links += np.bincount(j, copies[i], len(ids)).astype(np.int64)
            apart = root[i] != root[j]
            for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
            while (root != root[root]).any():
                root = root[root]
        linked = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[linked]), "links": pa.array(links[linked]),
                         "label": pa.array(ids[root[linked]])})
    return run


def near_duplicates(vectors: DataFrame, least: float = SIMILARITY, directions: int = DIRECTIONS,
                    window: float = WINDOW, recall: float = RECALL, block_rows: int = BLOCK_ROWS,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links between vectors with a cosine of at least ``least``.

    Returns a row per row of ``vectors``: ``id_col``, n_links (other vectors
    linked directly), component_id (smallest id reachable by links) and kept
    (whether it is that id).

    Vectors that are NULL, empty, zero or hold NULL or non-finite components,
    and rows with a NULL id, link with nothing; so do vectors of different
    length. Identical vectors are counted once and multiplied afterwards.
    Repeated rows count as further vectors. Other columns are not read.

    Rows are dealt evenly to blocks of about ``block_rows``. Every pair of
    blocks is one task's work; it returns counts and local components, never
    pairs, so that a group of copies costs no output.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")) \
        .withColumn("h", F.when(usable, F.struct(F.xxhash64("v"), F.xxhash64(F.reverse("v")))))
    distinct = materialise(plain.filter("h IS NOT NULL").groupBy("h").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    blocks = max(1, -(-distinct.count() // block_rows))
    # Dealt by a hash of the id; every block meets every other once, in the task of (smaller, larger).
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    met = distinct.select("id", "copies", "v", F.size("v").alias("dims"), own.alias("block")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .select("id", "copies", "v", "block", "dims", F.least("block", "other").alias("low"),
                F.greatest("block", "other").alias("high"))
    partial = materialise(met.groupBy("dims", "low", "high").applyInArrow(
        _block_pair(least, directions, window, recall), "id long, links long, label long"), "links")
    links = partial.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(partial.select(F.col("id").alias("a"), F.col("label").alias("b")))
    result = materialise(
        distinct.select("h", "id", "copies").join(links, "id", "left").join(reached, "id", "left")
        .select("h", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id"))
        .filter("n_links > 0"), "linked")
    return plain.select("id", "h").join(broadcast_if_small(result, 64), "h", "left") \
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component_id", "id").alias("component_id"),
                F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
