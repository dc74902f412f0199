"""Near copies of documents, lines and vectors against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edge import documents, empty, odd, odd_rows, rows, with_clashes
from pyspark.sql import functions as F

from flowguard.llm import common, linededup, neardup, vectors


def find(root, x):
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def union(root, a, b):
    a, b = find(root, a), find(root, b)
    root[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)] \
        + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(120)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b:
            union(root, a, b)
    got = dict(rows(common.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: find(root, x) for x in root}
    assert rows(common.components(spark.createDataFrame([], "a long, b long"))) == []


@pytest.mark.parametrize("most", [8, common.TASK_LINKS])
def test_components_of_many_and_of_few_links(spark, monkeypatch, most):
    monkeypatch.setattr(common, "TASK_LINKS", most)
    rnd = random.Random(2)
    order = rnd.sample(range(300), 300)
    edges = list(zip(order, order[1:])) + [(rnd.randint(400, 600), rnd.randint(400, 600)) for _ in range(90)] + [(None, 3)]
    root = {x: x for a, b in edges[:-1] if a != b for x in (a, b)}
    for a, b in edges[:-1]:
        if a != b:
            union(root, a, b)
    links = spark.createDataFrame(rnd.sample(edges, len(edges)), "a long, b long").repartition(3)
    assert sorted(rows(common.components(links))) == sorted((x, find(root, x)) for x in root)
    # Texts are in order of their bytes.
    texts = [("é", "z"), ("z", "Z"), ("𐀀", "\uffee")]
    assert sorted(rows(common.components(spark.createDataFrame(texts, "a string, b string")))) == \
        sorted([("é", "Z"), ("z", "Z"), ("Z", "Z"), ("𐀀", "\uffee"), ("\uffee", "\uffee")])


def test_components_of_few_links_take_few_jobs(spark):
    order = random.Random(3).sample(range(2000), 2000)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        assert set(dict(rows(common.components(links))).values()) == {0}
        # Rounds of stars took six or more jobs each.
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 8
    finally:
        spark.sparkContext._jsc.clearJobGroup()


# Documents

def words_of(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) >= 128:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def labelled(words):
    k, seen, out = min(5, len(words)), defaultdict(int), []
    for i in range(len(words) - k + 1) if words else ():
        s = tuple(words[i:i + k])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def common_run(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similarity(a, b):
    m = common_run(a, b)
    return m / (len(a) + len(b) - m) if a and b else 0.0


def classes(source, least=0.8):
    own = {i: labelled(words_of(t)) for i, t in source}
    root = {i: i for i in own}
    index = defaultdict(list)
    for i, labels in own.items():
        for s in set(labels):
            index[s].append(i)
    shared = defaultdict(int)
    for ids in index.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1:]:
                shared[min(a, b), max(a, b)] += 1
    for (a, b), n in shared.items():
        total = len(own[a]) + len(own[b])
        if n / (total - n) >= least and (own[a] == own[b] or similarity(own[a], own[b]) >= least):
            union(root, a, b)
    return {i: find(root, i) for i in root}


def test_near_copies_of_documents(spark):
    # Of the larger table those texts that a pair of copies can be found in quickly.
    source = [r[:2] for r in documents("/root/testdata/sf0.01") if len(r[1]) < 4000]
    want = classes(source)
    df = with_clashes(spark.createDataFrame(source, "doc_id long, text string").repartition(4))
    got = neardup.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    size = defaultdict(int)
    for c in want.values():
        size[c] += 1
    assert all(r.class_size == size[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randint(0, 400)}" for _ in range(150)]
    source = []
    for i in range(300):
        own = list(words)
        own[rnd.randrange(150)] = f"new{i}"
        source.append((i, " ".join(own)))
    # Texts that share a passage with all of these, and nothing else.
    source += [(1000 + i, " ".join([*words[:50], *(f"x{i}.{j}" for j in range(150))])) for i in range(200)]
    got = neardup.near_duplicates(spark.createDataFrame(source, "doc_id long, text string").repartition(5)).collect()
    for r in got:
        assert r.class_id == (0 if r.doc_id < 1000 else r.doc_id)


def test_pairs_in_a_large_family_of_pages(spark):
    # Pages of one template, no two of them quite alike but for planted pairs; most share a sketch value.
    rnd = random.Random(11)
    n, planted = 1000, 20
    numbers = {}
    template = [f"w{i}" for i in range(404)]

    def labels(page):
        return neardup.shingles(np.array([numbers.setdefault(w, len(numbers)) for w in page], np.uint64))

    def page(i):
        own = list(template)
        for part in range(6):
            own[67 * part + rnd.randrange(67)] = f"new{i}.{part}"
        return own

    pages, shingled = [], []
    while len(pages) < n + planted:
        i = len(pages)
        own, pair = page(i), set()
        if i >= n:
            own, pair = list(pages[2 * n - 1 - i]), {2 * n - 1 - i}
            for x in rnd.sample(range(404), 8):
                own[x] = f"copy{i}.{x}"
        new = labels(own)
        if {x for x, other in enumerate(shingled) if neardup.aligned(other, new) >= 0.8} == pair \
                and all(neardup.aligned(shingled[x], new) < 0.83 for x in pair):
            pages.append(own)
            shingled.append(new)
    df = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(pages)], "doc_id long, text string").repartition(4)
    want = {i: 2 * n - 1 - i if i >= n else i for i in range(len(pages))}
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want


def test_shared_labels():
    rng = np.random.default_rng(13)
    # Labels of a few texts, of many and of all; texts without any.
    left, right = ([np.unique(np.concatenate([np.arange(40), 100 + rng.integers(0, 3000, rng.integers(0, 300)),
                                              10_000 + rng.integers(0, 60, 20)])).astype(np.uint64) for _ in range(n)] for n in (70, 30))
    left[3] = right[5] = np.zeros(0, np.uint64)
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert neardup.shared_labels(left, right).tolist() == want
    assert neardup.shared_labels([left[3]], [right[5]]).tolist() == [[0]]


def test_unlike_texts_of_a_bucket_are_not_aligned(monkeypatch):
    # 200 texts with a common passage and one pair of copies: only that pair is worth an alignment.
    rng = np.random.default_rng(14)
    words = [np.concatenate([np.arange(60), rng.integers(1000, 1 << 31, 140)]) for _ in range(199)]
    words.append(np.append(words[7][:-1], 5))
    table = pa.table({"id": pa.array(range(200), pa.int64()), "n": pa.array([196] * 200, pa.int32()),
                      "band": pa.array([0] * 200, pa.int32()), "component": pa.array(range(200), pa.int64()),
                      "bands": pa.array([[i] for i in range(200)], pa.list_(pa.int64())),
                      "words": pa.array([w.astype(np.uint32).view(np.int32).tolist() for w in words], pa.list_(pa.int32()))})
    calls, aligned = [], neardup.aligned
    monkeypatch.setattr(neardup, "aligned", lambda *x: calls.append(x) or aligned(*x))
    assert neardup._alike(0.8)(table, None) == ([7], [199])
    assert neardup._alike(0.8)(table.slice(0, 100), table.slice(100)) == ([7], [199])
    assert len(calls) == 2


def test_documents_of_odd_rows(spark):
    df = with_clashes(odd(spark))
    got = rows(neardup.near_duplicates(df).select("doc_id", "class_id", "kept"))
    assert len(got) == len(odd_rows())
    by_id = {i: c for i, c, _ in got}
    assert by_id[14] == by_id[15] == by_id[16] == 14 and by_id[1] == 1 and by_id[3] == 3
    kept = [r.doc_id for r in neardup.drop_near_duplicates(df).collect()]
    assert kept.count(14) == 1 and 15 not in kept and kept.count(7) == 1 and kept.count(None) == 2
    assert rows(neardup.near_duplicates(empty(spark))) == []
    assert rows(neardup.drop_near_duplicates(empty(spark))) == []


def test_alignment_is_the_longest_common_run():
    rnd = random.Random(3)
    for _ in range(200):
        a = [rnd.randint(0, 30) for _ in range(rnd.randint(0, 60))]
        b = [x for x in a if rnd.random() > 0.03]
        if rnd.random() < 0.3:
            at = rnd.randint(0, len(b))
            b = b[at:] + b[:at]
        one, two = (neardup.shingles(np.array(x, np.uint64)) for x in (a, b))
        want = similarity(labelled(a), labelled(b))
        assert neardup.aligned(one, two) == pytest.approx(want if want >= 0.8 else 0.0)


# Lines

def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(diagonal + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edit_distance():
    rnd = random.Random(4)
    for _ in range(300):
        a = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 80)))
        b = "".join(c for c in a if rnd.random() > 0.1) + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5)))
        assert linededup.edit_distance(a, b) == plain_distance(a, b)


def simhash(words):
    hasher = common.WordHasher()
    words = [w for w in words if len(w.encode()) >= linededup.TELLING_BYTES] or words
    total = [0] * 64
    _, h, _ = next(hasher.texts(pa.array([" ".join(words)])))
    for x in h.tolist():
        for bit in range(64):
            total[bit] += 1 if x >> bit & 1 else -1
    return sum(1 << bit for bit in range(64) if total[bit] > 0)


def without_copies(source):
    """Texts after the first occurrence of each group of similar lines; source in order of id."""
    lines = [(i, n, line) for i, text in source for n, line in enumerate((text or "").split("\n"))]
    known, places = {}, defaultdict(list)
    for i, n, line in lines:
        words = words_of(line)
        if words and len(line) >= linededup.LEAST_CHARS:
            key = " ".join(words)
            known.setdefault(key, (len(known), simhash(words)))
            places[key].append((i, n))
    root = {number: number for number, _ in known.values()}
    keys = list(known)
    hashes = np.array([known[k][1] for k in keys], np.uint64)
    for x, a in enumerate(keys):
        near = np.flatnonzero(np.bitwise_count(hashes[x + 1:] ^ hashes[x]) <= linededup.MOST_BITS) + x + 1
        for y in near.tolist():
            if plain_distance(a, keys[y]) <= (1 - linededup.SIMILARITY) * max(len(a), len(keys[y])) + 1e-9:
                union(root, x, y)
    stays, gone = {}, set()
    for x, key in enumerate(keys):
        for place in places[key]:
            group = find(root, x)
            stays[group] = min(stays.get(group, place), place)
    for x, key in enumerate(keys):
        gone |= {p for p in places[key] if p != stays[find(root, x)]}
    return {i: text if text is None else "\n".join(
        line for n, line in enumerate(text.split("\n")) if (i, n) not in gone) for i, text in source}


def variants():
    base = "a rather long line that many documents share with one word or another changed in it by hand or by a machine " \
           "so that no two copies are quite alike but all of them are read as the same line by those who read it number"
    rnd = random.Random(6)
    for i in range(60):
        words = base.split(" ")
        if i % 3:
            words[rnd.randrange(len(words))] = "other"
        yield 5000 + i, f"own text of document {i} which nobody else has got {rnd.random()}\n{' '.join(words).title()}, {i % 2}\nshort"


def test_lines(spark):
    source = sorted([r[:2] for r in documents()] + list(variants()))
    want = without_copies(source)
    df = with_clashes(spark.createDataFrame(source, "doc_id long, text string").repartition(4)
                      .withColumn("n_chars", F.length("text").cast("long")))
    got = linededup.drop_duplicate_lines(df)
    assert got.columns == df.columns
    collected = got.collect()
    assert {r.doc_id: r.text for r in collected} == want
    assert all(r.n_chars == len(r.text) for r in collected)
    # Copies with a changed word are found as well: most of the 60 lines are gone.
    assert sum("rather long line" in want[5000 + i].lower() for i in range(60)) < 25


def test_lines_of_odd_rows(spark):
    df = with_clashes(odd(spark))
    got = linededup.drop_duplicate_lines(df)
    assert got.columns == df.columns and got.count() == len(odd_rows())
    texts = defaultdict(list)
    for r in got.collect():
        texts[r.doc_id].append(r.text)
    assert texts[0] == [None] and texts[1] == [""] and texts[3] == ["\n\n"]
    # Rows that repeat id and text are cut alike; of equal lines the smallest id's stays.
    assert texts[14] == ["same text in several rows " * 6] * 2 and texts[15] == [""] and texts[16] == [""]
    assert rows(linededup.drop_duplicate_lines(empty(spark))) == []


def simhash_of(lines):
    _, words, bounds, sizes = next(common.WordHasher().sized_texts(pa.array(lines)))
    return linededup.simhashes(*linededup.telling(words, bounds, sizes))


def test_all_pairs_of_a_large_bucket_of_lines(spark):
    # Four of eight words are the same one, so that the others change few bits.
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14))
    other = lambda: [word() for _ in range(4)]
    text = lambda words: " ".join(["base"] * 4 + words)
    unlike, pairs = [text(other()) for _ in range(600)], []
    while len(pairs) < 20:
        own = other()
        a, b = text(own), text([*own[:3], word()])
        apart = int(np.bitwise_xor(*simhash_of([a, b])))
        blocks = sum((apart >> shift & (1 << size) - 1) > 0 for shift, size in linededup.BLOCKS)
        if apart.bit_count() == blocks == 3 and linededup.similar(a, b):
            pairs.append((a, b))
    first = [a for a, _ in pairs] + unlike
    lines = first + [b for _, b in pairs]
    hashes = simhash_of(lines)
    alike = [(x, y) for x in range(len(lines)) for y in range(x + 1, len(lines))
             if (hashes[x] ^ hashes[y]).item().bit_count() <= linededup.MOST_BITS and linededup.similar(lines[x], lines[y])]
    assert alike == [(x, len(first) + x) for x in range(20)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in linededup.drop_duplicate_lines(df).collect()}
    assert got == {i: line if i < len(first) else "" for i, line in enumerate(lines)}


def test_lines_that_differ_in_short_words(spark):
    # All have one SimHash; what is found does not depend on how many there are. Held against edit similarity alone.
    rnd = random.Random(12)
    lines = ["invoice " + " ".join(str(rnd.randint(100, 999)) for _ in range(4)) for _ in range(150)]
    lines += [line[:-1] + str((int(line[-1]) + 1) % 10) for line in lines[50:80]]
    root = {i: i for i in range(len(lines))}
    for x in range(len(lines)):
        for y in range(x + 1, len(lines)):
            if linededup.edit_distance(lines[x], lines[y]) <= 0.2 * max(len(lines[x]), len(lines[y])) + 1e-9:
                union(root, x, y)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in linededup.drop_duplicate_lines(df).collect()}
    assert got == {i: line if find(root, i) == i else "" for i, line in enumerate(lines)}


def test_families_of_hashes():
    # Keys that a few hashes share and one that many do; near hashes are joined, and no pair is returned twice.
    rng = np.random.default_rng(15)
    flip = lambda h, n: h ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, n, replace=False)))
    alone = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    chain = [alone[0]]
    for _ in range(400):
        chain.append(flip(chain[-1], int(rng.integers(1, 4))))
    crowd = [flip(alone[1], int(rng.integers(0, 2))) for _ in range(300)]
    hashes = np.unique(np.concatenate([alone, chain, crowd, [flip(h, 3) for h in alone[2:40]]]))
    root = {i: i for i in range(len(hashes))}
    for i in range(len(hashes)):
        for j in (np.flatnonzero(np.bitwise_count(hashes[i + 1:] ^ hashes[i]) <= linededup.MOST_BITS) + i + 1).tolist():
            union(root, i, j)
    blocks = range(len(linededup.BLOCKS) - 1)
    links = linededup._near_links(pa.table({"simhash": np.tile(hashes.view(np.int64), len(blocks)), "block": np.repeat(blocks, len(hashes))}))
    place = {h: i for i, h in enumerate(hashes.view(np.int64).tolist())}
    got = {i: i for i in range(len(hashes))}
    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist()):
        union(got, place[a], place[b])
    assert [find(got, i) for i in got] == [find(root, i) for i in root]
    assert len(links) == len(hashes) - len({find(root, i) for i in root})


def test_lines_with_leaders(spark):
    # Punctuation and indentation have no part in the length that is compared.
    lines = ["Chapter one about the long winding river 12 " + "." * 60, "Chapter one about the long winding river 13",
             "\t" * 70 + "Überblick zu langen Flüssen Nr 4", "Überblick zu langen Flüssen Nr 5"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.drop_duplicate_lines(df).collect()}
    assert got == {0: lines[0], 1: "", 2: lines[2], 3: ""}


# Vectors

def linked(ids, x, least=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    root = {i: i for i in ids}
    for a, b in zip(*np.nonzero(near)):
        union(root, ids[a], ids[b])
    return {i: (int(n) - 1, find(root, i)) for i, n in zip(ids, near.sum(axis=1))}


@pytest.mark.parametrize("block_rows", [4096, 150])
def test_vectors(spark, block_rows):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 64))
    # Copies, close and borderline neighbours, a chain, and scaled copies.
    x[100:200] = x[0] + 0.2 * rng.standard_normal((100, 64))
    x[200:260] = x[1]
    x[260:300] = x[2:42] + rng.uniform(0.3, 0.6, (40, 1)) * rng.standard_normal((40, 64))
    x[300:310] = x[3] * rng.uniform(0.1, 1000, (10, 1))
    ids = [int(i) for i in rng.permutation(600) * 3]
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist())], "vec_id long, embedding array<double>")
    got = rows(vectors.near_duplicates(with_clashes(df.repartition(4)), block_rows=block_rows))
    want = linked(ids, x)
    assert {r[0]: r[1:3] for r in got} == want
    assert all(kept == (i == c) for i, _, c, kept in got)


def test_vectors_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    pairs = df.select("vec_id", "embedding").collect()
    got = rows(vectors.near_duplicates(df))
    want = linked([r[0] for r in pairs], np.array([r[1] for r in pairs], np.float64))
    assert {r[0]: r[1:3] for r in got} == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    source = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]),
              (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0]), (11, [1e300, 1e299]), (1, [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(source, "vec_id long, embedding array<double>").repartition(3)
    got = rows(vectors.near_duplicates(with_clashes(df)))
    linked_rows = [(i, 4, 1, i == 1) for i in (1, 1, 2, 10, 11)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)] + [(None, 0, None, True)]
    assert got == sorted(linked_rows + alone, key=repr)
    assert rows(vectors.near_duplicates(df.limit(0))) == []


def test_calibrated_recall():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal((4000, 64))
    other -= (other * a).sum(axis=1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.9001 * a + (1 - 0.9001 ** 2) ** 0.5 * other
    found = {(int(i), int(j)) for x, y in vectors.linked_pairs(a, b, False) for i, j in zip(x, y)}
    assert sum((i, i) in found for i in range(4000)) >= 0.999 * 4000
