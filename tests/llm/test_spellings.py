"""Spelling variants against a comparison of all words with all others."""

import random
import re
import zlib
from collections import Counter

import pytest
from edge import documents, empty, odd, odd_rows, rows, with_clashes

from flowguard.llm import spellings

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def count_words(source):
    n = Counter()
    for doc_id, text in source:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(FOLD)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def expected(n):
    form, near = {}, {}
    for w in n:
        own = [v for v in n if one_edit(w, v)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if own and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], near[w], n.get(form[w])


def test_variants(spark):
    rnd = random.Random(8)
    short = ["".join(rnd.choice("abé") for _ in range(rnd.randint(4, 8))) for _ in range(60_00)]
    chain = ["aaaaaaaa " * 3 + "aaaaaaab " * 6 + "aaaaaabb " * 12 + "aaaaabbb " * 24 + "ties1 tiesa tiesb " * 4 + "tiesc " * 3, None, ""]
    source = [r[:2] for r in documents()] + [(10_000 + i, " ".join(short[i::30])) for i in range(30)] \
        + [(20_000 + i, t) for i, t in enumerate(chain)]
    df = spark.createDataFrame(source, "doc_id long, text string").repartition(5)
    want = sorted(expected(count_words(source)), key=repr)
    assert rows(spellings.variants(with_clashes(df))) == want
    assert sum(w[4] > 0 for w in want) > 500 and any(w[1] and w[1] != w[2] for w in want)


def test_odd_and_empty_tables(spark):
    assert rows(spellings.variants(with_clashes(odd(spark)))) == sorted(expected(count_words([r[:2] for r in odd_rows()])), key=repr)
    assert rows(spellings.variants(empty(spark))) == []


@pytest.mark.parametrize("size", [5, 6, 7, 9])
def test_every_edit_is_met(spark, size):
    rnd = random.Random(size)
    word = "".join(rnd.choice("ab") for _ in range(size))
    around = {word} | {word[:i] + c + word[i + 1:] for i in range(size) for c in "abx"} | {word[:i] + c + word[i:] for i in range(size + 1) for c in "abx"} \
        | {word[:i] + word[i + 1:] for i in range(size)}
    df = spark.createDataFrame([(w, 3, len(w)) for w in around], "word string, n long, size int")
    got = [(r.word, r.other) for r in spellings.near_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in around for b in around if one_edit(a, b)}
