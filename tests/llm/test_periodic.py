import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pairsift.llm import periodic as P
from pairsift.llm.queries import op13_periodic_runs

from .data import FOLDER, SMALL, have_tables, odd_documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every maximal stretch with its smallest period, from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j - i + q), q)
            i = j
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    words = WORD.findall((text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return (
        doc_id, len(found), *(top or (None,) * 3), None if top is None else 1000 * top[1] // top[2],
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def numbers(words):
    return np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4))
def test_few_words(texts):
    assert P.runs([numbers(t) for t in texts]) == [plain_runs(t) for t in texts]


def test_every_period():
    rng = random.Random(3)
    for q in [*range(1, 40), 55, 90]:
        part = [rng.randrange(3) for _ in range(q)]
        text = [9, 8] + (part * 6)[: 4 * q + rng.randrange(q + 1)] + [7]
        assert P.runs([numbers(text)]) == [plain_runs(text)]


def test_every_lag_has_a_length():
    for n in (8, 100, 5000):
        covered = {}
        for g, low, high in P.levels(n):
            covered |= {d: g for d in range(low, high + 1)}
        assert sorted(covered) == list(range(1, n // 4 + 1))
        assert all(2 * d - 1 <= g <= P.least_matches(d) for d, g in covered.items())


def test_long_texts_take_little_time():
    same = np.full(400_000, 7, np.uint64)
    assert P.runs([same]) == [[(0, 400_000, 1)]]
    nested = numbers(([1] * 40 + [2]) * 10_000)
    found = P.runs([nested])[0]
    assert (0, 410_000, 41) in found and len(found) == 10_001


def test_ties_and_best():
    text = [1, 2] * 4 + [5] + [3, 4] * 4
    assert P.runs([numbers(text)]) == [[(0, 8, 2), (9, 8, 2)]]
    assert P.best([(0, 8, 2), (9, 8, 2)]) == (0, 8, 2, 4000)
    assert P.best([(0, 9, 2), (3, 13, 3)]) == (0, 9, 2, 4500)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    short = "text IS NULL OR length(text) < 8000"
    got = sorted(map(tuple, P.report(docs.where(short), plant=True).collect()), key=str)
    assert got == sorted((row(r.doc_id, r.text) for r in docs.where(short).collect()), key=str)
    assert {tuple(r)[1:6] for r in P.report(docs.where(f"NOT ({short})")).collect()} == {(1, 0, 60_000, 1, 60_000_000)}
    assert P.report(docs.limit(0)).count() == 0
    kept = P.collapse(P.detect(docs))
    assert set(docs.columns) < set(kept.columns)
    for r in kept.collect():
        if len(r.text or "") < 8000:
            assert r.text is None or hashlib.sha256(r.collapsed.encode()).hexdigest() == row(None, r.text)[-1]
        else:
            assert r.collapsed == "lang " + "x" * 5000


@pytest.mark.skipif(not have_tables(), reason="no tables")
@pytest.mark.parametrize("folder", [FOLDER, SMALL])
def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: row(r.doc_id, r.text) for r in docs if len(r.text or "") < 8000}
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, folder).collect()}
    assert got.keys() == {r.doc_id for r in docs}
    assert {i: got[i] for i in short} == short
