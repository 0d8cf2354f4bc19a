import random

import numpy as np
import pytest

from pairsift.llm import minhash
from pairsift.llm.queries import op8_minhash

from .brute import near_documents
from .data import SMALL, have_tables, odd_documents


def check(got, docs, k):
    want = near_documents(docs, k, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges_and_chains(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = []
    for i in range(150):  # a chain that drifts, so that only neighbours are near
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = f"v{rng.randrange(10**6)}"
        docs.append((i, " ".join(base)))
    docs += [(200, "a b c d e f"), (201, "a b c d e"), (202, "a b"), (203, "A  b"), (204, "a"), (205, "A"), (206, ""), (207, None)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80).collect()
    check(got, docs, 2)


def test_leader_that_fails(spark):
    """b and c are near each other but not near the smallest id of their buckets."""
    rng = random.Random(4)
    a = [f"w{i}" for i in range(300)]
    docs = [(0, " ".join(a))]
    for i in range(1, 40):
        b = list(a)
        for j in range(26 if i % 2 else 40):
            b[j * 7] = f"x{i % 5}_{j}"
        b[299] = f"y{i}"
        docs.append((i, " ".join(b)))
    rng.shuffle(docs)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80).collect()
    check(got, docs, 2)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 40, 300, 5000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for change in (0, 1, n // 9, n):
            y = np.unique(np.concatenate([x[change:], rng.integers(0, 2**64, change, dtype=np.uint64)]))
            bits = np.bitwise_count((minhash.parity(x) ^ minhash.parity(y)).view(np.uint64)).sum()
            assert bits <= len(np.setxor1d(x, y))


def test_crowd_with_outsiders(spark):
    """A large group of near copies, and copies just too far from most of it."""
    rng = random.Random(6)
    base = [f"w{i % 150}" for i in range(200)]
    docs = []
    for i in range(160):
        words = list(base)
        for _ in range(4 if i % 3 else 16):
            words[rng.randrange(200)] = f"w{rng.randrange(150)}"
        docs.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80).collect()
    check(got, docs, 2)
    assert 1 < len({r.component_id for r in got}) < 160


def test_small_sets_under_a_foreign_leader(spark):
    """Similar pairs of 4-10 shingles whose bucket leader is near neither; their samples differ a lot."""
    known = [  # 61 to 69 of 256 samples differ between the first 5 and all 6 words
        "w323818 w279037 w713166 w991556 w498989 w873485", "w966279 w612313 w259485 w715581 w399395 w321209",
        "w845257 w58223 w680379 w273011 w822955 w92362", "w933102 w29643 w595664 w781282 w695701 w463969",
    ]
    rng = random.Random(8)
    words = [x.split() for x in known]
    words += [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 12))] for _ in range(60)]
    docs = []
    for w in words:
        docs += [(len(docs) + i, " ".join(w[:n])) for i, n in enumerate((3 * len(w) // 4, len(w) - 1, len(w)))]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 2, 80).collect()
    check(got, docs, 2)


def test_odd_rows(spark):
    got = minhash.near_duplicates(odd_documents(spark), 2, 80).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert by[1] == {(9, 1, True)} and by[10] == {(9, 1, False)}
    assert by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)} and by[4] == {(0, 4, True)}
    assert by[5] == {(2, 5, True)} and by[6] == {(2, 5, False)}
    assert by[None] == {(8, None, False)}
    empty = minhash.near_duplicates(odd_documents(spark).limit(0), 5, 80)
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a = "one two three four five six seven eight nine ten"
    rows = [(1, a), (5, a), (5, "no other row has these words in it"), (None, a), (None, "nor is there any row like this one")]
    left = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted((rows[0], rows[2], rows[4]), key=str)


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(op8_minhash(spark, SMALL).collect(), docs, 2)
