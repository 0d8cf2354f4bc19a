import random

import pytest

from pairsift.llm import decontam as D
from pairsift.llm.queries import op5_decontamination

from .brute import overlaps
from .data import FOLDER, have_tables, odd_documents

RULE = (D.SPAN, D.STRIDE, D.SPARE, D.LEAST)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: set(r.item_ids) for r in D.contaminated(d, i).collect()}


def test_substitutions(spark):
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 9, 12, 13, 30])))) for i in range(40)]
    items += [(100, items[5][1]), (101, items[6][1].upper())]
    docs = []
    for i in range(160):
        w = items[rng.randrange(40)][1].split()
        at = rng.randrange(max(1, len(w) - 11))
        w = w[at : at + rng.choice([8, 12, 16, 30])]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        docs.append((i, " ".join([f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(30))] + w + ["tail"] * rng.randrange(3))))
    assert run(spark, docs, items) == overlaps(docs, items, *RULE)


def test_masks_miss_no_two_substitutions():
    for span in range(D.LEAST, D.SPAN + 1):
        kept = [set(m.tolist()) for m in D.masks(span)]
        assert all(any(not m & {a, b} for m in kept) for a in range(span) for b in range(span))


def test_every_start_and_short_items(spark):
    """Passages of an item that start anywhere, with and without a substitution, and copies of short items."""
    words = [f"w{i}" for i in range(40)]
    items = [(0, " ".join(words))] + [(n, " ".join(f"s{n}_{i}" for i in range(n))) for n in range(1, 12)]
    docs = []
    for at in range(29):
        for n in (12, 13, 14):
            docs.append((len(docs), " ".join(words[at : at + n])))
        inside = words[at : at + 12]
        inside[at % 12] = "other"
        docs.append((len(docs), " ".join(["before", *inside, "after"])))
    for n, t in items[1:]:
        docs += [(1000 + n, t), (2000 + n, f"before {t} after"), (3000 + n, t.replace(f"s{n}_0", "other"))]
    got = run(spark, docs, items)
    assert got == overlaps(docs, items, 12, 1, 2, 1)
    assert all(got[d] == {0} for d, _ in docs if d < 1000) and all(got[k * 1000 + n] == {n} for n in range(1, 12) for k in (1, 2))
    assert {n for n in range(1, 12) if 3000 + n in got} == set(range(5, 12))


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "the of and to in is that a be it"), (3, "the of and to in is that a be it")], "item_id long, text string")
    docs = odd_documents(spark)
    got = {r.doc_id: (r.item_ids, r.n_windows) for r in D.contaminated(docs, items).collect()}
    assert got == {1: ([3], 1), 10: ([3], 1)}
    left = D.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, a), (5, a), (5, "no item has these words in it"), (None, a), (None, "nor is there any item like this one")]
    items = spark.createDataFrame([(3, a)], "item_id long, text string")
    left = D.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted((rows[2], rows[4]), key=str)


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {r.doc_id: set(r.item_ids) for r in op5_decontamination(spark, FOLDER).collect()} == overlaps(docs, items, *RULE)
