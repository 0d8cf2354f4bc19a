import numpy as np
import pytest

from pairsift.llm import langid
from pairsift.llm.queries import op3_language_id

from .brute import held_out
from .data import SMALL, have_tables, odd_documents


def plain_bits(text, training, order=3):
    """Code length of a text by dictionaries instead of tables."""
    tree = {}
    for t in training:
        data = b"\n" * order + langid._fold(t)
        for i in range(order, len(data)):
            for k in range(order + 1):
                node = tree.setdefault(data[i - k : i], {})
                node[data[i]] = node.get(data[i], 0) + 1
    total, data = 0.0, b"\n" * order + langid._fold(text)
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            node = tree.get(data[i - k : i])
            if not node:
                continue
            n, kinds = sum(node.values()), len(node)
            if data[i] in node:
                total -= np.log2(node[data[i]] / (n + kinds))
                break
            total -= np.log2(kinds / (n + kinds))
        else:
            total += 8
    return total


def test_exact_code_lengths():
    training = {"a": ["the of and to in", "that is a be it"], "b": ["der die und das", "ist nicht Ünd"]}
    counts = {}
    for k, texts in training.items():
        gram, n = np.unique(np.concatenate([langid._grams(langid._fold(t)) for t in texts]), return_counts=True)
        counts[k] = (gram, n)
    trees = langid.Trees(counts)
    for text in ("the und that", "xyz", "nicht der of", "Ü" * 5):
        assert np.allclose(trees.lengths(text), [plain_bits(text, training[k]) for k in trees.languages], rtol=1e-5)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    model = langid.fit(docs)
    got = langid.predict(docs, model)
    assert got.count() == 11 and set(docs.columns) <= set(got.columns)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score > 0))
    assert by[2] == by[3] == by[4] == by[8] == {("und", False)}
    assert by[5] == {("en", True)} and by[None] == {("de", True)}
    left = langid.keep_language(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 5, 6, 9, 10, None}
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_numbers_are_no_letters(spark):
    model = langid.fit(odd_documents(spark))
    rows = spark.createDataFrame([(1, "½ ² Ⅷ 12 _"), (2, "½ a")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predict(rows, model).collect()} == {1: True, 2: False}


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op3_language_id(spark, SMALL).collect()
    assert len(got) == len(docs) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    judged = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean(judged) > 0.95
