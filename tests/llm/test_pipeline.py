"""The pipeline against plain versions of its stages, each on what its predecessor kept."""

import public_tokenizers
import pytest

import corpus_pipeline as CP
from pairsift.llm import bpe, decontam as D

from .brute import near_documents, overlaps, sha
from .data import FOLDER, have_tables
from .test_lines import brute as without_repeats


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    want = {r.doc_id: r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    for name, stage in CP.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        if name == "line_dedup":
            want = without_repeats(sorted(want.items()))
        elif name == "near_dedup":
            found = near_documents(sorted(want.items()), 5, 80)
            want = {i: t for i, t in want.items() if found[i][1] == i}
        elif name == "decontamination":
            bad = overlaps(sorted(want.items()), items, D.SPAN, D.STRIDE, D.SPARE, D.LEAST)
            want = {i: t for i, t in want.items() if i not in bad}
        got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
        assert got == {i: (t, len(t)) for i, t in want.items()}, name

    codec = bpe.Codec(CP.BPE_RANKS, public_tokenizers.PATTERN)
    last = CP.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert len(last) == len(want)
    for r in last:
        ids = codec.encode(want[r.doc_id]).tolist()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(want[r.doc_id].encode()))


def test_repeated_and_missing_ids(spark, tmp_path):
    """No stage takes a text for another of its id, or of none."""
    a = "the cat and the dog went to the house in the town and it was good"
    other = ["we like to read of ships that sail on the open sea at night", "a long letter from the north came to the old man this morning"]
    rows = [(1, a), (5, a), (5, other[0]), (None, a), (None, other[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in CP.STAGES[1:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(5, other[0]), (None, other[1])} <= left and {t for _, t in left} == {a, "", *other}
