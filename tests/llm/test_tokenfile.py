import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pairsift.llm import tokenfile as TF
from pairsift.llm.common import stage_path
from pairsift.llm.queries import LIBRARY_FILE, op2_token_files

from .data import SMALL, have_tables, odd_documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**32 - 1)), min_size=1, max_size=3000), st.integers(1, 7))
def test_round_trip(values, lanes):
    TF.LANES, kept = lanes, TF.LANES
    try:
        values = np.array(values, np.uint32)
        table = TF.Table.count(values)
        assert int(table.scaled.sum()) == 1 << table.bits and table.scaled.min() >= 1
        states, words = TF.encode_block(values, table)
        assert (TF.decode_block(states, words, len(values), table) == values).all()
    finally:
        TF.LANES = kept


def test_size_nears_entropy_and_damage_is_seen():
    rng = np.random.default_rng(1)
    values = np.minimum(rng.geometric(0.02, 600_000), 5000).astype(np.uint32)
    row = TF.segment_row(0, 0, [1], [len(values)], values).to_pylist()[0]
    n = np.unique(values, return_counts=True)[1] / len(values)
    size = sum(len(b["words"]) + len(b["states"]) for b in row["blocks"])
    assert size < 1.08 * len(values) * -(n * np.log2(n)).sum() / 8
    assert len(row["blocks"]) == 3 and (TF.segment_ids(row) == values).all()
    words = bytearray(row["blocks"][1]["words"])
    words[40] ^= 1
    row["blocks"][1]["words"] = bytes(words)
    with pytest.raises(ValueError, match="block 1"):
        TF.segment_ids(row)


def check(spark, docs, got):
    library = Tokenizer.from_file(LIBRARY_FILE)
    start = 0
    for d, r in zip(docs, got):
        ids = [*library.encode(d[1] or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_library_settings_and_store(monkeypatch):
    library = Tokenizer.from_file(LIBRARY_FILE)
    coder = TF.Library(LIBRARY_FILE)
    monkeypatch.setattr(TF, "REMEMBERED", 40)
    monkeypatch.setattr(TF, "JOINED", 7)
    rng = np.random.default_rng(3)
    signs = list("abcXYZ 0129  \n\t'é漢.,!") + ["<|endoftext|>", " the", "\U0001f600", " can't"]
    for _ in range(60):
        texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(rng.integers(1, 9))]
        texts += ["a <|endoftext|> b", "x" * 300, "y" * 150 + " " + "z" * 101, ""]
        got = [np.frombuffer(x, np.uint32).tolist() for x in coder.encode_batch(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert max(map(len, coder.known), default=0) <= TF.SHORT and len(coder.known) < 40 + 400
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_odd_rows(spark, monkeypatch):
    docs = odd_documents(spark)
    path = stage_path(spark, "tokens")
    TF.write(docs, path, LIBRARY_FILE, 2)
    got = TF.checksums(spark, path).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: -1 if r[0] is None else r[0])
    check(spark, want, got)
    read = TF.read(spark, path).collect()
    assert sorted(len(r.ids) for r in read) == sorted(r.n_tokens for r in got)
    path = stage_path(spark, "tokens")
    TF.write(docs.limit(0), path, LIBRARY_FILE, 2)
    assert TF.checksums(spark, path).count() == 0


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    got = op2_token_files(spark, SMALL).orderBy("start").collect()
    assert len(got) == len(docs)
    check(spark, docs, got)
