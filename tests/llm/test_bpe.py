import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from pairsift.llm import bpe
from pairsift.llm.queries import BPE_RANKS, op1_byte_bpe

from .brute import sha
from .data import SMALL, have_tables, odd_documents

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_RANKS, "rb"))}
KNOWN = tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(BPE_RANKS, public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sdabe.,12éß  ")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_as_the_library(texts):
    for text, ids in zip(texts, CODEC.encode_batch(texts)):
        assert ids.tolist() == KNOWN.encode_ordinary(text)
        assert CODEC.decode(ids) == text.encode()


def test_tree_and_steps_agree():
    for piece in (b"a", b"abababab", b"thnterononshth" * 4, b"\xff\xfe" * 30, b"mississippi", b"aaaaaaaa"):
        want = bpe.merge(piece, RANKS)
        if len(piece) <= bpe.TOGETHER and piece not in RANKS:
            assert CODEC._merge_all([piece, b"zz"], 64)[0] == b"".join(i.to_bytes(4, "little") for i in want)
        assert b"".join({v: k for k, v in RANKS.items()}[i] for i in want) == piece


def test_long_piece():
    text = "ab" * 20_000
    assert CODEC.encode(text).tolist() == KNOWN.encode_ordinary(text)


def test_unknown_id():
    with pytest.raises(ValueError):
        CODEC.decode(bpe.np.array([10**6]))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = bpe.round_trip(docs, BPE_RANKS, public_tokenizers.PATTERN).collect()
    want = docs.select("doc_id", "text").collect()
    assert len(got) == len(want)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == sorted((str(r.doc_id), (r.text or "").encode()) for r in want)
    assert bpe.digests(bpe.round_trip(docs.limit(0), BPE_RANKS, public_tokenizers.PATTERN)).count() == 0


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_query(spark):
    got = {r.doc_id: r for r in op1_byte_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = KNOWN.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((d.text or "").encode()))


def test_long_runs_are_not_remembered():
    coder = bpe.Codec(BPE_RANKS, public_tokenizers.PATTERN)
    got = coder.encode_batch(["a " + "b" * 500 + " c", "a " + "b" * 500])
    assert max(map(len, coder.known)) <= bpe.SHORT
    assert coder.decode(got[0]) == b"a " + b"b" * 500 + b" c"


def test_frequent_runs_outlive_a_full_store(monkeypatch):
    """When the store of runs is full, those in use are not encoded anew."""
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    codec, learnt = bpe.Codec(BPE_RANKS, public_tokenizers.PATTERN), []
    monkeypatch.setattr(codec, "_learn", lambda runs, learn=codec._learn: (learnt.extend(runs), learn(runs)))
    texts = [f"a common word and new{i} other{i}" for i in range(40)]
    got = [codec.encode(t) for t in texts]
    assert learnt.count("common") == 1
    assert [codec.decode(x).decode() for x in got] == texts
