import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsift.llm import hmm as H
from pairsift.llm.queries import op12_hidden_markov

from .data import FOLDER, SMALL, have_tables, odd_documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    fold = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
    return [*WORD.findall((text or "").encode().translate(fold)), b""]


def model(z, emit, seed=1):
    rng = np.random.default_rng(seed)
    return H.Model(rng.dirichlet(np.ones(z)), rng.dirichlet(np.ones(z)), rng.dirichlet(np.ones(z), z), emit)


def paths(word_ids, emit, m, first):
    """(probability, path) of every sequence of states."""
    z = len(m.move)
    for path in itertools.product(range(z), repeat=len(word_ids)):
        p = first[path[0]]
        for t, s in enumerate(path):
            p *= emit[word_ids[t], s] * (m.move[path[t - 1], s] if t else 1)
        yield p, path


def test_likelihood_is_the_sum_over_paths():
    rng = np.random.default_rng(5)
    emit = rng.random((4, 3))
    m = model(3, emit)
    texts = [rng.integers(0, 4, n) for n in (1, 5, 3, 1)]
    got = H.likelihoods(np.concatenate(texts), np.array([len(t) for t in texts]), m)
    assert np.allclose(np.exp(got), [sum(p for p, _ in paths(t, emit, m, m.start)) for t in texts])


@pytest.mark.parametrize("length", [2, 7, 64])
def test_long_texts_by_the_plain_recursion(length, monkeypatch):
    monkeypatch.setattr(H, "TOGETHER", 5)
    cut = H.segments
    monkeypatch.setattr(H, "segments", lambda sizes: cut(sizes, length))
    rng = np.random.default_rng(6)
    emit = rng.random((30, 4)) ** 9 + 1e-12
    m = model(4, emit)
    texts = [rng.integers(0, 30, n) for n in (1, 3000, 64, 65, 127, 2)]
    want = []
    for t in texts:
        a, log = m.start, 0.0
        for i, w in enumerate(t):
            a = (a if i == 0 else a @ m.move) * emit[w]
            log, a = log + np.log(a.sum()), a / a.sum()
        want.append(log)
    assert np.allclose(H.likelihoods(np.concatenate(texts), np.array([len(t) for t in texts]), m), want)


def test_expected_counts_by_enumeration(monkeypatch):
    cut = H.segments
    monkeypatch.setattr(H, "segments", lambda sizes: cut(sizes, 4))
    rng = np.random.default_rng(7)
    emit = rng.random((5, 3))
    m = model(3, emit)
    texts = [rng.integers(0, 5, n) for n in (4, 1, 6)]
    out, moves, starts = H.expected(np.concatenate(texts), np.array([len(t) for t in texts]), m)
    w_out, w_moves, w_starts = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros((2, 3))
    for t in texts:
        for k, part in enumerate(t[i : i + 4] for i in range(0, len(t), 4)):
            every = list(paths(part, emit, m, m.start if k == 0 else m.go_on))
            total = sum(p for p, _ in every)
            for p, path in every:
                w_starts[min(k, 1), path[0]] += p / total
                for i, s in enumerate(path):
                    w_out[part[i], s] += p / total
                    if i:
                        w_moves[path[i - 1], s] += p / total
    assert np.allclose(out, w_out) and np.allclose(moves, w_moves) and np.allclose(starts, w_starts)


def trained(spark, folder, **kw):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    made = H.staged(H.blocks(docs, ~held, 20_000))
    counts = H.count_words(made)
    bodies = H.staged(H.coded(made, counts))
    return counts, bodies, H.fit(bodies, counts, **kw)


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_probabilities_add_up(spark):
    counts, bodies, m = trained(spark, FOLDER, passes=1)
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.emit[-1], 0.5 / counts.whole)
    assert np.isclose(m.start.sum(), 1) and np.allclose(m.move.sum(1), 1)
    # A rare word's share of its class makes its probability add up too.
    assert np.isclose(counts.mass.sum(), counts.tokens + 0.5 * counts.distinct)
    out, _, _ = H._summed(bodies, len(counts.mass), H.STATES, lambda f, s: H.expected(f, s, m))
    assert np.isclose(out.sum(), counts.tokens) and out[-1].sum() == 0


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_passes_raise_the_likelihood(spark):
    means = []
    for passes in (0, 1, 3):
        _, bodies, m = trained(spark, FOLDER, passes=passes)
        means.append(H.score(bodies, m).where("train").agg(F.sum("score")).first()[0])
    assert means == sorted(means)


def plain_base(docs):
    train = [zlib.crc32(str(i).encode()) % 5 != 1 if i is not None else True for i, _ in docs]
    c = Counter(w for (_, t), x in zip(docs, train) if x for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), x in zip(docs, train):
        w = tokens(t)
        out.append((i, not x, len(w), sum(k in c for k in w), n, sum(np.log10((c[k] + 0.5) / (n + 0.5 * (v + 1))) for k in w)))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


@pytest.mark.skipif(not have_tables(), reason="no tables")
@pytest.mark.parametrize("folder", [FOLDER, SMALL])
def test_query(spark, folder):
    got = [tuple(r) for r in op12_hidden_markov(spark, folder).collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    same(got, plain_base(docs))
    held = np.array([g[1] for g in got])
    size, base, score = (np.array([g[i] for g in got], float) for i in (2, 5, 6))
    assert np.isfinite(score).all() and (score < 0).all()
    for part in (held, ~held):
        assert score[part].sum() / size[part].sum() > base[part].sum() / size[part].sum() + 0.05


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = [tuple(r) for r in H.language_scores(docs, F.lit(True), passes=2, size=1).select(
        "doc_id", ~F.col("train"), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    want = [(i, False, *rest) for i, _, *rest in plain_base([(None, r.text) for r in docs.collect()])]
    want = [(r.doc_id, *w[1:]) for r, w in zip(docs.collect(), want)]
    same(got, want)
    assert np.isfinite([g[6] for g in got]).all()
    # Blocks of one text each give the scores of one block for all.
    whole = [tuple(r) for r in H.language_scores(docs, F.lit(True), passes=2).select("doc_id", "n_tokens", "score").collect()]
    assert np.allclose(sorted(g[6] for g in got), sorted(w[2] for w in whole))
    assert H.language_scores(docs.limit(0), F.lit(True)).count() == 0
    none = H.language_scores(docs, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in none} == {(0, 0, 0.0)}
    assert np.allclose([r.score for r in none], 0) and max(r.score for r in none) <= 0
