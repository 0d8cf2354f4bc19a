import numpy as np
import pytest

from pairsift.llm import embedjoin
from pairsift.llm.queries import op10_embedding_join

from .brute import near_vectors
from .data import SMALL, have_tables


def check(got, rows):
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == near_vectors(rows, 0.9)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_blocks_cells_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.25 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)]  # equal vectors
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [None] + [1.0] * 7), (2004, [float("nan")] * 8), (2005, [float("inf")] * 8),
             (2006, [1e300] * 8), (2007, [1e-300] * 8), (2008, [1.0, 0.0]), (2009, [2.0, -0.0]), (2010, [9.0, 4.358898943540674])]
    monkeypatch.setattr(embedjoin, "BLOCK", 32)
    got = embedjoin.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()
    check(got, [(i, v) for i, v in rows if i not in (2006, 2007)] + [(2006, [1.0] * 8), (2007, [1.0] * 8)])


def test_bound_is_a_metric_one():
    """No vector within the radius of a cell's member is left out of the cell."""
    rng = np.random.default_rng(6)
    v = embedjoin.unit(rng.normal(size=(600, 3)))
    pivots = embedjoin.unit(rng.normal(size=(9, 3)))
    home, sent = embedjoin.placements(v, pivots, 0.4472)
    near = v @ v.T >= 0.9
    assert all(sent[y, home[x]] for x, y in zip(*np.nonzero(near)))
    assert sent.mean() < 0.9  # some cells are left out


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (3, [1.0, 0.0], 3), (4, [0.0, 1.0], 4)], "vec_id long, embedding array<float>, cid int")
    got = embedjoin.range_join(rows, 0.9).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True)], key=str
    )
    assert embedjoin.range_join(rows.limit(0), 0.9).count() == 0


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(op10_embedding_join(spark, SMALL).collect(), rows)
