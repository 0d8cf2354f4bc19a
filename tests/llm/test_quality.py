import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsift.llm import quality as Q
from pairsift.llm.queries import op6_quality

from .brute import held_out
from .data import FOLDER, SMALL, have_tables, odd_documents


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, Q.STATISTICS))
    z = Q.cosines(x, np.zeros(Q.STATISTICS), np.ones(Q.STATISTICS))[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = np.exp(-far / (2 * Q.WIDTH**2 * Q.STATISTICS))
    assert np.abs(z @ z.T - want).mean() < 0.08


def test_isotonic():
    x, y = Q.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 8, 3, 10]), np.array([10.0, 10, 10, 10]))
    assert (np.diff(y) >= 0).all() and y[1] == y[2] == pytest.approx(11.5 / 21)


def test_sums_over_partitions_are_exact(spark):
    rng = np.random.default_rng(4)
    x, label, fold = rng.normal(size=(90, Q.STATISTICS)), rng.integers(0, 2, 90), rng.integers(0, Q.FOLDS, 90)
    rows = spark.createDataFrame([(a.tolist(), float(b), int(c)) for a, b, c in zip(x, label, fold)], "stats array<double>, label double, fold long").repartition(5)
    centre, spread = x.mean(0), x.std(0)
    got = Q.normal_equations(rows, centre, spread)
    z = np.hstack([Q.cosines(x, centre, spread), label[:, None]])
    for f in range(Q.FOLDS):
        assert np.allclose(got[f], z[fold == f].T @ z[fold == f])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    stats = Q.add_statistics(docs)
    assert Q.fit(stats.limit(0).withColumn("label", F.lit(1))) == {"constant": 0.5}
    model = Q.fit(stats.withColumn("label", F.lit(1)))
    assert {r.score for r in Q.score(stats, model).collect()} == {1.0}
    model = Q.fit(stats.withColumn("label", F.when(F.col("doc_id") == 5, 0).when(F.col("doc_id") != 1, 1)))
    got = Q.score(stats, model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert Q.score(stats.limit(0), model).count() == 0


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = op6_quality(spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in judged]) > 0.9
    assert op6_quality(spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
