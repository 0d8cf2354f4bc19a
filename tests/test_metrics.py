from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsift.operators import agg as A, metrics as M, pairs as P, quality as Q, rank as K, resample as R
from pairsift.plans import ml
from pairsift.schema import EVIDENCE_SLOTS, FAMILIES, NO_EVIDENCE

COLS = "pair_id string, risk_score double, predicted_behavior string, " + ", ".join(f"{s} string" for s in EVIDENCE_SLOTS)


def table(spark, risks, families, hands):
    return spark.createDataFrame(
        [(p, r, f, h, *[NO_EVIDENCE] * 4) for p, r, f, h in zip("abcd", risks, families, hands)], COLS)


@pytest.fixture(scope="module")
def truth(spark):
    return table(spark, (1.0, 1.0, 1.0, 0.0), [*FAMILIES, "none"], ("h1", "h2", "h3", NO_EVIDENCE))


def test_perfect_score(spark, truth):
    sub = table(spark, (.99, .98, .97, .01), [*FAMILIES, "none"], ("h1", "h2", "h3", NO_EVIDENCE))
    got = M.composite_score(truth, sub).first()
    assert [got[c] for c in ("pair_ap", "evidence_map5", "behavior_map", "score")] == pytest.approx([1.0] * 4)
    assert Q.validate_submission(sub, truth).where("breaches > 0").count() == 0


def test_zero_family_tie(spark, truth):
    sub = table(spark, (.9, .8, .7, .1), [*FAMILIES[:2], "none", "none"], ("h1", "h2", "h3", NO_EVIDENCE))
    assert M.composite_score(truth, sub).first()["behavior_map"] == pytest.approx(7 / 9)


def test_repeated_slot_is_reported(spark, truth):
    sub = table(spark, (.9, .8, .7, .1), [*FAMILIES, "none"], ("h1", "h2", "h3", NO_EVIDENCE))
    sub = sub.withColumn("evidence_hand_2", F.when(F.col("pair_id") == "a", F.lit(" h1 ")).otherwise(F.col("evidence_hand_2")))
    bad = Q.validate_submission(sub, truth).where("breaches > 0").collect()
    assert [(r["rule"], r["breaches"]) for r in bad] == [("repeated_slot", 1)]


def test_membership(spark):
    legal = spark.createDataFrame([("p", f"h{i}") for i in range(1, 6)], "pair_id string, hand_id string")
    sub = spark.createDataFrame([("p", .5, "none", "h1", "h2", "h3", "h4", "h5")], COLS)
    assert Q.membership_summary(sub, legal).first().asDict() == {
        "submitted_evidence_hands": 5, "legal_evidence_hands": 5, "pairs_with_all_slots": 1}
    wrong = sub.withColumn("evidence_hand_5", F.lit("not_shared"))
    assert Q.illegal_members(wrong, legal).count() == 1


def plain_ap5(y):
    y = np.asarray(y, dtype=float)
    top = y[:5]
    return float((np.cumsum(top) / np.arange(1, len(top) + 1) * top).sum() / min(y.sum(), 5)) if y.sum() else 0.0


def test_expected_tie_ap_all_shapes(spark):
    """Closed form against every order inside the ties, one and two blocks of up to four rows."""
    blocks = [(n, r) for n in range(1, 5) for r in range(n + 1)]
    cases = [[b] for b in blocks] + [[a, b] for a in blocks for b in blocks if a[0] + b[0] <= 6]
    rows, want = [], {}
    for i, case in enumerate(cases):
        parts = [[1] * r + [0] * (n - r) for n, r in case]
        for s, part in enumerate(parts):
            rows += [(i, y, float(-s)) for y in part]
        orders = [[]]
        for part in parts:
            orders = [o + list(p) for o in orders for p in permutations(part)]
        want[i] = np.mean([plain_ap5(o) for o in orders])
    df = spark.createDataFrame(rows, "q int, y int, s double")
    got = {r["q"]: r["query_ap5"] for r in M.expected_tie_ap(df, "q", "y", "s").collect()}
    assert len(cases) > 55 and max(abs(got[i] - want[i]) for i in want) < 1e-12


def test_top_five_by_time(spark):
    df = spark.createDataFrame([("q", f"h{i}", i, 0.0 if i == 0 else 1.0) for i in range(6)], "pair_id string, hand_id string, started_at int, s double")
    got = K.top_k_strict(df, "pair_id", "s", "started_at").orderBy("rank")
    assert [r["hand_id"] for r in got.collect()] == ["h1", "h2", "h3", "h4", "h5"]
    tied = df.withColumn("started_at", F.when(F.col("started_at") == 2, 1).otherwise(F.col("started_at")))
    with pytest.raises(Q.QualityError):
        K.top_k_strict(tied, "pair_id", "s", "started_at")


def test_robust_transform(spark):
    cols = [f"c{j}" for j in range(5)]
    data = [[float(5 * i + j) for j in range(5)] for i in range(12)]
    data[0][0], data[1][1] = None, float("inf")
    for r in data:
        r[4] = 7.0
    df = spark.createDataFrame([tuple(r) for r in data], ", ".join(f"{c} double" for c in cols))
    params = A.fit_robust(df, cols)
    got = {r["feature"]: r for r in params.collect()}
    assert got["c4"]["iqr"] == 1.0 and got["c2"]["center"] == pytest.approx(np.median([r[2] for r in data]))
    x = np.array([r[2] for r in data])
    lo, hi = np.quantile(x, [.01, .99])
    q1, q3 = np.quantile(np.clip(x, lo, hi), [.25, .75])
    assert got["c2"]["lower"] == pytest.approx(lo) and got["c2"]["iqr"] == pytest.approx(q3 - q1)
    out = A.apply_robust(df, params, cols).toPandas()
    assert np.isfinite(out.to_numpy()).all()


def test_preferences(spark):
    df = spark.createDataFrame(
        [("q1", 1, 3.0), ("q1", 1, 5.0), ("q1", 0, 1.0), ("q1", 0, 2.0), ("q2", 1, 1.0)], "q string, e int, x double")
    summary = {r["q"]: r["preference_pairs"] for r in P.preference_summary(df, "q", "e").collect()}
    assert summary == {"q1": 4, "q2": 0}
    both, one = (P.pairwise_preferences(df, "q", "e", ["x"], o) for o in ("both", "one"))
    assert both.count() == 8 and one.count() == 4
    assert both.agg(F.sum("weight")).first()[0] == pytest.approx(1.0) == one.agg(F.sum("weight")).first()[0]
    a, b = (ml.fit_pairwise_linear(p, ["x"], 10.0).coef[0] for p in (both, one))
    assert a == pytest.approx(b, rel=1e-4) and a > 0


def test_linear_ranker_minimises_the_stated_objective(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = (x @ [1.0, -0.5] + rng.normal(size=60) > 0).astype(int)
    w = rng.uniform(.5, 1.5, 60)
    df = spark.createDataFrame([(float(a), float(b), int(t), float(v)) for (a, b), t, v in zip(x, y, w)], "a double, b double, target int, weight double")
    got = np.array(ml.fit_pairwise_linear(df, ["a", "b"], 0.1, 500, 1e-12).coef)
    p = 1 / (1 + np.exp(-x @ got))
    grad = 0.1 * (x * (w * (p - y))[:, None]).sum(0) + got
    assert np.abs(grad).max() < 1e-4


def test_c_choice_takes_the_smaller_on_a_tie(spark):
    rows = [(c, f"q{i}", v) for c, v in ((.01, .3), (.1, .5), (1.0, .5), (10.0, .15)) for i in range(3)]
    got = ml.select_c(spark.createDataFrame(rows, "c double, pair_id string, query_ap5 double"))
    assert got.where("chosen = 1").first()["c"] == 0.1


def test_forbidden_feature(spark):
    with pytest.raises(ValueError):
        ml.with_features(spark.createDataFrame([(1.0,)], "pair_id double"), ["pair_id"])


def test_nested_folds_keep_pools_whole(spark, rows):
    df = spark.createDataFrame([(f"q{i}", f"t{i}", FAMILIES[i % 3], i % 5) for i in range(45)], "pair_id string, table_id string, behavior_family string, outer_fold int")
    inner = R.nested_folds(df, "outer_fold", "table_id", "behavior_family")
    got = rows(inner.groupBy("held_out").agg(F.count(F.lit(1)), F.count_distinct("table_id"), F.count_distinct("inner_fold")))
    assert got == [(f, 36, 36, 3) for f in range(5)]
    fam = inner.join(df, "table_id").groupBy("held_out", "inner_fold", "behavior_family").count()
    assert fam.agg(F.min("count"), F.max("count")).first() == (4, 4)


def test_coverage_and_zero_delta(spark):
    cells = [(f, k) for f in range(5) for k in FAMILIES]
    q = spark.createDataFrame([(f"q{i}", f"t{i}", f, k, .5, 1, 1) for i, (f, k) in enumerate(cells)],
                              "pair_id string, table_id string, outer_fold int, behavior_family string, query_ap5 double, candidate_hands int, evidence_hands int")
    tree = M.metric_tree(q)
    assert {(r["level"], r["queries"]) for r in tree.collect()} == {("overall", 15), ("family", 5), ("fold", 3), ("fold_family", 1), ("macro_family", 15)}
    short = M.metric_tree(q.where("pair_id <> 'q0'"))
    cell = lambda d: d.where("level = 'overall'").select("level", "queries")
    assert Q.coverage_violations(cell(short), cell(tree), ["level"], ["queries"]).count() == 1
    delta = q.withColumn("delta", F.lit(0.0))
    weights = R.cluster_weights(q, "table_id", "outer_fold", 50)
    low = R.sensitivity_tree(delta, R.weight_blocks(q, "table_id", "outer_fold", 50), 50)
    assert low.agg(F.max(F.abs("lower")), F.count_if(F.col("lower").isNull())).first() == (0.0, 0)
    per = weights.groupBy("draw", "outer_fold").agg(F.avg("weight").alias("m"))
    assert per.agg(F.max(F.abs(F.col("m") - 1))).first()[0] < 1e-9


def test_gate_needs_every_metric(spark):
    found = spark.createDataFrame([("ap_delta", 0.1)], "metric string, value double")
    got = {r["metric"]: r["passed"] for r in M.evaluate_gate(found, [("ap_delta", ">=", 0.0), ("lost", ">", 0.0)]).collect()}
    assert got == {"ap_delta": 1, "lost": 0, "overall": 0}


def test_extend_folds_keeps_every_pool(spark):
    """Fewer labelled pools than folds: fresh pools fill the folds without labels too."""
    from pairsift.operators import resample as R

    labelled = spark.createDataFrame([(i % 2, i) for i in range(9)], "pool long, x long")
    fresh = spark.createDataFrame([(p, i) for p in range(12) for i in range(p + 1)], "pool long, x long")
    folds = R.group_kfold(labelled, "pool", 5)
    got = {r.pool: r.fold for r in R.extend_folds(folds, labelled, fresh, "pool", 5).collect()}
    assert set(got) == set(range(12)) and set(got.values()) == set(range(5))


def test_shuffled_places_are_a_permutation(spark):
    """Each draw moves the places of a block onto themselves, evenly over many draws."""
    for n in (1, 2, 3, 10, 257):
        rows = spark.range(n).select(F.col("id").alias("j"), F.lit(n).cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(399))).alias("draw"))
        a, b = M.shuffle_keys(5, "draw", "n")
        pdf = rows.withColumns({"a": a, "b": b}).withColumn("x", M.shuffled_place(F.col("j"), F.col("n"), F.col("a"), F.col("b"))).toPandas()
        assert (pdf.groupby("draw")["x"].apply(sorted).map(lambda x: x == list(range(n)))).all()
        if n > 1:
            first = pdf[pdf["j"] == 0]["x"].to_numpy()
            assert abs(first.mean() - (n - 1) / 2) < 5 * n / np.sqrt(12 * 400) and len(set(first)) > min(n, 400) * 0.5


def test_random_ties_against_numpy_shuffles(spark):
    """Mean and spread over draws agree with plain shuffles of the tied rows."""
    rng = np.random.default_rng(4)
    score, y = np.sort(rng.integers(0, 6, 300))[::-1], rng.integers(0, 4, 300) == 0
    df = spark.createDataFrame([(i, float(s), int(v)) for i, (s, v) in enumerate(zip(score, y))], "id long, s double, y int")
    got = M.random_tie_ap(df, "y", "s", "id", draws=512).first()
    ap = []
    for _ in range(3000):
        order = np.lexsort((rng.random(300), -score))
        z = y[order]
        ap.append((np.cumsum(z) / np.arange(1, 301) * z).sum() / z.sum())
    assert abs(got["random_tie_mean_ap"] - np.mean(ap)) < 5 * np.std(ap) / np.sqrt(512)
    assert 0.8 < got["random_tie_std_ap"] / np.std(ap) < 1.25
    split = M.random_tie_ap(df, "y", "s", "id", draws=512, limit=20).first()
    assert np.allclose(list(got), list(split))


def test_bags_sort_little_more_than_they_take(spark):
    from pairsift.operators import resample as R

    rows = spark.range(40_000).selectExpr("id AS key", "id % 5 AS fold")
    known = spark.range(300).selectExpr("id % 5 AS fold", "CAST(id % 3 = 0 AS INT) AS label")
    reach = R._below_threshold(rows, known, "key", "fold", "label", 5, 5, 7401).groupBy("held_out", "bag").agg(F.count("key").alias("n"), F.max("wanted").alias("w")).collect()
    assert len(reach) == 25 and all(r.w <= r.n <= r.w + 12 for r in reach)
    taken = R.bag_sample(rows, known, "key", "fold", "label").groupBy("held_out", "bag").count().collect()
    assert {(r.held_out, r.bag): r["count"] for r in taken} == {(r.held_out, r.bag): r.w for r in reach}
    few = R.bag_sample(rows.where("key < 20"), known, "key", "fold", "label", bags=2).groupBy("held_out", "bag").count().collect()
    assert len(few) == 10 and all(r["count"] == 16 for r in few)


def test_draw_blocks_give_the_quantiles_of_single_draws(spark):
    from pairsift.operators import resample as R

    rng = np.random.default_rng(6)
    rows = [(f"q{i}", i % 7, i % 7 % 3, "ab"[i % 2], float(rng.normal())) for i in range(60)]
    delta = spark.createDataFrame(rows, "pair_id string, table_id long, outer_fold long, behavior_family string, delta double")
    weights = R.cluster_weights(delta, "table_id", "outer_fold", 70).toPandas()
    assert len(weights) == 70 * 7
    w = {(r.draw, r.table_id): r.weight for r in weights.itertuples()}
    got = {(r.level, r.family, r.fold): r for r in R.sensitivity_tree(delta, R.weight_blocks(delta, "table_id", "outer_fold", 70), 70).collect()}
    for key, keep in {("overall", None, None): lambda r: True, ("family", "a", None): lambda r: r[3] == "a", ("fold_family", "b", 2): lambda r: r[3] == "b" and r[2] == 2}.items():
        mine = [r for r in rows if keep(r)]
        v = [sum(w[d, r[1]] * r[4] for r in mine) / sum(w[d, r[1]] for r in mine) for d in range(70)]
        assert np.allclose([got[key].lower, got[key].upper, got[key].point_delta], [np.quantile(v, 0.05), np.quantile(v, 0.95), np.mean([r[4] for r in mine])])
