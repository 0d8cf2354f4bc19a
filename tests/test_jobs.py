from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from catalog import models
from pairsift.operators import metrics as M, quality as Q, resample as R
from pairsift.plans import jobs as J, ml
from pairsift.sources import sinks, tables as T

from .fixtures import six_pools

TREES = ml.Trees(max_iter=3, depth=2, min_rows=1)


def test_submission_job(spark, tmp_path):
    t = six_pools(spark)
    out = J.build_submission(spark, t, str(tmp_path / "work"), TREES, 2, 5, ["transfer_any_bb", "net_gap_bb"])
    sub = out["submission"]
    assert sub.count() == 6
    hands = t["hands"].where("phase = 'evaluation'").select("hand_id")
    assert sub.join(hands, F.col("evidence_hand_1") == F.col("hand_id")).count() == 6
    found = {r["metric"]: r["value"] for r in out["diagnostics"].collect()}
    assert 0.0 <= found["cv_pair_ap"] <= 1.0 and found["labelled_pairs"] == 12 and found["active_pairs"] == 1
    kept = T.materialize(spark, lambda: t["hands"].where("false"), str(tmp_path / "work" / "submission"))
    assert Q.table_diff(sub, kept).count() == 0  # a finished stage is read, not rebuilt


def test_stages_are_rebuilt_when_stale_or_cut_short(spark, tmp_path):
    source, stage = str(tmp_path / "source"), str(tmp_path / "stage")
    built = []

    def make(n, k):
        def build():
            built.append(n)
            return spark.read.parquet(source).withColumn("k", F.lit(k))
        return T.materialize(spark, build, stage, {"rows": spark.read.parquet(source), "k": k}).count()

    spark.range(5).write.parquet(source)
    assert make("first", 1) == 5 and make("again", 1) == 5 and built == ["first"]
    assert make("other parameter", 2) == 5 and built == ["first", "other parameter"]
    spark.range(7).write.mode("append").parquet(source)
    assert make("new files", 2) == 12 and make("again", 2) == 12 and len(built) == 3
    (tmp_path / "stage" / T.MANIFEST).unlink()  # cut short after the data
    assert make("no manifest", 2) == 12 and len(built) == 4
    (tmp_path / "stage" / "_SUCCESS").unlink()  # cut short within the data
    assert make("half written", 2) == 12 and len(built) == 5
    inside = lambda n: T.inputs_manifest({"t": spark.range(n).selectExpr("id * 2 AS x")})
    assert inside(3) == inside(3) != inside(4)


def test_submission_keeps_labelled_pairs_without_hands(spark, tmp_path):
    t = six_pools(spark)
    lone = [("lone1", "g0p0", "g1p0", 1, "soft_play", "confirmed_target"), ("lone0", "g2p0", "g3p0", 0, "none", "confirmed_negative")]
    t["development_labels"] = t["development_labels"].union(spark.createDataFrame(lone, t["development_labels"].schema))
    out = J.build_submission(spark, t, str(tmp_path / "work"), TREES, 2, 5, ["transfer_any_bb", "net_gap_bb"])
    found = {r["metric"]: r["value"] for r in out["diagnostics"].collect()}
    assert found["labelled_pairs"] == 14 and found["positive_pairs"] == 7


@pytest.fixture(scope="module")
def planted(spark):
    """x separates the classes, z the families; pools are folded whole."""
    i = F.col("id")
    df = spark.range(240).select(
        i.cast("string").alias("key"), (i % 24).cast("string").alias("pool"), (i % 3 == 0).cast("int").alias("label"),
        F.when(i % 3 == 0, F.element_at(F.array(F.lit("a"), F.lit("b")), (F.floor(i / 24) % 2 + 1).cast("int"))).otherwise("none").alias("family"),
        (F.when(i % 3 == 0, 1.0).otherwise(0.0) + (i * 37 % 11) / 40).alias("x"), (F.floor(i / 24) % 2 * 2.0).alias("z"))
    return df.join(R.group_kfold(df, "pool", 3), "pool").cache()


def test_oof_risk_scores_each_row_once(planted):
    oof, ev = ml.oof_risk(planted, planted, ["x"], "label", "fold", TREES)
    assert oof.count() == 240 and oof.select("key").distinct().count() == 240 and ev.count() == 240
    assert M.average_precision(oof, "label", "risk", "key").first()[0] > 0.9


def test_one_class_uses_one_model(planted):
    oof, _ = ml.oof_risk(planted.where("label = 1").withColumn("label", F.lit(1)), None, ["x"], "label", "fold", ml.Trees(1, depth=1))
    assert oof.count() == 80


def test_family_routes_sum_to_one_and_hide_the_family(planted):
    out = ml.oof_family(planted, planted, ["z"], "fold", family="family", classes=["a", "b"], trees=TREES)
    assert "family" not in out.columns and out.count() == 240
    assert out.agg(F.max(F.abs(F.col("p_a") + F.col("p_b") - 1))).first()[0] < 1e-9
    hit = ml.routed(out, ["a", "b"]).join(planted.where("label = 1").select("key", "family"), "key")
    assert hit.agg(F.avg((F.col("predicted_route") == F.col("family")).cast("double"))).first()[0] > 0.95
    with pytest.raises(ValueError):
        ml.oof_family(planted, planted, ["z"], "fold", family="family", classes=["a", "missing"], trees=TREES)


def test_pu_learners(planted):
    known, latent = planted.where("cast(key as int) < 160"), planted.where("cast(key as int) >= 160").drop("label", "family")
    for a, b, name in (
        (*ml.bagged_pu(known, latent, ["x"], "label", "fold", "key", 2, TREES), "pu_score"),
        (*ml.elkan_noto(known, latent, ["x"], "label", "family", "fold", "pool", TREES), "pu_score"),
    ):
        assert a.count() == known.count() and b.count() == latent.count() and "label" not in b.columns
        assert M.average_precision(a, "label", name, "key").first()[0] > 0.8
        assert b.agg(F.min(name) >= 0, F.max(name) <= 1).first() == (True, True)


def test_hard_negative_and_global_ranking(planted):
    for scored in (ml.hard_negative(planted, [planted], ["x"], "label", TREES)[0],
                   ml.global_pairwise_risk(planted, [planted], ["x"], "label", "key")[0]):
        assert M.average_precision(scored, "label", "score", "key").first()[0] > 0.9


def test_time_transfer_columns(planted):
    out = ml.time_transfer(planted, planted, ["x"], "label", "fold", "key", TREES)
    assert out.count() == 240 and {"early_to_late", "late_to_early"} <= set(out.columns)


def test_time_transfer_equals_fits_one_after_another(planted):
    halves = {"early": planted, "late": planted.withColumn("x", F.col("x") + 0.2)}
    out = ml.time_transfer(*halves.values(), ["x"], "label", "fold", "key", TREES)
    ready = {k: ml.with_features(d, ["x"]) for k, d in halves.items()}
    for i, src in enumerate(ready):
        for j, f in enumerate(ml._folds(planted, "fold")):
            model = TREES.fit(ready[src].where(F.col("fold") != f), shift=20 * i + j)
            for dst in ready:
                alone = ml.score(model, ready[dst].where(F.col("fold") == f), "alone").select("key", "alone")
                gap = out.join(alone, "key").agg(F.count("key"), F.max(F.abs(F.col(f"{src}_to_{dst}") - F.col("alone")))).first()
                assert gap[0] == planted.where(F.col("fold") == f).count() and gap[1] < 1e-9


def test_time_transfer_query_fits_whole_models(spark, monkeypatch):
    """Every model of the query has the operator's own number and depth of trees."""
    asked, fit = [], ml.Trees.fit

    def one_tree(self, df, label="label", weight=None, shift=0):
        asked.append((self, shift))
        return fit(ml.Trees(1, depth=1), df, label, weight, shift)

    monkeypatch.setattr(ml.Trees, "fit", one_tree)
    i = F.col("id")
    hands = spark.range(600).select(
        (i % 60).cast("string").alias("pair_id"), (i % 5).cast("int").alias("outer_fold"), (F.floor(i / 60) / 10).alias("phase_progress"),
        (i % 3 == 0).cast("int").alias("is_evidence"), *[(i * k % 17).cast("double").alias(c) for k, c in enumerate(models.RANKED, 3)])
    out = models.time_transfer(SimpleNamespace(evidence_hands=hands, stage=lambda d: d))
    assert out.count() == 60 and sorted(shift for _, shift in asked) == [*range(5), *range(20, 25)]
    assert {t for t, _ in asked} == {ml.Trees()} == {ml.Trees(max_iter=280, step=0.055, depth=5, min_rows=12, seed=7401)}


def test_bags_come_from_training_folds(planted):
    draws = R.bag_sample(planted.drop("label"), planted, "key", "fold", "label", 2, 3)
    bad = draws.join(planted.select("key", "fold"), "key").where("fold = held_out")
    assert bad.count() == 0 and draws.groupBy("held_out", "bag").agg(F.count_distinct("key").alias("d"), F.count("key").alias("n")).where("d <> n").count() == 0


def test_publish_refuses_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    sinks.publish(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish(df, str(tmp_path / "x"))
    a, b = (T.fingerprint(d).first() for d in (df, df.orderBy(F.col("id").desc())))
    assert a == b and a["rows"] == 3


def test_unlabelled_job(spark):
    t = six_pools(spark, 2)
    from pairsift.operators import agg as A, pairs as P

    players = P.player_hands(t["seats"], t["hands"], A.aggregate_actions(t["actions"], t["hands"]))
    out = J.build_unlabelled(players, t["development_labels"], t["players"], 3)
    assert out["pairs"].count() == 2 * 15 - 4 and "label" not in out["features"].columns
    assert {r["metric"]: r["value"] for r in out["manifest"].collect()}["per_table_median"] == 13.0


@pytest.fixture(scope="module")
def ablated(planted):
    """Metrics of an ablation with time transfer: z is noise for the label, x separates it."""
    rest = planted.drop("label", "family").withColumn("count", F.hash("key") % 50)
    rows = planted.withColumn("count", F.hash("key") % 50)
    late = planted.withColumn("x", F.col("x") + 0.01)
    out = J.ablation(rows, rest, rest, ["z"], ["z", "x"], "label", "fold", "pool", "key", M.GATES["influence"], "count", TREES, (planted, late), "x")
    return {r["metric"]: r["value"] for r in out.collect()}


@pytest.mark.parametrize("rules", sorted(k for k in M.GATES if not k.startswith("evidence")))
def test_every_rule_set_finds_its_metrics(ablated, rules):
    assert {m for m, _, _ in M.GATES[rules]} <= ablated.keys()
    assert all(ablated[m] is not None for m, _, _ in M.GATES[rules])


def test_ablation_values(ablated):
    assert ablated["cand_ap"] > 0.9 > ablated["base_ap"] and ablated["ap_delta"] == pytest.approx(ablated["cand_ap"] - ablated["base_ap"])
    assert ablated["worst_ap"] > 0.9 and 0 <= ablated["directional_gap"] <= 0.1
    assert ablated["early_to_late_delta"] > 0.2 and ablated["late_to_early_delta"] > 0.2 and ablated["time_fold_delta"] > 0
    assert ablated["gate:worst_ap"] == 1 and ablated["gate:overall"] == min(v for k, v in ablated.items() if k.startswith("gate:"))
