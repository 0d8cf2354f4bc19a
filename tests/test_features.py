import pytest
from pyspark.sql import functions as F

from pairsift.functions import game as G, scalars as X
from pairsift.operators import agg as A, pairs as P, quality as Q, rank as K, windows as WN

from .fixtures import two_hands


@pytest.fixture(scope="module")
def built(spark):
    t = two_hands(spark)
    ph = P.player_hands(t["seats"], t["hands"], A.aggregate_actions(t["actions"], t["hands"]))
    return t, P.pair_hands(ph, t["pairs"], "development").cache()


def test_flow_follows_the_request_order(built):
    _, hands = built
    h1 = hands.where("hand_id = 'h1'").first()
    # The pair is asked as (p2, p1): p1's loss to p2 runs from side 2 to side 1.
    assert (h1["transfer_1_to_2_bb"], h1["transfer_2_to_1_bb"]) == (0.0, 20.0)
    assert hands.count() == 2


def test_signal_order_and_evidence(built, spark):
    t, hands = built
    s = {r["hand_id"]: r["directed_signal"] for r in hands.collect()}
    assert s["h1"] > s["h2"]
    pred = spark.createDataFrame([("pair", "directed_transfer")], "pair_id string, predicted_behavior string")
    slots = K.rank_evidence(hands, pred).first()
    assert (slots["evidence_hand_1"], slots["evidence_hand_2"], slots["evidence_hand_3"]) == ("h1", "h2", None)


def test_pair_features(built):
    t, hands = built
    f = A.pair_features(hands, t["pairs"], t["players"]).first()
    assert f["shared_hands_calc"] == 2 and f["dominant_flow_bb"] == 20.0
    assert f["account_age_gap"] == 10 and f["same_region_bucket"] == 1


def test_pair_without_hands_is_kept(built, spark):
    t, hands = built
    more = t["pairs"].unionByName(spark.createDataFrame([("lone", "p1", "zz", 0)], t["pairs"].schema))
    f = A.pair_features(hands, more, t["players"]).where("pair_id = 'lone'").first()
    assert f["shared_hands_calc"] is None and f["same_client_family"] == 0


def test_duplicate_pair_request(built, spark):
    t, _ = built
    twice = t["pairs"].unionByName(spark.createDataFrame([("again", "p1", "p2", 2)], t["pairs"].schema))
    with pytest.raises(Q.QualityError):
        P.co_membership(t["seats"], twice)


def test_zero_blind_and_bad_numbers(spark):
    acts = spark.createDataFrame(
        [("h", "a", "flop", "ALL_IN", "9", "x", None), ("h", "a", "preflop", "check", None, "3", "10")],
        "hand_id string, player_id string, street string, action string, amount string, to_call string, pot_before string")
    hands = spark.createDataFrame([("h", 0.0)], "hand_id string, big_blind double")
    r = A.aggregate_actions(acts, hands).first()
    assert (r["n_actions"], r["aggressive_actions"], r["all_ins"], r["facing_pressure"], r["postflop_checks"]) == (2, 1, 1, 1, 0)
    assert (r["amount_bb_sum"], r["to_call_bb_max"], r["amount_pot_ratio_max"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("a,b,want", [
    ("Ah", "Kh", 14 + 1.5 + 0.75), ("10d", "Ts", 10 + 7 + 1), ("2c", "9d", 9.0), (None, None, 0 + 7 + 1.5 + 1), ("x", "Qd", 12.0)])
def test_card_strength(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(G.card_strength("a", "b")).first()[0] == pytest.approx(want)


def test_null_rules(spark):
    df = spark.createDataFrame([(None, 1.0, float("nan")), (-2.0, 0.0, float("inf"))], "a double, b double, c double")
    got = df.select(X.clip("a", 0.0).alias("a"), X.strict_least("a", "b").alias("m"), X.finite("c").alias("c"),
                    X.safe_ratio("a", "b", 0.0).alias("r"), X.log1p0("a").alias("l")).collect()
    assert [tuple(r) for r in got] == [(None, None, None, 0.0, None), (0.0, -2.0, None, 0.0, 0.0)]


def test_pair_key_is_order_free(spark):
    r = spark.createDataFrame([("b", "a")], "x string, y string").select(G.pair_key("x", "y"), G.pair_key("y", "x")).first()
    assert r[0] == r[1] == "a\x1fb"


def test_context_and_transitions(spark, rows):
    acts = [("h", i, p, s, a, 4.0, c, 10.0, 3) for i, (p, s, a, c) in enumerate([
        ("a", "flop", "bet", 0.0), ("b", "flop", "raise", 4.0), ("b", "flop", "check", 0.0), ("c", "flop", "call", 4.0), ("a", "turn", "check", 0.0)])]
    df = spark.createDataFrame(acts, "hand_id string, action_no int, player_id string, street string, action string, amount double, to_call double, pot_before double, players_active int")
    hands = spark.createDataFrame([("h", 2.0)], "hand_id string, big_blind double")
    ctx = WN.action_context(df, hands).cache()
    assert [r[0] for r in ctx.orderBy("action_no").select("last_aggressor").collect()] == [None, "a", "b", "b", None]
    assert rows(WN.transitions(ctx), "influencer", "target", "influencer_action", "target_action") == [("a", "b", 3, 3), ("b", "c", 1, 2)]
    out = A.response_outcomes(ctx, df.select("hand_id", "player_id").distinct().withColumn("net_bb", F.lit(-50.0)),
                              spark.createDataFrame([("h", "development", 1.0)], "hand_id string, phase string, phase_progress double"))
    assert rows(out, "aggressor", "responder", "responder_net_bb") == [("a", "b", -20.0), ("b", "c", -20.0)]


def test_influence_and_impact(spark):
    edges = spark.createDataFrame([("a", "t", .5), ("b", "t", .3), ("t", "a", .9)], "influencer string, target string, influence double")
    pairs = spark.createDataFrame([("1", "a", "t"), ("2", "b", "t")], "pair_id string, player_1 string, player_2 string")
    got = {r["pair_id"]: r["net_influence"] for r in A.net_influence(edges, pairs).collect()}
    assert got["1"] == pytest.approx(min(.5 - .3, .9)) and got["2"] == pytest.approx(.3 - .5)
    outcomes = spark.createDataFrame([("x", "y", 6.0), ("x", "z", 2.0), ("w", "y", 1.0)], "aggressor string, responder string, responder_net_bb double")
    imp = {(r["src"], r["dst"]): r["w"] for r in A.directed_impact(outcomes).collect()}
    assert imp[("x", "y")] == pytest.approx((6 - 2) / 11) and imp[("w", "y")] == 0.0


def test_pool_pairs_bound(spark):
    members = spark.createDataFrame([("t", f"p{i}") for i in range(5)], "pool string, player_id string")
    assert P.pool_pairs(members, "pool", max_members=5).count() == 10
    with pytest.raises(Q.QualityError):
        P.pool_pairs(members, "pool", max_members=4)
