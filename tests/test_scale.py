"""The split paths give what plain windows and brute force give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsift.operators import agg as A, metrics as M, pairs as P, windows as WN
from pairsift.scale import exact_quantiles, ordered_scan, value_counts_scan, pick_nearest

from .fixtures import brute_counts, skewed_seats


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, heavy value ties, NULLs in one column."""
    i = F.col("id")
    return spark.range(900).select(
        i, F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (i % 40).cast("string"))).alias("g"),
        (i * 7919 % 13).cast("double").alias("v"), F.when(i % 5 > 0, (i * 31 % 17).cast("double")).alias("x"),
    )


def same(rows, a, b):
    assert rows(a.select(sorted(a.columns))) == rows(b.select(sorted(b.columns)))


def scan(df, limit):
    return ordered_scan(
        df, [F.col("v").desc(), F.col("id")], ["g"], limit=limit, sums={"n": F.lit(1), "s": "v"}, totals={"t": "v"},
        lags={"prev": "id"}, lasts={"last_x": "x"},
    )


def test_ordered_scan_split_equals_window(skewed, rows):
    same(rows, scan(skewed, 50), scan(skewed, 10**6))


def test_ordered_scan_null_group(skewed, rows):
    df = skewed.withColumn("g", F.when(F.col("g") != "hot", F.col("g")))
    same(rows, scan(df, 50), scan(df, 10**6))


def test_global_scan(skewed, rows):
    a, b = (ordered_scan(skewed, [F.col("id")], sums={"s": "v"}, limit=k) for k in (100, 10**6))
    same(rows, a, b)


def test_quantiles_split(skewed, rows):
    for keys in ([], ["g"]):
        a, b = (exact_quantiles(skewed, keys, ["v", "x"], {"__p95": 0.95, "__m": 0.5}, limit=k) for k in (50, 10**6))
        got, want = rows(a), rows(b)
        assert [r[: len(keys)] for r in got] == [r[: len(keys)] for r in want]
        numbers = lambda table: np.array([r[len(keys):] for r in table], dtype=float)
        assert np.allclose(numbers(got), numbers(want), equal_nan=True)


def test_quantiles_of_hard_values(spark):
    """Radix selection over ties, signs, magnitudes from 1e-300 to 1e300 and close neighbours."""
    rng = np.random.default_rng(2)
    sets = {
        "wide": rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000),
        "close": 1.0 + rng.integers(0, 5000, 3000) * 2.0**-52,
        "ties": np.repeat([-2.5, -0.0, 0.0, 7.0], 750),
        "one": np.array([3.25]),
        "inf": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf]),
        "denormal": rng.integers(-50, 50, 400) * 5e-324,
    }
    made = spark.createDataFrame([(k, float(v), None) for k, x in sets.items() for v in x], "g string, v double, empty double").repartition(5)
    probs = {"__a": 0.0, "__b": 0.31, "__c": 0.5, "__d": 0.95, "__e": 1.0}
    for limit in (1, 500, None):
        got = {r.g: r for r in exact_quantiles(made, ["g"], ["v", "empty"], probs, limit=limit).collect()}
        assert got.keys() == sets.keys()
        for k, x in sets.items():
            x = np.sort(x)
            for s, p in probs.items():
                at = (len(x) - 1) * p
                low, high = x[int(np.floor(at))], x[int(np.ceil(at))]
                want = low if low == high else low + (high - low) * (at - np.floor(at))
                assert got[k][f"v{s}"] == want and got[k][f"empty{s}"] is None, (k, s, limit)


def test_quantiles_gather_no_value_map(skewed):
    for keys in ([], ["g"]):
        plan = exact_quantiles(skewed, keys, ["v", "x"], {"__p95": 0.95}, limit=50)._jdf.queryExecution().toString()
        assert "percentile(" not in plan


def test_nearest_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "value double")
    assert value_counts_scan(df, [], "value").agg(pick_nearest(0.95)).first()[0] == 10.0  # position 9.5 goes up


def test_percentile_rank_split_and_pandas(skewed, rows):
    a, b = (WN.pct_rank_avg(skewed, ["g"], ["v", "x"], limit=k) for k in (50, 10**6))
    same(rows, a.withColumns({c: F.round(c, 9) for c in ("v__pct", "x__pct")}), b.withColumns({c: F.round(c, 9) for c in ("v__pct", "x__pct")}))
    pdf = b.toPandas()
    assert np.allclose(pdf["x__pct"], pdf.groupby("g")["x"].rank(pct=True), equal_nan=True)


def test_ap_split_equals_numpy(skewed):
    df = skewed.withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    pdf = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    y = pdf["y"].to_numpy()
    want = (np.cumsum(y) / np.arange(1, len(y) + 1) * y).sum() / y.sum()
    for limit in (50, 10**6):
        assert M.average_precision(df, "y", "v", "id", limit=limit).first()[0] == pytest.approx(want, abs=1e-12)


def test_met_pairs_with_a_crowd(spark, rows):
    seats = skewed_seats(spark)
    want = brute_counts(seats)
    for least in (1, 2, 3):
        for block in (16, P.PAIR_BLOCK):
            got = {(a, b): n for a, b, n in rows(P.met_pairs(seats, min_shared=least, block=block), "low", "high", "shared_hands")}
            assert got == {k: v for k, v in want.items() if v >= least}


def test_block_pairs(spark, rows):
    seats = spark.range(75).selectExpr("IF(id < 50, 'hot', IF(id < 74, 'mid', 'one')) AS hand_id", "id * 7 % 101 AS player_id", "id AS x")
    for block in (1, 7, 64):
        got = rows(P.block_pairs(seats, "hand_id", "player_id", ["x"], block, limit=20))
        by = {}
        for h, p, x in rows(seats):
            by.setdefault(h, []).append((p, x))
        assert got == sorted((h, a, b, x, y) for h, m in by.items() for a, x in m for b, y in m if a < b)


def test_a_hand_of_20000_members_is_spread(spark):
    """200 million pairs of one hand: no key holds more than a block's pairs, no task a large share."""
    n, block = 20_000, 512
    seats = spark.range(n).selectExpr("1 AS hand_id", "id AS player_id")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    try:
        met = P.block_pairs(seats, "hand_id", "player_id", block=block)
        per_task = met.groupBy(F.spark_partition_id()).count().select("count").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    total = n * (n - 1) // 2
    assert sum(r[0] for r in per_task) == total
    assert max(r[0] for r in per_task) < total / 8
    blocks = -(-n // block)
    assert blocks * (blocks + 1) // 2 * block**2 >= total and met.columns == ["hand_id", "low", "high"]


def test_pool_of_a_pair_comes_from_its_shared_groups_beside_a_crowd(spark, rows):
    """The pool was the least of all groups of the lower member once any group was large."""
    seats = [(1, p, 9) for p in range(6)] + [(2, 0, 7), (2, 1, 7), (3, 0, 5), (4, 2, 4), (4, 3, 4)]
    df = spark.createDataFrame(seats, "hand_id int, player_id int, table_id int")
    for small_group in (2, 16):
        met = P.met_pairs(df, "table_id", 2, small_group=small_group)
        assert rows(met, "low", "high", "shared_hands", "table_id") == [(0, 1, 2, 7), (2, 3, 2, 4)]


def test_co_membership_with_a_crowd(spark, rows):
    seats = skewed_seats(spark)
    asked = [("a", "m001", "hot"), ("b", "m005", "m006"), ("c", "m250", "m010"), ("d", "zz", "m001")]
    pairs = spark.createDataFrame(asked, "pair_id string, player_1 string, player_2 string")
    by = {}
    for h, p in rows(seats):
        by.setdefault(h, set()).add(p)
    want = sorted((q, h) for q, a, b in asked for h, m in by.items() if a in m and b in m)
    assert rows(P.co_membership(seats, pairs), "pair_id", "hand_id") == want


def test_every_met_pair_is_listed_without_a_lookup(spark, rows):
    """All pairs that met: what asking for each of them gives, from one shuffle of the seats."""
    for seats, limit in ((skewed_seats(spark), 16), (skewed_seats(spark).where("hand_id <> 'hot'"), 1000)):
        met = P.met_pairs(seats, small_group=limit)
        asked = met.select(P.met_id().alias("pair_id"), F.col("low").alias("player_1"), F.col("high").alias("player_2"))
        listed = P.co_membership(seats, small_group=limit)
        assert rows(listed) == rows(P.co_membership(seats, asked, small_group=limit))
    plan = P.co_membership(seats, small_group=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_small_pairs_are_sent_once_for_all_statistics(spark, rows):
    df = spark.range(3000).selectExpr("id % 700 AS pair_id", "CAST(id * 37 % 101 AS DOUBLE) AS a", "IF(id % 3 = 0, NULL, id % 7) AS b")
    got = A.summarize(df, ["pair_id"], ["a", "b"], largest=5)
    want = A.summarize(df, ["pair_id"], ["a", "b"], limit=2)
    near = lambda d: d.select("pair_id", *[F.round(c, 9).alias(c) for c in sorted(d.columns) if c != "pair_id"])
    assert rows(near(got)) == rows(near(want))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_listed_top_k_equals_value_counts(spark, rows):
    df = spark.range(900).selectExpr("id % 170 AS pair_id", "id * 37 % 11 AS a", "IF(id % 3 = 0 OR id % 170 = 5, NULL, id % 7) AS b")
    got = A.topk_summary(df, ["pair_id"], ["a", "b"], 3, "x_", largest=6)
    want = A.topk_summary(df, ["pair_id"], ["a", "b"], 3, "x_")
    near = lambda d: d.select("pair_id", *[F.round(c, 9).alias(c) for c in sorted(d.columns) if c != "pair_id"])
    assert rows(near(got)) == rows(near(want))


def test_inversion_changes_brute(spark):
    df = spark.range(200).select(
        "id", (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") * 37 % 23).cast("double").alias("a"),
        (F.col("id") * 53 % 19).cast("double").alias("b"))
    rows_ = df.collect()
    pos, neg = [r for r in rows_ if r.y], [r for r in rows_ if not r.y]
    fixed = sum(n.a >= p.a and n.b < p.b for p in pos for n in neg)
    created = sum(n.a < p.a and n.b >= p.b for p in pos for n in neg)
    for limit in (20, 10**6):
        got = M.inversion_changes(df, "y", "a", "b", "id", limit=limit).first()
        assert (got["fixed"], got["created"]) == (fixed, created)


def test_tie_views_long_run(spark):
    """Closed forms for long tie blocks equal the summed ones."""
    df = spark.range(5000).select("id", (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") < 100, 2.0).otherwise(1.0).alias("s"))
    got = M.tie_views(df, "y", "s", "id").first()
    def ap(y):
        y = np.asarray(y)
        return (np.cumsum(y) / np.arange(1, len(y) + 1) * y).sum() / y.sum()
    best = [1] * 50 + [0] * 50 + [1] * 2450 + [0] * 2450
    worst = [0] * 50 + [1] * 50 + [0] * 2450 + [1] * 2450
    assert got["best_tie_ap"] == pytest.approx(ap(best), abs=1e-10)
    assert got["worst_tie_ap"] == pytest.approx(ap(worst), abs=1e-10)


def test_baselines_two_ways(skewed, rows):
    a = A.baselines(skewed, ["g"], ["v"], largest=300)
    b = A.baselines(skewed, ["g"], ["v"])
    same(rows, a.withColumn("base_v", F.round("base_v", 9)), b.withColumn("base_v", F.round("base_v", 9)))


def test_preferences_of_a_hot_pair(spark):
    """A pair of 100,000 hands: salted keys give each preference once, weights add up to one."""
    rows = spark.range(100_000).selectExpr("'hot' AS pair_id", "id AS hand_id", "CAST(id % 20000 = 0 AS INT) AS is_evidence", "id % 7 AS x")
    rows = rows.unionByName(spark.createDataFrame([("small", 1, 1, 3), ("small", 2, 0, 1), ("none", 3, 0, 1)], "pair_id string, hand_id long, is_evidence int, x long"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for orders, times in (("both", 2), ("one", 1)):
            got = P.pairwise_preferences(rows, "pair_id", "is_evidence", ["x"], orders, salt_rows=10_000)
            per = {r.pair_id: (r.n, r.w) for r in got.groupBy("pair_id").agg(F.count("x").alias("n"), F.sum("weight").alias("w")).collect()}
            assert per == {"hot": (5 * 99_995 * times, pytest.approx(1)), "small": (times, pytest.approx(1))}
        whole = P.pairwise_preferences(rows, "pair_id", "is_evidence", ["x"])
        key = ["pair_id", "target", "x"]
        a, b = (d.groupBy(*key).agg(F.count("x").alias("n")) for d in (whole, P.pairwise_preferences(rows, "pair_id", "is_evidence", ["x"], salt_rows=999)))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_table_difference_reads_differing_buckets_only(spark, rows):
    from pairsift.operators import quality as Q

    a = spark.range(50_000).selectExpr("id % 40000 AS id", "IF(id % 9 = 0, NULL, id % 5) AS x", "IF(id % 7 = 0, NULL, 'v') AS y")
    b = a.orderBy(F.col("id").desc()).repartition(7)
    assert Q.differing_buckets(a, b).count() == 0 and Q.table_diff(a, b).count() == 0
    c = b.where("id <> 11").unionByName(spark.createDataFrame([(1, None, "z"), (1, None, "z")], a.schema))
    assert 2 <= Q.differing_buckets(a, c).count() <= 4
    got = rows(Q.table_diff(a, c), "id", "only_in")
    assert sorted(got) == sorted([(11, "a")] * a.where("id = 11").count() + [(1, "b")] * 2)
    swapped = spark.createDataFrame([(None, 1)], "p long, q long"), spark.createDataFrame([(1, None)], "p long, q long")
    assert Q.table_diff(*swapped).count() == 2


def test_met_pairs_are_counted_once_for_several_readers(spark):
    """every reader listed and counted all pairs of all hands anew."""
    from __spark_entry__ import queries

    for name in ("j08_unlabelled_pairs", "j11_map_pairs", "q12_latent_violations", "w03_pct_rank_global", "e02_minimal_submission"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_suppkey" not in plan, name
    for name in ("j16_assemble", "e01_audit"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(" not in plan, name


def test_assemble_checks_every_table_once(spark, rows):
    from pairsift.operators.quality import QualityError

    made = lambda name, ids: spark.createDataFrame([(i, -i, i * 10) for i in ids], f"a int, b int, {name} int")
    x, y, z = made("x", [1, 2]), made("y", [2, 1, 3]), made("z", [3, 2])
    assert rows(P.assemble(x, y, z, key=["a", "b"], check=True)) == [(2, -2, 20, 20, 20)]
    for tables in ((x.union(x), y, z), (x, y.union(y), z), (x, y, z.union(z))):
        with pytest.raises(QualityError, match="repeats"):
            P.assemble(*tables, key=["a", "b"], check=True)


def test_mapping_needs_a_counterpart_for_every_pair(spark, rows):
    from pairsift.operators.quality import QualityError

    made = lambda *r: spark.createDataFrame(list(r), "pair_id string, player_1 int, player_2 int")
    a, b = made(("a", 1, 2), ("b", 4, 3)), made(("c", 2, 1), ("d", 3, 4), ("e", 5, 6))
    assert rows(P.map_pairs(a, b)) == [("a", "c"), ("b", "d")]
    with pytest.raises(QualityError):
        P.map_pairs(b, a)
    with pytest.raises(QualityError):
        P.map_pairs(a, made(("c", 2, 1), (None, 3, 4)))


def test_met_pairs_with_values_both_ways(spark, rows):
    """Blocks of all members give what the listed pairs give, each pair once."""
    seats = skewed_seats(spark).unionByName(skewed_seats(spark).limit(5)).unionByName(
        spark.createDataFrame([("solo", None), (None, "m001"), ("solo", "m001")], "hand_id string, player_id string"))
    want = brute_counts(skewed_seats(spark))
    some = sorted(want)[::3]
    known = spark.createDataFrame([(a, b, float(i)) for i, (a, b) in enumerate(some)] + [("none", "zz", 1.0)], "low string, high string, value double")
    x = spark.createDataFrame([(m, float(i)) for i, m in enumerate(sorted({p for k in some for p in k}))] + [("other", 9.0)], "player_id string, x double")
    at, of = {k: float(i) for i, k in enumerate(some)}, {r.player_id: r.x for r in x.collect()}
    expected = sorted([(a, b, at.get((a, b)), of.get(a), of.get(b)) for a, b in want], key=lambda r: r[:2])
    for dense, block in ((False, 16), (True, 7), (True, 64), (True, 1024), (None, 1024)):
        got = sorted((tuple(r) for r in P.met_with_values(seats, known, x, dense=dense, block=block).collect()), key=lambda r: r[:2])
        assert got == expected, (dense, block)


def test_pairs_that_meet_often_are_not_shuffled(spark):
    """F12, F16: users of an hour against each other grew as the square of the users, shuffled."""
    seats = spark.range(6000).selectExpr("pmod(xxhash64(id), 20) AS hand_id", "id % 300 * 7 AS player_id")
    known = spark.createDataFrame([(0, 140, 2.5)], "low long, high long, value double")
    met = P.met_with_values(seats, known, block=32)
    assert "CoGroups" in met._jdf.queryExecution().optimizedPlan().toString()
    assert met.count() == P.met_pairs(seats).count() > 40_000
    assert [tuple(r)[:3] for r in met.where("value IS NOT NULL").collect()] == [(0, 140, 2.5)]


def test_small_pieces_share_ranges(spark):
    """every piece of the split scan was a task, which sends its metrics to the driver."""
    from pairsift.scale import cut_pieces

    df = spark.range(20_000).selectExpr("id * 7919 % 20011 AS k", "id % 3 AS g")
    cut = cut_pieces(df, ["g"], [F.col("k").desc()], 10).cache()
    assert cut.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = cut.groupBy("__piece").agg(F.count("k").alias("n"), F.min(F.struct("g", -F.col("k"))).alias("lo"), F.max(F.struct("g", -F.col("k"))).alias("hi"))
    pieces = per.orderBy("__piece").collect()
    assert sum(p.n for p in pieces) == 20_000 and max(p.n for p in pieces) == 10
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(pieces, pieces[1:]))


def test_ranks_of_hot_values_are_not_one_key(spark, rows):
    """rows looked their rank up by value, a common value's rows all in one task."""
    df = spark.range(4000).selectExpr("id", "IF(id % 3 = 0, 1.0D, IF(id % 7 = 0, NULL, CAST(id * 37 % 900 AS DOUBLE))) AS v")
    ranks = df.where("v IS NOT NULL").groupBy("v").agg(F.count("id").alias("cnt")).select("v", (F.col("v") * 2).alias("r"), "cnt")
    want = sorted((r.id, None if r.v is None else 2 * r.v) for r in df.collect())
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for few in (10**6, 10):
            got = WN._fetch_ranks(df, ranks, ["v"], "r", 100, few)
            assert rows(got, "id", "r") == want
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and ("__salt" in plan or "SortMergeJoin" not in plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def fullest(df):
    """Rows of the fullest task."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_follow_rows(spark, rows, monkeypatch):
    """Seats, their actions and the hands whose pairs are listed are dealt by rows, not by shuffled bytes."""
    import pairsift.scale as S
    from catalog.base import Tables

    lines = spark.range(6000).select(
        F.floor(F.col("id") / 4).alias("l_orderkey"), (F.col("id") * 7 % 50).alias("l_suppkey"), (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"),
        *[(F.col("id") % n).cast("double").alias(c) for c, n in {"l_quantity": 50, "l_extendedprice": 900}.items()],
        *[(F.col("id") % 9 / 100).alias(c) for c in ("l_tax", "l_discount")], F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
    )
    hands = spark.range(1500).select(F.col("id").alias("hand_id"), F.lit(100.0).alias("big_blind"))

    def made():
        t = Tables(spark, "/nowhere")
        t.raw["lineitem"], t.hands = lines, hands
        return t.seats, t.action_features, P.co_membership(t.seats)

    whole = made()
    monkeypatch.setattr(S, "TASK_ROWS", 100)
    for a, b, most in zip(whole, made(), (200, 200, 300)):
        assert fullest(b) <= most < fullest(a)
        same(rows, a, b)
