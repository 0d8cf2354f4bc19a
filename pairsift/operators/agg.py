"""Aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions.game import action_flags, event_ratio, orient
from ..functions.scalars import clip, num0, safe_ratio, time_bin, total
from ..scale import LIST_ROWS, as_col, exact_quantiles, list_quantiles, listed, ordered_scan, pick_linear, pick_nearest, to_long, value_counts_scan
from ..schema import ACTION_MAXIMA, ACTION_SUMS, INTERACTION_COUNTS, SIGNALS, SUMMARY_FIELDS
from ..session import max_group_rows


def aggregate_actions(actions: DataFrame, hands: DataFrame) -> DataFrame:
    """Per (hand, player): 12 sums and 3 maxima over the events."""
    rows = actions.join(hands.select("hand_id", "big_blind"), "hand_id", "left")
    amount, price = num0("amount"), num0("to_call")
    rows = rows.withColumns({
        **action_flags(),
        "n_actions": F.lit(1),
        "amount_bb_sum": safe_ratio(amount, "big_blind", 0.0),
        "to_call_bb_sum": safe_ratio(price, "big_blind", 0.0),
        "amount_bb_max": safe_ratio(amount, "big_blind", 0.0),
        "to_call_bb_max": safe_ratio(price, "big_blind", 0.0),
        "amount_pot_ratio_max": event_ratio(),
    })
    return rows.groupBy("hand_id", "player_id").agg(
        *[F.sum(c).alias(c) for c in ACTION_SUMS], *[F.max(c).alias(c) for c in ACTION_MAXIMA]
    )


def baselines(df: DataFrame, keys: list[str], cols: list[str], prefix: str = "base_",
              largest: int | None = None, limit=None) -> DataFrame:
    """Group means beside the rows.

    With a known bound `largest` on the group size within the limit, one window does it;
    otherwise the means are aggregated and joined back, which no single group can stall.
    """
    limit = limit or max_group_rows(df.sparkSession)
    if largest is not None and largest <= limit:
        w = W.partitionBy(*keys)
        return df.withColumns({f"{prefix}{c}": F.avg(c).over(w) for c in cols})
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in cols])
    return df.join(means, keys, "left")


def summarize(df: DataFrame, key: list[str], cols: list[str], limit=None, largest: int | None = None) -> DataFrame:
    """Mean, maximum and linear 95th percentile per group.

    With a known bound `largest` on the group size, small groups take one shuffle for all three.
    """
    plain = [*[F.avg(c).alias(f"{c}__mean") for c in cols], *[F.max(c).alias(f"{c}__max") for c in cols]]
    if largest is not None and largest <= min(limit or LIST_ROWS, LIST_ROWS):
        return list_quantiles(listed(df.select(*key, *cols), key, cols, plain), cols, {"__p95": 0.95})
    p95 = exact_quantiles(df.select(*key, *[F.col(c).cast("double").alias(c) for c in cols]),
                          key, cols, {"__p95": 0.95}, limit, largest)
    return df.groupBy(*key).agg(*plain).join(p95, key)


def count_by(df: DataFrame, key: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))


def topk_summary(df: DataFrame, key: list[str], cols: list[str], k: int = 5, prefix: str = "",
                 limit=None, largest: int | None = None) -> DataFrame:
    """Per column: mean, nearest 95th percentile, mean of the k largest, and sum.

    With a known small bound `largest` on the group size, each row is sent once and a group's
    columns are sorted in its list. Otherwise it works on value counts, which combine before
    the shuffle.
    """
    if largest is not None and largest <= min(limit or LIST_ROWS, LIST_ROWS):
        packed = listed(df.select(*key, *[F.col(c).cast("double").alias(c) for c in cols]), key, cols)
        value = lambda c: F.sort_array(F.filter(F.transform("__rows", lambda x: x[c]), lambda v: v.isNotNull()), asc=False)
        made = packed.select(*key, *[value(c).alias(c) for c in cols])
        added = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        out = []
        for c in cols:
            n = F.nullif(F.size(c), F.lit(0))
            at = n - 1 - F.floor((n - 1) * F.lit(0.95) + F.lit(0.5))
            out += [
                (added(F.col(c)) / n).alias(f"{prefix}{c}__mean"), F.get(F.col(c), at.cast("int")).alias(f"{prefix}{c}__p95"),
                F.when(n.isNotNull(), added(F.slice(c, 1, k)) / F.least(F.lit(k), n)).alias(f"{prefix}{c}__top{k}"),
                F.when(n.isNotNull(), added(F.col(c))).alias(f"_sum_{c}"),
            ]
        return made.select(*key, *out)
    scan = value_counts_scan(to_long(df, key, cols), [*key, "feature"], "value", limit)
    above = F.col("n") - F.col("upto")
    taken = F.greatest(F.lit(0), F.least(F.col("cnt"), F.lit(k) - above))
    per = scan.groupBy(*key, "feature").agg(
        (F.sum(F.col("value") * F.col("cnt")) / F.max("n")).alias("mean"),
        pick_nearest(0.95).alias("p95"),
        (F.sum(F.col("value") * taken) / F.least(F.lit(k), F.max("n"))).alias("top"),
        F.sum(F.col("value") * F.col("cnt")).alias("sum"),
    )
    pick = lambda c, m: F.max(F.when(F.col("feature") == c, F.col(m)))
    return per.groupBy(*key).agg(*[
        pick(c, m).alias(name)
        for c in cols
        for m, name in (
            ("mean", f"{prefix}{c}__mean"), ("p95", f"{prefix}{c}__p95"),
            ("top", f"{prefix}{c}__top{k}"), ("sum", f"_sum_{c}"),
        )
    ])


def response_ratios(df: DataFrame, prefix: str = "interaction_") -> DataFrame:
    """Smoothed response rates and the outsider-partner contrast, from `_sum_` columns."""
    s = lambda c: F.col(f"_sum_{c}")
    hu = s("true_hu_actions") + 1
    answers = lambda who: total([s(f"{who}_{a}_to_pair") for a in ("folds", "calls", "raises")]) + 1
    pf, of = s("partner_folds_to_pair"), s("outsider_folds_to_pair")
    return df.withColumns({
        f"{prefix}true_hu_passive_rate": (s("true_hu_checks") + s("true_hu_calls")) / hu,
        f"{prefix}true_hu_aggression_rate": s("true_hu_aggression") / hu,
        f"{prefix}partner_fold_rate": pf / answers("partner"),
        f"{prefix}outsider_fold_rate": of / answers("outsider"),
        f"{prefix}outsider_partner_fold_contrast": (of - pf) / (of + pf + 1),
    })


def interaction_features(df: DataFrame, key: str = "pair_id", limit=None, largest: int | None = None) -> DataFrame:
    """41 response features per pair."""
    wide = response_ratios(topk_summary(df, [key], INTERACTION_COUNTS, 5, "interaction_", limit, largest))
    return wide.select(key, *[c for c in wide.columns if c.startswith("interaction_")])


def flow_features(df: DataFrame, key: list[str], a: str = "transfer_1_to_2_bb", b: str = "transfer_2_to_1_bb") -> DataFrame:
    sums = df.groupBy(*key).agg(F.sum(a).alias("__a"), F.sum(b).alias("__b"))
    x, y = F.col("__a"), F.col("__b")
    return sums.select(
        *key, (F.abs(x - y) / (x + y + F.lit(1e-3))).alias("flow_asymmetry"),
        F.greatest(x, y).alias("dominant_flow_bb"),
    )


def temporal_profile(df: DataFrame, key: list[str], signals: list[str] = SIGNALS,
                     progress: str = "phase_progress", bins: int = 4, largest: int | None = None) -> DataFrame:
    """Mean per time bin, one column each, and the range over the bins present.

    With a known small bound `largest` on the group size, rows are sent instead of partial sums.
    """
    binned = df.withColumn("__bin", time_bin(progress, bins))
    if largest is not None and largest <= LIST_ROWS:
        binned = binned.select(*key, "__bin", *signals).repartition(*key)
    wide = binned.groupBy(*key).agg(*[
        F.avg(F.when(F.col("__bin") == t, F.col(s))).alias(f"{s}__t{t}")
        for s in signals for t in range(bins)
    ])
    cols = lambda s: [f"{s}__t{t}" for t in range(bins)]
    return wide.withColumns({
        f"{s}__temporal_range": F.greatest(*cols(s)) - F.least(*cols(s)) for s in signals
    })


def pair_features(pair_hands: DataFrame, pairs: DataFrame, players: DataFrame, limit=None,
                  largest: int | None = None) -> DataFrame:
    """Model features per pair; pairs without groups stay, with NULLs.

    Means, maxima, flows, bins and, for small groups, percentiles share one shuffle. `largest`
    is a known bound on a pair's groups.
    """
    from .pairs import compare_players

    key = ["pair_id"]
    # The requested pairs' exposure bounds the group size and is cheaper than counting.
    if largest is None and "shared_hands" in pairs.columns:
        largest = pairs.agg(F.max("shared_hands")).first()[0] or 0
    x, y = F.sum("transfer_1_to_2_bb"), F.sum("transfer_2_to_1_bb")
    binned = pair_hands.select(*key, "table_id", *SUMMARY_FIELDS, time_bin("phase_progress").alias("__bin"))
    plain = [
        *[F.avg(c).alias(f"{c}__mean") for c in SUMMARY_FIELDS],
        *[F.max(c).alias(f"{c}__max") for c in SUMMARY_FIELDS],
        F.count(F.lit(1)).alias("shared_hands_calc"),
        (F.abs(x - y) / (x + y + F.lit(1e-3))).alias("flow_asymmetry"),
        F.greatest(x, y).alias("dominant_flow_bb"),
        *[F.avg(F.when(F.col("__bin") == t, F.col(s))).alias(f"{s}__t{t}") for s in SIGNALS for t in range(4)],
        F.min("table_id").alias("table_id"),
    ]
    ranges = {
        f"{s}__temporal_range": F.greatest(*[f"{s}__t{t}" for t in range(4)])
        - F.least(*[f"{s}__t{t}" for t in range(4)])
        for s in SIGNALS
    }
    probs = {"__p95": 0.95}
    if largest is not None and largest <= min(limit or LIST_ROWS, LIST_ROWS):
        made = list_quantiles(listed(binned, key, SUMMARY_FIELDS, plain), SUMMARY_FIELDS, probs).withColumns(ranges)
    else:
        p95 = exact_quantiles(
            pair_hands.select("pair_id", *[F.col(c).cast("double").alias(c) for c in SUMMARY_FIELDS]),
            key, SUMMARY_FIELDS, probs, limit, largest,
        )
        made = binned.groupBy(*key).agg(*plain).withColumns(ranges).join(p95, key)
    base = [c for c in ("pair_id", "player_1", "player_2", "shared_hands") if c in pairs.columns]
    # The profiles join the narrow side.
    profiles = compare_players(pairs.select(*base), players)
    out = profiles.join(made, key, "left")
    return out.select(*base, *made.drop(*key).columns, *[c for c in profiles.columns if c not in base])


def interaction_counts(context: DataFrame, membership: DataFrame) -> DataFrame:
    """Per (pair, hand): heads-up actions of the two, and answers to their aggression.

    Everything is counted per hand first: once per player (own actions, and answers the
    player's aggression got from anyone) and once per pair of players (answers between
    them). A pair then joins three small counts instead of its events.
    """
    c = F.col
    a = F.lower(c("action"))
    aggressive = F.coalesce(c("is_aggressive"), F.lit(False))
    two_left = c("players_active") == 2
    answer = (c("to_call") > 0) & c("last_aggressor").isNotNull() & (c("last_aggressor") != c("player_id"))
    one = lambda cond: F.when(cond, 1).otherwise(0)
    own = {
        "hu_actions": two_left, "hu_checks": two_left & (a == "check"), "hu_calls": two_left & (a == "call"),
        "hu_aggression": two_left & aggressive,
    }
    kinds = {
        "folds": answer & (a == "fold"), "calls": answer & ((a == "call") | ((a == "all_in") & ~aggressive)),
        "raises": answer & aggressive,
    }
    rows = context.select(
        "hand_id", "player_id", F.when(answer, c("last_aggressor")).alias("aggressor"),
        *[one(v).alias(k) for k, v in own.items()], *[one(v).alias(k) for k, v in kinds.items()],
    )
    # Each event counts once for its actor and, when it answers aggression, once for the aggressor.
    zero = lambda names: [F.lit(0).alias(n) for n in names]
    roles = F.inline(F.array(
        F.struct(c("player_id").alias("who"), *[c(k).alias(k) for k in own], *zero(kinds)),
        F.struct(c("aggressor").alias("who"), *zero(own), *[c(k).alias(k) for k in kinds]),
    ))
    per = rows.select("hand_id", roles).where(c("who").isNotNull()).groupBy("hand_id", "who").agg(
        *[F.sum(k).alias(k) for k in [*own, *kinds]]
    )
    between = rows.where(c("aggressor").isNotNull()).groupBy(
        "hand_id", F.least("aggressor", "player_id").alias("low"), F.greatest("aggressor", "player_id").alias("high")
    ).agg(*[F.sum(k).alias(f"partner_{k}") for k in kinds])
    out = orient(membership.select("pair_id", "hand_id", "player_1", "player_2"), "player_1", "player_2")
    for i in (1, 2):
        side = per.select("hand_id", c("who").alias(f"player_{i}"), *[c(k).alias(f"{k}_{i}") for k in [*own, *kinds]])
        out = out.join(side, ["hand_id", f"player_{i}"], "left")
    out = out.join(between, ["hand_id", "low", "high"], "left").na.fill(0)
    # Two players are left and both belong to the pair: both act heads-up in the hand.
    both = (c("hu_actions_1") > 0) & (c("hu_actions_2") > 0)
    hu = lambda expr: F.when(both, expr).otherwise(0)
    pair = lambda x: c(f"{x}_1") + c(f"{x}_2")
    passive = lambda i: c(f"hu_checks_{i}") + c(f"hu_calls_{i}")
    return out.select(
        "pair_id", "hand_id",
        hu(pair("hu_actions")).alias("true_hu_actions"),
        hu(pair("hu_checks")).alias("true_hu_checks"),
        hu(pair("hu_calls")).alias("true_hu_calls"),
        hu(pair("hu_aggression")).alias("true_hu_aggression"),
        hu(passive(1)).alias("p1_hu_passive"),
        hu(passive(2)).alias("p2_hu_passive"),
        *[c(f"partner_{k}").alias(f"partner_{k}_to_pair") for k in kinds],
        *[(pair(k) - c(f"partner_{k}")).alias(f"outsider_{k}_to_pair") for k in kinds],
    )


def response_outcomes(context: DataFrame, player_results: DataFrame, hands: DataFrame, bound: float = 20.0) -> DataFrame:
    """Realised result of each responder to another player's aggression."""
    c = F.col
    edges = context.where(
        (c("to_call") > 0) & c("last_aggressor").isNotNull() & (c("last_aggressor") != c("player_id"))
    ).select("hand_id", c("last_aggressor").alias("aggressor"), c("player_id").alias("responder")).distinct()
    results = player_results.select(
        "hand_id", c("player_id").alias("responder"), clip("net_bb", -bound, bound).alias("responder_net_bb")
    )
    return (
        edges.join(results, ["hand_id", "responder"])
        .join(hands.select("hand_id", "phase", "phase_progress"), "hand_id")
        .select("hand_id", "phase", "phase_progress", "aggressor", "responder", "responder_net_bb")
    )


def directed_impact(outcomes: DataFrame, shrink: float = 10.0) -> DataFrame:
    """Edge total against the aggressor's mean over other responders, shrunk."""
    edges = outcomes.groupBy("aggressor", "responder").agg(
        F.count(F.lit(1)).alias("n"), F.sum("responder_net_bb").alias("s")
    )
    totals = edges.groupBy("aggressor").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    both = edges.join(totals, "aggressor")
    other_n, other_s = F.col("all_n") - F.col("n"), F.col("all_s") - F.col("s")
    value = (F.col("s") - F.col("n") * F.try_divide(other_s, other_n)) / (F.col("n") + F.lit(shrink))
    return both.select(
        F.col("aggressor").alias("src"), F.col("responder").alias("dst"),
        F.coalesce(value, F.lit(0.0)).alias("w"),
    )


def marginal_impact(outcomes: DataFrame, pairs: DataFrame | None = None, shrink: float = 10.0, name: str = "marginal_impact",
                    seats: DataFrame | None = None) -> DataFrame:
    """Both directions' impact of the given pairs; without `pairs`, of every pair that met in `seats`."""
    from .pairs import directed_to_pair, met_id, met_with_values

    edges = directed_impact(outcomes, shrink)
    if pairs is not None:
        return directed_to_pair(pairs, edges, "sum", name=name)
    known = orient(edges, "src", "dst").groupBy("low", "high").agg(F.sum("w").alias("value"))
    return met_with_values(seats, known).select(met_id().alias("pair_id"), F.coalesce("value", F.lit(0.0)).alias(name))


def directed_influence(transitions: DataFrame, shrink: float = 50.0) -> DataFrame:
    """Conditional mutual information per directed edge, shrunk by n / (n + shrink).

    Everything after the first count works on at most 48 states x 25 code pairs per edge.
    """
    edge = ["influencer", "target"]
    counts = transitions.groupBy(*edge, "state", "influencer_action", "target_action").agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    over = lambda *more: F.sum("n").over(W.partitionBy(*edge, *more))
    full = counts.select(
        *edge, "n", over("state").alias("nz"), over("state", "influencer_action").alias("nx"),
        over("state", "target_action").alias("ny"), over().alias("all_n"),
    )
    n = F.col("n")
    part = n / F.col("all_n") * F.ln(n * F.col("nz") / (F.col("nx") * F.col("ny")))
    cmi = full.groupBy(*edge).agg(F.sum(part).alias("empirical_cmi"), F.max("all_n").alias("edge_count"))
    return cmi.withColumn(
        "influence", F.col("empirical_cmi") * F.col("edge_count") / (F.col("edge_count") + F.lit(shrink))
    )


def net_edges(edges: DataFrame, src: str = "influencer", dst: str = "target", w: str = "influence") -> DataFrame:
    """Largest and second largest weight into each target, with the top source.

    Two nested aggregates instead of a sort: the top weight, then the best of the others.
    """
    tops = edges.groupBy(dst).agg(
        F.max(F.struct(F.col(w).alias("v"), F.col(src).alias("s"))).alias("top")
    ).select(dst, F.col("top.v").alias("first"), F.col("top.s").alias("first_src"))
    others = edges.join(tops, dst).where(F.col(src) != F.col("first_src"))
    second = others.groupBy(dst).agg(F.max(w).alias("second"))
    return tops.join(second, dst, "left").na.fill(0.0, ["second"])


def net_influence(edges: DataFrame, pairs: DataFrame | None = None, src: str = "influencer", dst: str = "target",
                  w: str = "influence", name: str = "net_influence", seats: DataFrame | None = None,
                  member: str = "player_id") -> DataFrame:
    """Own influence minus the best other source's, smaller of the two directions.

    Without `pairs`, of every pair that met in `seats`: a pair without an edge has the two
    members' best sources against it, which come along while pairs are listed.
    """
    from .pairs import met_id, met_with_values

    tops = net_edges(edges, src, dst, w)
    if pairs is None:
        linked = orient(edges.select(src, dst), src, dst).select("low", "high").distinct()
        asked = linked.select(F.struct("low", "high").alias("pair_id"), F.col("low").alias("player_1"), F.col("high").alias("player_2"))
        known = net_influence(edges, asked, src, dst, w, "value").select("pair_id.low", "pair_id.high", "value")
        met = met_with_values(seats, known, tops.select(F.col(dst).alias(member), F.col("first").alias("x")), member=member)
        best = F.greatest(*[F.coalesce(f"x_{i}", F.lit(0.0)) for i in (1, 2)])
        return met.select(met_id().alias("pair_id"), F.coalesce("value", F.lit(0.0) - best).alias(name))
    both = [
        pairs.select("pair_id", F.col(a).alias(src), F.col(b).alias(dst))
        for a, b in (("player_1", "player_2"), ("player_2", "player_1"))
    ]
    asked = reduce(DataFrame.unionByName, both)
    seen = asked.join(edges.select(src, dst, F.col(w).alias("own")), [src, dst], "left").join(tops, dst, "left")
    outsider = F.when(F.col("first_src") == F.col(src), F.col("second")).otherwise(F.col("first"))
    net = F.coalesce(F.col("own"), F.lit(0.0)) - F.coalesce(outsider, F.lit(0.0))
    return seen.groupBy("pair_id").agg(F.min(net).alias(name))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))


ROBUST_STATS = ["impute", "lower", "upper", "center", "iqr"]


def fit_robust(df: DataFrame, cols: list[str], limit=None) -> DataFrame:
    """One row per column: impute, lower, upper, centre and spread.

    Three passes, each handing a few numbers per column to the next.
    """
    from ..functions.scalars import finite

    spark = df.sparkSession
    clean = df.select(*[finite(c).alias(c) for c in cols])
    rows = clean.count()
    take = lambda frame, probs: exact_quantiles(frame, [], cols, probs, limit, rows).first()
    med = take(clean, {"__m": 0.5})
    filled = clean.select(*[F.coalesce(F.col(c), F.lit(med[f"{c}__m"])).alias(c) for c in cols])
    edge = take(filled, {"__lo": 0.01, "__hi": 0.99})
    clipped = filled.select(*[clip(c, edge[f"{c}__lo"], edge[f"{c}__hi"]).alias(c) for c in cols])
    mid = take(clipped, {"__c": 0.5, "__q1": 0.25, "__q3": 0.75})
    out = []
    for c in cols:
        # A column without a value has no parameters; its rows stay NULL.
        spread = None if mid[f"{c}__c"] is None else (mid[f"{c}__q3"] - mid[f"{c}__q1"]) or 1.0
        out.append((c, med[f"{c}__m"], edge[f"{c}__lo"], edge[f"{c}__hi"], mid[f"{c}__c"], spread))
    return spark.createDataFrame(out, "feature string, " + ", ".join(f"{s} double" for s in ROBUST_STATS))


def apply_robust(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    """(clip(impute(x)) - centre) / spread, with one parameter row per column."""
    from ..functions.scalars import finite

    by = {r["feature"]: r for r in params.collect()}  # one small row per column
    return df.withColumns({
        c: (
            clip(F.coalesce(finite(c), F.lit(by[c]["impute"])), by[c]["lower"], by[c]["upper"])
            - F.lit(by[c]["center"])
        ) / F.lit(by[c]["iqr"])
        for c in cols
    })


def count_stats(df: DataFrame, key: list[str]) -> DataFrame:
    """Groups, total, and min / median / max rows per group."""
    hist = count_by(df, key).groupBy(F.col("n").alias("rows")).agg(F.count(F.lit(1)).alias("cnt"))
    scan = ordered_scan(hist, [F.col("rows")], sums={"upto": "cnt"}, totals={"n": "cnt"})
    return scan.agg(
        F.sum("cnt").alias("groups"), F.sum(F.col("rows") * F.col("cnt")).alias("rows"),
        F.min("rows").alias("minimum"), pick_linear(0.5, "rows").cast("double").alias("median"), F.max("rows").alias("maximum"),
    )


def query_counts(df: DataFrame, pair: str, flag: str, progress: str = "phase_progress",
                 keep: list[str] | None = None) -> DataFrame:
    """Per pair: candidate, evidence, unjudged and preference counts, whole and by half."""
    e = F.col(flag).cast("int") == 1
    halves = {"full": F.lit(True), "early": F.col(progress) <= 0.5, "late": F.col(progress) > 0.5}
    out = df.groupBy(pair, *(keep or [])).agg(
        *[F.count_if(h).alias(f"{k}_candidates") for k, h in halves.items()],
        *[F.count_if(h & e).alias(f"{k}_evidence") for k, h in halves.items()],
    )
    return out.withColumns({
        **{f"{k}_unjudged": F.col(f"{k}_candidates") - F.col(f"{k}_evidence") for k in halves},
        **{
            f"{k}_preferences": F.col(f"{k}_evidence") * (F.col(f"{k}_candidates") - F.col(f"{k}_evidence"))
            for k in halves
        },
    })


def readiness(df: DataFrame, pair: str, flag: str, family: str, fold: str,
              progress: str = "phase_progress") -> DataFrame:
    """Evidence-bearing pairs, trainable pairs, extremes and preferences, per scope and level."""
    per = query_counts(df, pair, flag, progress, [family, fold])
    scopes = F.inline(F.array(*[
        F.struct(
            F.lit(s).alias("scope"), F.col(f"{s}_candidates").alias("candidates"),
            F.col(f"{s}_evidence").alias("evidence"), F.col(f"{s}_unjudged").alias("unjudged"),
            F.col(f"{s}_preferences").alias("preferences"),
        )
        for s in ("full", "early", "late")
    ]))
    long = per.select(F.col(family).alias("family"), F.col(fold).alias("fold"), scopes).where("evidence > 0")
    sets = [[F.col("scope")], [F.col("scope"), F.col("family")], [F.col("scope"), F.col("fold")],
            [F.col("scope"), F.col("family"), F.col("fold")]]
    return long.groupingSets(sets, "scope", "family", "fold").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("unjudged") > 0).alias("trainable_pairs"),
        F.count_if(F.col("unjudged") == 0).alias("zero_preference_pairs"),
        F.min("candidates").alias("candidates_min"), F.max("candidates").alias("candidates_max"),
        F.min("unjudged").alias("unjudged_min"), F.max("unjudged").alias("unjudged_max"),
        F.sum("candidates").alias("candidates"), F.sum("evidence").alias("evidence"),
        F.sum("preferences").alias("preferences"),
    )


def tie_structure(df: DataFrame, pair: str, score: str, ts: str, k: int = 5, limit=None) -> DataFrame:
    """Exact score ties: blocks, rows in them, blocks crossing rank k, tied rows sharing a time.

    Blocks are counted first; only the block table is ordered.
    """
    from ..scale import ordered_scan

    times = df.groupBy(pair, score, ts).agg(F.count(F.lit(1)).alias("same_time"))
    blocks = times.groupBy(pair, score).agg(
        F.sum("same_time").alias("size"),
        F.sum(F.when(F.col("same_time") > 1, F.col("same_time")).otherwise(0)).alias("shared"),
    )
    placed = ordered_scan(blocks, [F.col(score).desc()], [pair], sums={"last": "size"}, limit=limit)
    first = F.col("last") - F.col("size") + 1
    tied = F.col("size") > 1
    per = placed.groupBy(pair).agg(
        F.count_if(tied).alias("tie_blocks"),
        F.sum(F.when(tied, F.col("size")).otherwise(0)).alias("tied_rows"),
        F.count_if(tied & (first <= k) & (F.col("last") >= k)).alias("blocks_crossing_k"),
        F.sum(F.when(tied, F.col("shared")).otherwise(0)).alias("tied_rows_sharing_time"),
    )
    return per
