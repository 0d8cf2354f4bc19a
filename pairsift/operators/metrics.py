"""Ranking and classification metrics. Results are small DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions.slots import clean_slots
from ..session import ensure_checkpoint_dir
from ..scale import exact_quantiles, ordered_scan, pick_linear, same_keys_join, to_long
from ..schema import EVIDENCE_SLOTS, FAMILIES
from .quality import require_empty
from .rank import score_threshold
from .windows import top_k


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def average_precision(df: DataFrame, label: str, score, key: str | None, by=None, name: str = "ap",
                      order: list | None = None, limit=None) -> DataFrame:
    """Precision averaged over the positives; score descending, ties by key, 0 without positives."""
    by = _by(by)
    s = F.col(score) if isinstance(score, str) else score
    rows = df.select(*by, F.col(label).cast("bigint").alias("__y"), s.alias("__s"), *([F.col(key).alias("__k")] if key else []))
    order = order or [F.col("__s").desc(), F.col("__k")]
    ranked = ordered_scan(rows, order, by, sums={"__pos": F.lit(1), "__hits": "__y"}, limit=limit)
    gain = F.when(F.col("__y") == 1, F.col("__hits") / F.col("__pos"))
    value = F.coalesce(F.try_divide(F.sum(gain), F.sum("__y")), F.lit(0.0))
    return ranked.groupBy(*by).agg(value.alias(name)) if by else ranked.agg(value.alias(name))


def one_row(parts: dict[str, DataFrame]) -> DataFrame:
    """Single-value tables side by side, in one row."""
    long = reduce(DataFrame.unionByName, [
        d.select(F.lit(n).alias("m"), F.col(d.columns[0]).cast("double").alias("v")) for n, d in parts.items()
    ])
    return long.agg(*[F.max(F.when(F.col("m") == n, F.col("v"))).alias(n) for n in parts])


def behavior_ap(df: DataFrame, truth: str, pred: str, score: str, key: str, families=FAMILIES, limit=None) -> DataFrame:
    """AP per family, where a row scores only for its predicted family."""
    wide = df.select(key, truth, pred, score, F.explode(F.array(*[F.lit(f) for f in families])).alias("family"))
    rows = wide.select(
        key, "family", F.coalesce(F.col(truth) == F.col("family"), F.lit(False)).cast("int").alias("y"),
        F.when(F.col(pred) == F.col("family"), F.col(score)).otherwise(F.lit(0.0)).alias("s"),
    )
    return average_precision(rows, "y", "s", key, "family", limit=limit)


def behavior_map(df: DataFrame, truth: str, pred: str, score: str, key: str, families=FAMILIES, limit=None) -> DataFrame:
    return behavior_ap(df, truth, pred, score, key, families, limit).agg(F.avg("ap").alias("behavior_map"))


def list_ap(relevant: Column, submitted: Column, k: int = 5) -> Column:
    """AP of a short ranked list against a short relevant list."""
    hits = F.transform(submitted, lambda x: F.array_contains(relevant, x).cast("double"))
    start = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("r"), F.lit(0.0).alias("t"))
    run = F.aggregate(hits, start, lambda a, x: F.struct(
        (a["h"] + x).alias("h"), (a["r"] + 1.0).alias("r"),
        (a["t"] + x * (a["h"] + x) / (a["r"] + 1.0)).alias("t"),
    ))
    return F.coalesce(F.try_divide(run["t"], F.least(F.size(relevant), F.lit(k)).cast("double")), F.lit(0.0))


def evidence_ap(truth: DataFrame, sub: DataFrame, label: str = "risk_score", key: str = "pair_id",
                slots: list[str] = EVIDENCE_SLOTS, k: int = 5) -> DataFrame:
    """Evidence AP of every true positive."""
    rel = truth.where(F.col(label) == 1).select(key, F.array_distinct(clean_slots(slots, k=len(slots))).alias("rel"))
    got = sub.select(key, clean_slots(slots, k=k).alias("got"))
    return rel.join(got, key, "left").select(
        key, F.coalesce(list_ap(F.col("rel"), F.col("got"), k), F.lit(0.0)).alias("evidence_ap")
    )


def evidence_map(truth: DataFrame, sub: DataFrame, label: str = "risk_score", key: str = "pair_id",
                 slots: list[str] = EVIDENCE_SLOTS, k: int = 5) -> DataFrame:
    per = evidence_ap(truth, sub, label, key, slots, k)
    return per.agg(F.coalesce(F.avg("evidence_ap"), F.lit(0.0)).alias("evidence_map5"))


def composite_score(truth: DataFrame, sub: DataFrame, key: str = "pair_id", families=FAMILIES, limit=None) -> DataFrame:
    """0.70 pair AP + 0.20 evidence MAP@5 + 0.10 behaviour MAP, with the parts."""
    joined = truth.select(
        key, F.col("risk_score").cast("int").alias("y"), F.col("predicted_behavior").alias("truth_family")
    ).join(sub.select(key, F.col("risk_score").cast("double").alias("risk"), "predicted_behavior"), key)
    row = one_row({
        "pair_ap": average_precision(joined, "y", "risk", key, limit=limit),
        "evidence_map5": evidence_map(truth, sub, key=key),
        "behavior_map": behavior_map(joined, "truth_family", "predicted_behavior", "risk", key, families, limit),
    })
    return row.withColumn(
        "score", 0.70 * F.col("pair_ap") + 0.20 * F.col("evidence_map5") + 0.10 * F.col("behavior_map")
    )


def ap_at_k(df: DataFrame, pair: str, label: str, score: str, key: str, k: int = 5) -> DataFrame:
    """AP@k per pair; each task keeps k rows per pair before the shuffle."""
    best = top_k(df.select(pair, label, score, key), [pair], [F.col(score).desc(), F.col(key)], k)
    upto = W.partitionBy(pair).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    y = F.col(label).cast("int")
    gains = best.withColumn("__h", F.sum(y).over(upto)).groupBy(pair).agg(
        F.sum(F.when(y == 1, F.col("__h") / F.col("rank"))).alias("gain")
    )
    n = df.groupBy(pair).agg(F.sum(y).alias("relevant"))
    value = F.coalesce(F.try_divide(F.col("gain"), F.least(F.col("relevant"), F.lit(k)).cast("double")), F.lit(0.0))
    return n.join(gains, pair, "left").select(pair, value.alias("ap"))


def map_at_k(df: DataFrame, pair: str, label: str, score: str, key: str, k: int = 5) -> DataFrame:
    return ap_at_k(df, pair, label, score, key, k).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map_at_k"))


def _tie_ap(blocks: DataFrame, totals: DataFrame, pair: str, score: str, k: int, name: str) -> DataFrame:
    """`totals` (pair, relevant, ...) with the expected AP@k of its tie blocks (pair, score, n, r)."""
    first = top_k(
        blocks.select(pair, score, F.col("n").alias("__n"), F.col("r").alias("__r")), [pair],
        [F.col(score).desc()], k, "__block",
    )
    before = W.partitionBy(pair).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    placed = first.select(
        pair, "__n", "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__p"),
        F.coalesce(F.sum("__r").over(before), F.lit(0)).alias("__q"),
    ).where(F.col("__p") < k)
    n, r, p, q = (F.col(c).cast("double") for c in ("__n", "__r", "__p", "__q"))
    seats = F.sequence(F.lit(1), F.least(F.col("__n"), F.lit(k) - F.col("__p")).cast("int"))
    gain = F.aggregate(
        seats, F.lit(0.0),
        lambda acc, j: acc + (r / n) * (q + 1.0 + (j - 1) * (r - 1.0) / F.greatest(n - 1.0, F.lit(1.0))) / (p + j),
    )
    sums = placed.groupBy(pair).agg(F.sum(gain).alias("gain"))
    value = F.coalesce(F.try_divide(F.col("gain"), F.least(F.col("relevant"), F.lit(k)).cast("double")), F.lit(0.0))
    return totals.join(sums, pair).select(*[c for c in totals.columns if c != "relevant"], value.alias(name))


def expected_tie_ap(df: DataFrame, pair: str, label: str, score: str, k: int = 5, name: str = "query_ap5") -> DataFrame:
    """Expected AP@k per pair when rows with equal scores come in random order.

    Only the first k tie blocks can reach rank k, and blocks are counted before the shuffle.
    """
    blocks = df.groupBy(pair, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("r")
    )
    return _tie_ap(blocks, blocks.groupBy(pair).agg(F.sum("r").alias("relevant")), pair, score, k, name)


def query_ap(df: DataFrame, score: str, pair: str = "pair_id", pool: str = "table_id", fold: str = "outer_fold",
             label: str = "is_evidence", k: int = 5, check: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Tie-aware AP per pair with its pool, fold and counts; `keep` are further pair attributes."""
    keep = [pool, fold, *(keep or [])]
    blocks = df.groupBy(pair, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("r"),
        *[F.min(c).alias(c) for c in keep], F.max(pool).alias("__pool"),
    )
    meta = blocks.groupBy(pair).agg(
        *[F.min(c).alias(c) for c in keep], F.sum("n").alias("candidate_hands"), F.sum("r").alias("evidence_hands"),
        F.sum("r").alias("relevant"), F.max("__pool").alias("__pool"),
    )
    if check:
        require_empty(
            meta.where((F.col(pool) != F.col("__pool")) | (F.col("evidence_hands") == 0)),
            "a pair lies in several pools, or has no evidence",
        )
    return _tie_ap(blocks, meta.drop("__pool"), pair, score, k, "query_ap5")


def _harmonic_gap(a: Column, b: Column) -> Column:
    """Sum of 1/i for a < i <= b, for large b - a; the first 64 terms are added one by one."""
    small = F.least(a + 64, b)
    head = F.aggregate(F.sequence(a + 1, small), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / i)
    x, y = small.cast("double"), b.cast("double")
    tail = F.log1p((y - x) / x) - (y - x) / (2 * x * y) + (F.lit(1.0) / (x * x) - F.lit(1.0) / (y * y)) / 12
    return head + F.when(b > small, tail).otherwise(0.0)


def _run_gain(r0: Column, p0: Column, r: Column) -> Column:
    """Sum over i = 1..r of (r0 + i) / (p0 + i)."""
    loop = F.aggregate(
        F.sequence(F.lit(1), F.least(r, F.lit(256)).cast("int")), F.lit(0.0),
        lambda acc, i: acc + (r0 + i) / (p0 + i),
    )
    closed = r + (r0 - p0) * _harmonic_gap(p0, p0 + r)
    return F.when(r <= 0, 0.0).when(r <= 256, loop).otherwise(closed)


def tie_blocks(df: DataFrame, label: str, score: str, by=None, limit=None) -> DataFrame:
    """Blocks of equal score with size n, positives r, and both counts before the block (p0, r0)."""
    by = _by(by)
    blocks = df.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("r")
    )
    scan = ordered_scan(
        blocks, [F.col(score).desc()], by, sums={"__n": "n", "__r": "r"}, totals={"positives": "r"}, limit=limit
    )
    return scan.withColumns({"p0": F.col("__n") - F.col("n"), "r0": F.col("__r") - F.col("r")}).drop("__n", "__r")


def tie_views(df: DataFrame, label: str, score: str, key: str, by=None, limit=None) -> DataFrame:
    """AP by key order, by grouped ties, and in the best and worst order of the ties."""
    by = _by(by)
    c = F.col
    blocks = tie_blocks(df, label, score, by, limit)
    total = F.max("positives")
    part = lambda e: F.coalesce(F.try_divide(F.sum(e), total), F.lit(0.0))
    views = [
        part(c("r") * (c("r0") + c("r")) / (c("p0") + c("n"))).alias("grouped_tie_ap"),
        part(_run_gain(c("r0"), c("p0"), c("r"))).alias("best_tie_ap"),
        part(_run_gain(c("r0"), c("p0") + c("n") - c("r"), c("r"))).alias("worst_tie_ap"),
        F.coalesce(F.sum(F.when(c(score) == 0, c("n"))), F.lit(0)).alias("zero_tie_rows"),
        F.coalesce(F.sum(F.when(c(score) == 0, c("r"))), F.lit(0)).alias("zero_tie_positive_rows"),
    ]
    out = blocks.groupBy(*(by or [F.lit(0).alias("__all")])).agg(*views)
    ap = average_precision(df, label, score, key, by, "key_order_ap", limit=limit)
    if not by:
        ap = ap.withColumn("__all", F.lit(0))
    return out.join(ap, by or ["__all"]).drop("__all")


#: Rounds of the keyed permutation, and the prime of its arithmetic.
SHUFFLE_ROUNDS, SHUFFLE_PRIME = 24, 2147483647


def shuffled_place(place: Column, size: Column, a: Column, b: Column) -> Column:
    """A permutation of 0 .. size - 1 that the two keys (0 .. 2^28 - 1) choose.

    In each round of this swap-or-not shuffle a place and its partner (k - place) mod size
    change places if a bit drawn for the larger of both says so. So every round, and all
    together, is a permutation, whatever the size, and one place is found without the others.
    """
    prime = F.lit(SHUFFLE_PRIME)

    def turn(x: Column, i: Column) -> Column:
        key = (a + (i + 1) * b) % prime
        other = ((key * 48271 % prime) % size + size - x) % size
        drawn = (F.greatest(x, other) % prime) * (key % 1000003 + 1) % prime * 48271 % prime
        return F.when(F.shiftright(drawn, 12).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(SHUFFLE_ROUNDS - 1).cast("long")), place.cast("long"), turn)


def shuffle_keys(seed: int, *parts) -> list[Column]:
    """Two keys of 28 bits from an md5 of the seed and the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))
    return [F.conv(F.substring(digest, at, 7), 16, 10).cast("long") for at in (1, 8)]


def random_tie_draws(df: DataFrame, label: str, score: str, key: str, by=None, draws: int = 512,
                     seed: int = 9917, limit=None) -> DataFrame:
    """AP per draw with ties in random order.

    In a block of n tied rows, the positives have the first places in order of `key`, and a
    permutation of all n places, keyed by draw and block, moves them. Only positives of
    blocks that mix both labels become rows, one for each draw.
    """
    by = _by(by)
    c = F.col
    ensure_checkpoint_dir(df.sparkSession)
    blocks = tie_blocks(df, label, score, by, limit).checkpoint()
    mixed = (c("r") > 0) & (c("r") < c("n"))
    group = by or [F.lit(0).alias("__all")]
    fixed = blocks.groupBy(*group).agg(
        F.coalesce(F.sum(F.when(~mixed, _run_gain(c("r0"), c("p0"), c("r")))), F.lit(0.0)).alias("fixed"),
        F.max("positives").alias("positives"),
    )
    gb = by or ["__all"]
    every = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    base = fixed.select("*", every)
    most = blocks.where(mixed).agg(F.max("r")).first()[0] or 0
    positives = same_keys_join(
        df.where(c(label).cast("bigint") == 1).select(*by, score, key), blocks.where(mixed).select(*by, score, "n", "p0", "r0"), [*by, score], "inner",
    )
    numbered_ = ordered_scan(positives, [c(key)], [*by, score], sums={"j": F.lit(1)}, limit=limit, largest=most)
    rows = numbered_.select(*by, score, "n", "p0", "r0", (c("j") - 1).alias("j"), every)
    a, b = shuffle_keys(seed, "draw", "p0", "n")
    rows = rows.withColumns({"__a": a, "__b": b})
    rows = rows.withColumn("place", shuffled_place(c("j"), c("n"), c("__a"), c("__b"))).drop("__a", "__b")
    placed = ordered_scan(rows, [c("place")], [*by, "draw", score], sums={"h": F.lit(1)}, limit=limit, largest=most)
    gain = F.sum((c("r0") + c("h")) / (c("p0") + c("place") + 1))
    per = placed.groupBy(*group, "draw").agg(gain.alias("gain"))
    both = same_keys_join(base, per, [*gb, "draw"], "left")
    value = F.coalesce(F.try_divide(c("fixed") + F.coalesce(c("gain"), F.lit(0.0)), c("positives")), F.lit(0.0))
    return both.select(*gb, "draw", value.alias("ap")).drop("__all")


def random_tie_ap(df: DataFrame, label: str, score: str, key: str, by=None, draws: int = 512,
                  seed: int = 9917, limit=None) -> DataFrame:
    """Mean, population deviation, minimum and maximum of AP over random tie orders."""
    per = random_tie_draws(df, label, score, key, by, draws, seed, limit)
    return per.groupBy(*_by(by)).agg(
        F.avg("ap").alias("random_tie_mean_ap"), F.stddev_pop("ap").alias("random_tie_std_ap"),
        F.min("ap").alias("random_tie_min_ap"), F.max("ap").alias("random_tie_max_ap"),
    )


# Active fractions of the behaviour curve.
ACTIVE_FRACTIONS = (0.005, 0.01, 0.02, 0.04, 0.05, 0.10, 0.20, 1.0)


def curve_rows(df: DataFrame, truth: str, pred: str, score: str, key: str, fractions=ACTIVE_FRACTIONS,
               families=FAMILIES, limit=None) -> DataFrame:
    """Rows (fraction, family, y, s, active) of the behaviour curve."""
    part = [f for f in fractions if f < 1.0]
    cuts = score_threshold(df, score, part, limit) if part else {}
    levels = F.explode(F.array(*[
        F.struct(F.lit(float(f)).alias("fraction"), F.lit(cuts.get(f, float("-inf"))).cast("double").alias("cut"))
        for f in fractions
    ])).alias("lvl")
    wide = df.select(key, truth, pred, score, levels).select("*", F.explode(F.array(*[F.lit(f) for f in families])).alias("family"))
    active = F.col(score) >= F.col("lvl.cut")
    return wide.select(
        key, F.col("lvl.fraction").alias("fraction"), "family", active.cast("int").alias("active"),
        F.coalesce(F.col(truth) == F.col("family"), F.lit(False)).cast("int").alias("y"),
        F.when(active & (F.col(pred) == F.col("family")), F.col(score).cast("double")).otherwise(F.lit(0.0)).alias("s"),
    )


def behavior_curve(df: DataFrame, truth: str, pred: str, score: str, key: str, fractions=ACTIVE_FRACTIONS,
                   families=FAMILIES, draws: int = 0, limit=None) -> DataFrame:
    """Per active fraction: active rows, and the tie views averaged over families."""
    rows = curve_rows(df, truth, pred, score, key, fractions, families, limit)
    views = tie_views(rows, "y", "s", key, ["fraction", "family"], limit)
    names = ["key_order_ap", "grouped_tie_ap", "best_tie_ap", "worst_tie_ap"]
    if draws:
        extra = random_tie_ap(rows, "y", "s", key, ["fraction", "family"], draws, limit=limit)
        views, names = views.join(extra, ["fraction", "family"]), [*names, "random_tie_mean_ap"]
    macro = views.groupBy("fraction").agg(*[F.avg(n).alias(n) for n in names])
    active = rows.where(F.col("family") == families[0]).groupBy("fraction").agg(
        F.sum("active").alias("active_rows"), F.avg("active").alias("actual_active_fraction")
    )
    return active.join(macro, "fraction")


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("rows"))


def classification_report(df: DataFrame, truth: str, pred: str, probs: dict[str, str]) -> DataFrame:
    """Accuracy, recall per class, macro recall, log loss and Brier score in one row."""
    eps = 2.220446049250313e-16
    t = F.col(truth)
    hit = (F.col(pred) == t).cast("double")
    p_true = F.coalesce(*[F.when(t == k, F.col(c)) for k, c in probs.items()])
    brier = reduce(lambda a, b: a + b, [
        (F.col(c) - F.when(t == k, 1.0).otherwise(0.0)) * (F.col(c) - F.when(t == k, 1.0).otherwise(0.0))
        for k, c in probs.items()
    ])
    out = df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"),
        *[F.avg(F.when(t == k, hit)).alias(f"recall_{k}") for k in probs],
        F.avg(-F.ln(F.least(F.greatest(p_true, F.lit(eps)), F.lit(1 - eps)))).alias("log_loss"),
        F.avg(brier).alias("brier"),
    )
    recalls = reduce(lambda a, b: a + b, [F.col(f"recall_{k}") for k in probs])
    return out.withColumn("macro_recall", recalls / len(probs))


def family_ap(df: DataFrame, label: str, family: str, score: str, key: str, families=FAMILIES, limit=None) -> DataFrame:
    """Positives of one family against all negatives."""
    fams = F.array(*[F.lit(f) for f in families])
    mine = F.when(F.col(label) == 0, fams).otherwise(F.filter(fams, lambda f: f == F.col(family)))
    rows = df.select(key, label, score, F.explode(mine).alias("family"))
    return average_precision(rows, label, score, key, "family", limit=limit)


def pool_ap(df: DataFrame, label: str, score: str, key: str, pool: str, limit=None) -> DataFrame:
    """AP of every pool that holds both classes."""
    mixed = df.groupBy(pool).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi")
    return average_precision(df.join(mixed, pool, "left_semi"), label, score, key, pool, limit=limit)


def compare_pools(base: DataFrame, cand: DataFrame, pool: str, tol: float = 1e-12) -> DataFrame:
    """Pools, mean and median change, wins, ties and losses over the common pools."""
    d = base.select(pool, F.col("ap").alias("a")).join(cand.select(pool, F.col("ap").alias("b")), pool)
    d = d.select((F.col("b") - F.col("a")).alias("d"))
    parts = {
        "pools": F.count(F.lit(1)), "mean_delta": F.avg("d"),
        "wins": F.count_if(F.col("d") > tol), "ties": F.count_if(F.abs("d") <= tol),
        "losses": F.count_if(F.col("d") < -tol),
    }
    stats = d.agg(*[v.alias(k) for k, v in parts.items()])
    median = exact_quantiles(d, [], ["d"], {"__median": 0.5})
    row = one_row({**{k: stats.select(k) for k in parts}, "median_delta": median.select("d__median")})
    whole = ("pools", "wins", "ties", "losses")
    return row.select(*[F.col(c).cast("bigint").alias(c) if c in whole else F.col(c) for c in row.columns])


def percentile_rows(pos: DataFrame, unl: DataFrame, pool: str, score: str, limit=None) -> DataFrame:
    """Mid-rank of each positive score among its pool's unlabelled scores, with its frequency."""
    side = lambda d, u, p: d.select(pool, score, F.lit(u).alias("u"), F.lit(p).alias("p"))
    hist = side(unl, 1, 0).unionByName(side(pos, 0, 1)).groupBy(pool, score).agg(
        F.sum("u").alias("u"), F.sum("p").alias("p")
    )
    scan = ordered_scan(hist, [F.col(score)], [pool], sums={"upto": "u"}, totals={"all": "u"}, limit=limit)
    pct = (F.col("upto") - F.col("u") + 0.5 * F.col("u")) / F.col("all")
    return scan.where((F.col("p") > 0) & (F.col("all") > 0)).select(pool, score, pct.alias("pct"), F.col("p").alias("freq"))


def positive_percentiles(pos: DataFrame, unl: DataFrame, pool: str, score: str, limit=None) -> DataFrame:
    """Mean and median percentile, and the share at or above .95 and .99."""
    rows = percentile_rows(pos, unl, pool, score, limit)
    hist = rows.groupBy("pct").agg(F.sum("freq").alias("cnt"))
    scan = ordered_scan(hist, [F.col("pct")], sums={"upto": "cnt"}, totals={"n": "cnt"}, limit=limit)
    at = lambda t: F.sum(F.when(F.col("pct") >= t, F.col("cnt")).otherwise(0)) / F.max("n")
    return scan.agg(
        (F.sum(F.col("pct") * F.col("cnt")) / F.max("n")).alias("percentile_mean"),
        pick_linear(0.5, "pct").alias("percentile_median"),
        at(0.95).alias("above_p95_rate"), at(0.99).alias("above_p99_rate"),
    )


def metric_tree(query: DataFrame, value: str = "query_ap5", family: str = "behavior_family",
                fold: str = "outer_fold", pool: str = "table_id") -> DataFrame:
    """Mean and coverage overall, per family, per fold, per both, and the macro mean of families."""
    q = query.select(
        F.col(family).alias("family"), F.col(fold).alias("fold"), F.col(pool).alias("pool"),
        F.col(value).alias("v"), "candidate_hands", "evidence_hands",
    )
    sets = [[], [F.col("family")], [F.col("fold")], [F.col("fold"), F.col("family")]]
    tree = q.groupingSets(sets, "family", "fold").agg(
        F.grouping_id().alias("gid"), F.avg("v").alias("value"), F.count(F.lit(1)).alias("queries"),
        F.sum("candidate_hands").alias("candidates"), F.sum("evidence_hands").alias("evidence"),
        F.count_distinct("pool").alias("pools"),
    )
    level = (
        F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "family")
        .when(F.col("gid") == 2, "fold").otherwise("fold_family")
    )
    counts = ["queries", "candidates", "evidence", "pools"]
    tree = tree.select(level.alias("level"), "family", "fold", "value", *counts)
    whole = tree.where(F.col("level") == "overall")
    macro = tree.where(F.col("level").isin("family", "overall")).agg(
        F.avg(F.when(F.col("level") == "family", F.col("value"))).alias("value"),
        *[F.max(F.when(F.col("level") == "overall", F.col(c))).alias(c) for c in counts],
    ).select(
        F.lit("macro_family").alias("level"), F.lit(None).cast(whole.schema["family"].dataType).alias("family"),
        F.lit(None).cast(whole.schema["fold"].dataType).alias("fold"), "value", *counts,
    )
    return tree.unionByName(macro)


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    d = F.col(score) - F.col(label)
    return df.agg(F.avg(d * d).alias("brier"))


def fold_deltas(df: DataFrame, label: str, base: str, cand: str, key: str, fold: str, limit=None) -> DataFrame:
    """AP of base and candidate per fold, and the change."""
    a = average_precision(df, label, base, key, fold, "base_ap", limit=limit)
    b = average_precision(df, label, cand, key, fold, "cand_ap", limit=limit)
    return a.join(b, fold).withColumn("delta", F.col("cand_ap") - F.col("base_ap"))


def fold_delta_summary(folds: DataFrame) -> DataFrame:
    """Worst-fold change (minimum minus minimum) and smallest change."""
    return folds.agg(
        (F.min("cand_ap") - F.min("base_ap")).alias("worst_fold_delta"), F.min("delta").alias("min_delta"),
        F.avg("delta").alias("mean_delta"),
    )


def transfer_summary(folds: DataFrame, direction: str = "direction") -> DataFrame:
    """Per-direction AP table (direction, ap) to worst transfer and directional gap."""
    return folds.agg(F.min("ap").alias("worst_ap"), (F.max("ap") - F.min("ap")).alias("directional_gap"))


def evaluate_gate(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Check (metric, value) rows against (metric, op, threshold) rules; `overall` is their AND."""
    spark = metrics.sparkSession
    table = spark.createDataFrame([(m, op, float(t)) for m, op, t in rules], "metric string, op string, threshold double")
    v, t = F.col("value"), F.col("threshold")
    passed = (
        F.when(F.col("op") == ">=", v >= t).when(F.col("op") == "<=", v <= t)
        .when(F.col("op") == ">", v > t).otherwise(v < t)
    )
    checks = table.join(metrics.select("metric", "value"), "metric", "left").withColumn(
        "passed", F.coalesce(passed, F.lit(False)).cast("int")
    )
    overall = checks.agg(F.min("passed").alias("passed")).select(
        F.lit("overall").alias("metric"), F.lit("").alias("op"), F.lit(None).cast("double").alias("threshold"),
        F.lit(None).cast("double").alias("value"), "passed",
    )
    return checks.select("metric", "op", "threshold", "value", "passed").unionByName(overall)


# Gate rules (metric, comparison, threshold) per study.
GATES = {
    "bagged_pu": [("ap_delta", ">=", -0.01), ("worst_fold_delta", ">=", -0.03), ("percentile_median_delta", ">=", 0.02)],
    "pool_rank": [("ap_delta", ">=", -0.015), ("worst_fold_delta", ">=", -0.03), ("p95_delta", ">=", -0.02),
                  ("ks_drop", ">=", 0.30), ("count_rho", "<=", 0.10)],
    "interaction": [("ap_delta", ">=", -0.005), ("worst_fold_delta", ">=", -0.02), ("p95_delta", ">=", 0.01),
                    ("ks", "<=", 0.02), ("count_rho", "<=", 0.10)],
    "time_stability": [("early_to_late_delta", ">=", -0.005), ("late_to_early_delta", ">=", -0.005),
                       ("time_fold_delta", ">=", -0.03), ("worst_ap", ">=", 0.90), ("directional_gap", "<=", 0.05)],
    "marginal_impact": [("ap_delta", ">=", -0.005), ("worst_fold_delta", ">=", -0.02), ("p95_delta", ">=", 0.0),
                        ("ks", "<=", 0.02), ("count_rho", "<=", 0.10), ("early_to_late_delta", ">=", 0.01),
                        ("late_to_early_delta", ">=", 0.01), ("time_fold_delta", ">=", -0.02),
                        ("directional_gap", "<=", 0.05)],
    "influence": [("ap_delta", ">=", 0.003), ("worst_fold_delta", ">=", -0.02), ("p95_delta", ">=", 0.005),
                  ("ks", "<=", 0.02), ("count_rho", "<=", 0.10), ("feature_rho", "<=", 0.20),
                  ("early_to_late_delta", ">=", 0.01), ("late_to_early_delta", ">=", 0.01),
                  ("time_fold_delta", ">=", -0.02), ("worst_ap", ">=", 0.84), ("directional_gap", "<=", 0.05)],
    "global_ranking": [("ap_delta", ">=", 0.003), ("worst_fold_delta", ">=", -0.02), ("p95_delta", ">=", 0.005),
                       ("ks", "<=", 0.02), ("count_rho", "<=", 0.10), ("early_to_late_delta", ">=", 0.01),
                       ("late_to_early_delta", ">=", 0.01), ("time_fold_delta", ">=", -0.02),
                       ("worst_ap", ">=", 0.84), ("directional_gap", "<=", 0.05)],
    "hard_negative": [("ap_delta", ">=", 0.003), ("worst_fold_delta", ">=", -0.02), ("p95_delta", ">=", 0.005),
                      ("ks", "<=", 0.02), ("count_rho", "<=", 0.10)],
    "hard_negative_time": [("early_to_late_delta", ">=", 0.01), ("late_to_early_delta", ">=", 0.01),
                           ("time_fold_delta", ">=", -0.02), ("worst_ap", ">=", 0.84), ("directional_gap", "<=", 0.05)],
    "elkan_noto": [("ap_delta", ">=", -0.01), ("worst_fold_delta", ">=", -0.03), ("p95_delta", ">=", 0.01),
                   ("p99_delta", ">=", 0.0), ("ks", "<=", 0.02), ("count_rho", "<=", 0.10)],
    "evidence_primary": [("overall_delta", ">=", 0.040), ("lower_bound", ">", 0.0), ("family_delta_min", ">=", 0.0),
                         ("positive_folds", ">=", 4)],
    "evidence_attribution": [("macro_delta", ">=", 0.005), ("isolation_delta", ">=", 0.0)],
    "evidence_time": [("macro_delta", ">=", 0.020), ("overall_delta", ">", 0.0), ("lower_bound", ">", 0.0),
                      ("family_delta_min", ">=", 0.0), ("positive_folds", ">=", 4)],
}


def saturation(df: DataFrame, score: str, bound: float = 1.0) -> DataFrame:
    """Share of scores at the bound, and share of distinct scores."""
    return df.agg(
        F.avg(F.when(F.col(score) >= bound, 1.0).otherwise(0.0)).alias("at_bound"),
        (F.count_distinct(score) / F.count(F.lit(1))).alias("distinct_share"),
    )


def inversions(df: DataFrame, label: str, scores: list[str], key: str, limit=None) -> DataFrame:
    """Per positive and score: how many negatives score at least as high."""
    long = to_long(df.select(key, label, *scores), [key, label], scores, "score_name", "s")
    hist = long.groupBy("score_name", "s").agg(F.count_if(F.col(label) == 0).alias("neg"))
    scan = ordered_scan(hist, [F.col("s").desc()], ["score_name"], sums={"outranking": "neg"}, limit=limit)
    pos = long.where(F.col(label) == 1).join(scan.select("score_name", "s", "outranking"), ["score_name", "s"])
    return pos.groupBy(key).agg(*[
        F.max(F.when(F.col("score_name") == s, F.col("outranking"))).alias(f"{s}_outranking") for s in scores
    ])


def inversion_changes(df: DataFrame, label: str, base: str, cand: str, key: str, limit=None) -> DataFrame:
    """Base and remaining inversions, and how many the candidate fixed or created.

    Counting (positive, negative) pairs by two scores is a two-dimensional dominance count.
    Negatives are filed under every binary block of their base rank and positives look up
    the blocks that cover the ranks outranking them, so rows grow as n log n.
    """
    per = inversions(df, label, [base, cand], key, limit)
    totals = per.agg(F.sum(f"{base}_outranking").alias("b"), F.sum(f"{cand}_outranking").alias("c"),
                     F.count_if(F.col(f"{cand}_outranking") < F.col(f"{base}_outranking")).alias("fewer"),
                     F.count_if(F.col(f"{cand}_outranking") > F.col(f"{base}_outranking")).alias("more"))
    # Dense rank of the base score, best first: negatives at ranks <= the positive's outrank it.
    ranks = df.groupBy(base).agg(F.count(F.lit(1)).alias("__c"))
    dense = ordered_scan(ranks, [F.col(base).desc()], sums={"rank": F.lit(1)}, limit=limit).select(base, "rank")
    rows = df.select(label, base, cand).join(dense, base)
    bits = max(1, int(dense.agg(F.max("rank")).first()[0] or 1).bit_length())
    levels = F.sequence(F.lit(0), F.lit(bits))
    neg = rows.where(F.col(label) == 0).groupBy("rank", cand).agg(F.count(F.lit(1)).alias("neg"))
    neg = neg.select(cand, "neg", "rank", F.explode(levels).alias("lvl"))
    neg = neg.select(cand, "neg", F.lit(0).alias("pos"), "lvl", F.expr("shiftright(rank, lvl)").alias("block"))
    # [0, rank + 1) splits into one block per set bit of rank + 1.
    pos = rows.where(F.col(label) == 1).groupBy("rank", cand).agg(F.count(F.lit(1)).alias("pos"))
    pos = pos.select(cand, "pos", (F.col("rank") + 1).alias("end"), F.explode(levels).alias("lvl"))
    pos = pos.where(F.expr("shiftright(end, lvl) % 2 = 1"))
    pos = pos.select(cand, F.lit(0).alias("neg"), "pos", "lvl", (F.expr("shiftright(end, lvl)") - 1).alias("block"))
    hist = neg.unionByName(pos).groupBy("lvl", "block", cand).agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    scan = ordered_scan(hist, [F.col(cand).desc()], ["lvl", "block"], sums={"above": "neg"}, limit=limit)
    kept = scan.agg(F.coalesce(F.sum(F.col("above") * F.col("pos")), F.lit(0)).alias("k"))
    row = one_row({
        "base_inversions": totals.select("b"), "remaining_inversions": totals.select("c"), "kept": kept,
        "positives_with_fewer": totals.select("fewer"), "positives_with_more": totals.select("more"),
    })
    i = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return row.select(
        i("base_inversions").alias("base_inversions"), i("remaining_inversions").alias("remaining_inversions"),
        (i("base_inversions") - i("kept")).alias("fixed"), (i("remaining_inversions") - i("kept")).alias("created"),
        i("positives_with_fewer").alias("positives_with_fewer"), i("positives_with_more").alias("positives_with_more"),
    )


def hard_positives(df: DataFrame, label: str, base: str, cands: list[str], key: str, keep: list[str] | None = None,
                   limit=None) -> DataFrame:
    """Positives with their inversion counts and the net change per candidate, worst first."""
    counts = inversions(df, label, [base, *cands], key, limit)
    out = df.where(F.col(label) == 1).select(key, *(keep or []), base, *cands).join(counts, key)
    out = out.withColumns({
        f"{c}_net_removed": F.col(f"{base}_outranking") - F.col(f"{c}_outranking") for c in cands
    })
    return out.orderBy(F.col(f"{base}_outranking").desc(), F.col(key))
