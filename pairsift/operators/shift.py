"""Distribution shift and correlation."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import finite
from ..scale import ordered_scan, to_long
from .metrics import average_precision
from .windows import pct_rank_avg


def _smd(mean_a, var_a, mean_b, var_b) -> F.Column:
    pooled = F.sqrt((var_a + var_b) / 2)
    return F.when(pooled > 0, (mean_a - mean_b) / pooled).otherwise(F.lit(0.0))


def smd(df: DataFrame, group: str, a, b, cols: list[str]) -> DataFrame:
    """Standardised mean difference a - b per column, over the pooled population variance."""
    long = to_long(df.select(group, *cols), [group], cols)
    g = F.col(group)
    stats = long.groupBy("feature").agg(*[
        f(F.when(g == v, F.col("value"))).alias(f"{n}_{t}")
        for v, t in ((a, "a"), (b, "b")) for f, n in ((F.avg, "m"), (F.var_pop, "v"))
    ])
    return stats.select("feature", _smd(F.col("m_a"), F.col("v_a"), F.col("m_b"), F.col("v_b")).alias("smd"))


def _ks_from_long(long: DataFrame, group: str, a, b, by: list[str], limit=None) -> DataFrame:
    g = F.col(group)
    hist = long.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(
        F.count_if(g == a).alias("na"), F.count_if(g == b).alias("nb")
    )
    scan = ordered_scan(
        hist, [F.col("value")], by, sums={"ua": "na", "ub": "nb"}, totals={"ta": "na", "tb": "nb"}, limit=limit
    )
    gap = F.abs(F.try_divide(F.col("ua"), F.col("ta")) - F.try_divide(F.col("ub"), F.col("tb")))
    return scan.groupBy(*by).agg(F.max(gap).alias("ks"))


def ks_statistic(df: DataFrame, group: str, a, b, cols: list[str], limit=None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per column, from value counts."""
    return _ks_from_long(to_long(df.select(group, *cols), [group], cols), group, a, b, ["feature"], limit)


def spearman(df: DataFrame, x: str, y: str, limit=None) -> DataFrame:
    """Rank correlation with average ranks."""
    rows = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pct_rank_avg(rows, [], [x, y], "__r", limit)
    return ranked.agg(F.corr(f"{x}__r", f"{y}__r").alias("rho"))


def spearman_matrix(df: DataFrame, cols: list[str], limit=None) -> DataFrame:
    """Rank correlation of every two columns, long form."""
    ranked = pct_rank_avg(df.select(*cols), [], cols, "__r", limit)
    pairs = list(combinations(cols, 2))
    row = ranked.agg(*[F.corr(f"{a}__r", f"{b}__r").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("rho"))
        for i, (a, b) in enumerate(pairs)
    ])))


def univariate_ap(df: DataFrame, label: str, cols: list[str], key: str, limit=None) -> DataFrame:
    """AP of each column as a score, better of both directions; the base rate when constant."""
    long = to_long(df.select(key, label, *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in cols]), [key, label], cols)
    signed = long.select(
        key, label, "feature", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"), "value"
    ).withColumn("s", F.col("value") * F.col("sign"))
    ap = average_precision(signed, label, "s", key, ["feature", "sign"], limit=limit)
    best = ap.groupBy("feature").agg(F.max("ap").alias("ap"))
    flat = long.groupBy("feature").agg(
        (F.min("value") == F.max("value")).alias("constant"), F.avg(label).alias("rate")
    )
    return best.join(flat, "feature").select(
        "feature", F.when(F.col("constant"), F.col("rate")).otherwise(F.col("ap")).alias("univariate_ap")
    )


SHIFT_GROUPS = ("positive", "negative", "unlabeled", "evaluation")
SHIFT_PAIRS = (("positive", "negative"), ("negative", "unlabeled"), ("negative", "evaluation"), ("unlabeled", "evaluation"))


def shift_audit(groups: dict[str, DataFrame], cols: list[str], key: str, risk: str, limit=None) -> DataFrame:
    """Per feature: group means, 4 mean differences, 3 KS distances, univariate AP, risk correlation.

    The four groups are stacked once in long form and counted by value; every distance
    comes from those counts.
    """
    clean = {
        g: groups[g].select(key, *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in cols])
        for g in SHIFT_GROUPS
    }
    long = reduce(DataFrame.unionByName, [
        to_long(d, [], cols).withColumn("grp", F.lit(g)) for g, d in clean.items()
    ])
    g = F.col("grp")
    stats = long.groupBy("feature").agg(*[
        f(F.when(g == n, F.col("value"))).alias(f"{t}_{n}")
        for n in SHIFT_GROUPS for f, t in ((F.avg, "mean"), (F.var_pop, "var"))
    ])
    out = stats.select(
        "feature", *[f"mean_{n}" for n in SHIFT_GROUPS],
        *[
            _smd(*[F.col(f"{t}_{n}") for n in (a, b) for t in ("mean", "var")]).alias(f"smd_{a}_{b}")
            for a, b in SHIFT_PAIRS
        ],
    )
    hist = long.groupBy("feature", "value").agg(*[F.count_if(g == n).alias(f"n_{n}") for n in SHIFT_GROUPS])
    scan = ordered_scan(
        hist, [F.col("value")], ["feature"], limit=limit,
        sums={f"u_{n}": f"n_{n}" for n in SHIFT_GROUPS}, totals={f"t_{n}": f"n_{n}" for n in SHIFT_GROUPS},
    )
    cdf = lambda n: F.try_divide(F.col(f"u_{n}"), F.col(f"t_{n}"))
    ks = scan.groupBy("feature").agg(*[
        F.max(F.abs(cdf(a) - cdf(b))).alias(f"ks_{a}_{b}") for a, b in SHIFT_PAIRS[1:]
    ])
    known = clean["positive"].withColumn("label", F.lit(1)).unionByName(clean["negative"].withColumn("label", F.lit(0)))
    uni = univariate_ap(known, "label", cols, key, limit)
    ev = clean["evaluation"].join(groups["evaluation"].select(key, F.col(risk).alias("__risk")), key)
    ranked = pct_rank_avg(ev.drop(key), [], [*cols, "__risk"], "__r", limit)
    rho = ranked.agg(*[F.corr(f"{c}__r", "__risk__r").alias(c) for c in cols])
    rho = to_long(rho, [], cols, "feature", "rho").select(
        "feature", F.coalesce(finite("rho"), F.lit(0.0)).alias("risk_spearman")
    )
    return out.join(ks, "feature").join(uni, "feature").join(rho, "feature").orderBy(
        F.col("ks_negative_evaluation").desc(), F.col("feature")
    )


def ks_change(a, b) -> tuple[F.Column, F.Column]:
    """(relative, absolute) drop from a to b."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return (a - b) / F.greatest(a, F.lit(1e-12)), a - b
