"""Ranking, top-k and active sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.game import route_score
from ..functions.scalars import clip
from ..functions.slots import to_wide
from ..scale import ordered_scan
from ..schema import EVIDENCE_SLOTS, FAMILY_SIGNALS
from .quality import duplicate_keys, require_empty
from .windows import top_k


def slots_from_ranked(ranked: DataFrame, pair: str = "pair_id", value: str = "hand_id", k: int = 5) -> DataFrame:
    return to_wide(ranked, pair, "rank", value, list(range(1, k + 1)), "evidence_hand_")


def rank_evidence(pair_hands: DataFrame, predictions: DataFrame | None, family: str = "predicted_behavior",
                  k: int = 5) -> DataFrame:
    """Top k groups per pair by the signal of its predicted family, as slot columns.

    Without `predictions` the family is a column of the pair-hands.
    """
    work = pair_hands if predictions is None else pair_hands.join(predictions.select("pair_id", family), "pair_id")
    work = work.select("pair_id", "hand_id", route_score(family, FAMILY_SIGNALS).alias("evidence_score"))
    ranked = top_k(work, ["pair_id"], [F.col("evidence_score").desc(), F.col("hand_id")], k)
    return slots_from_ranked(ranked, k=k)


def unresolved_ties(df: DataFrame, pair: str, score: str, ts: str) -> DataFrame:
    return duplicate_keys(df, [pair, score, ts])


def top_k_strict(df: DataFrame, pair: str, score: str, ts: str, k: int = 5, item: str = "hand_id",
                 check: bool = True) -> DataFrame:
    """Top k by score, earlier time first; a tie in both is an error, ids never decide."""
    if check:
        require_empty(unresolved_ties(df, pair, score, ts), "score and time both tie")
    ranked = top_k(df, [pair], [F.col(score).desc(), F.col(ts)], k)
    return ranked.select(pair, "rank", item, ts, score)


def active_fraction(base_rate: float) -> float:
    """Share of rows that get a behaviour label."""
    return min(max(base_rate * 0.20, 0.005), 0.05)


def active_top_n(df: DataFrame, score: str, key: str, frac: float, name: str = "active", limit=None) -> DataFrame:
    """Mark the best round(n * frac) rows, at least one; ties by key."""
    ranked = ordered_scan(
        df, [F.col(score).desc(), F.col(key)], sums={"__rn": F.lit(1)}, totals={"__n": F.lit(1)}, limit=limit
    )
    wanted = F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(frac), 0))
    return ranked.withColumn(name, (F.col("__rn") <= wanted).cast("int")).drop("__rn", "__n")


def score_threshold(df: DataFrame, score: str, fracs: list[float], limit=None) -> dict[float, float]:
    """Score of the round(n * frac)-th best row, for each fraction below 1."""
    hist = df.groupBy(score).agg(F.count(F.lit(1)).alias("cnt"))
    scan = ordered_scan(hist, [F.col(score).desc()], sums={"upto": "cnt"}, totals={"n": "cnt"}, limit=limit)
    wanted = lambda f: F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(f), 0))
    row = scan.agg(*[
        F.max(F.when(F.col("upto") >= wanted(f), F.col(score))).alias(f"t{i}") for i, f in enumerate(fracs)
    ]).first()
    return {f: row[i] for i, f in enumerate(fracs)}


def active_threshold(df: DataFrame, score: str, frac: float, name: str = "active", limit=None) -> DataFrame:
    """Mark the best round(n * frac) rows together with every row tied at the boundary."""
    if frac >= 1.0:
        return df.withColumn(name, F.lit(1))
    cut = score_threshold(df, score, [frac], limit)[frac]
    return df.withColumn(name, (F.col(score) >= F.lit(cut)).cast("int"))


def top_report(df: DataFrame, by: str, n: int, key: str, absolute: bool = False) -> DataFrame:
    measure = F.abs(F.col(by)) if absolute else F.col(by)
    return df.orderBy(measure.desc(), F.col(key)).limit(n)


def argmax_class(probs: list[str], classes: list[str]) -> F.Column:
    """Class of the largest probability; ties go to the first class."""
    values = F.array(*probs)
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))



