"""Choosing and deriving feature columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..scale import as_col

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "decimal")
# Identifier columns of the input tables.
IDENTIFIERS = ("label", "pair_id", "player_1", "player_2", "table_id")
EVIDENCE_IDENTIFIERS = (
    "pair_id", "hand_id", "player_1", "player_2", "table_id", "table_id_1", "table_id_2", "target",
)
# Name parts whose evidence features also get a within-pair percentile.
RANK_TOKENS = (
    "signal", "transfer", "contribution", "net_", "pot_", "aggress", "raise", "bet", "call",
    "check", "fold", "showdown", "pressure", "amount", "active", "hole",
)


def feature_columns(df: DataFrame, exclude=IDENTIFIERS, exclude_prefix=("account_age_days_",)) -> list[str]:
    """Numeric or boolean columns that are no identifiers."""
    return [
        name for name, kind in df.dtypes
        if kind.startswith(NUMERIC) and name not in exclude
        and not any(name.startswith(p) for p in exclude_prefix)
    ]


def ranked_columns(cols: list[str]) -> list[str]:
    return [c for c in cols if any(t in c for t in RANK_TOKENS)]


def time_stable(cols: list[str]) -> list[str]:
    """Drop columns that describe when in the period something happened."""
    return [
        c for c in cols
        if not c.startswith("phase_progress") and "temporal_range" not in c
        and not re.search(r"__t[0-3]$", c)
    ]


# Columns that must never be model features.
FORBIDDEN = (
    "pair_id", "hand_id", "player_1", "player_2", "table_id", "table_id_1", "table_id_2",
    "phase_progress", "label", "label_status", "behavior_family", "fold", "outer_fold",
    "inner_fold", "evidence_rank", "is_evidence", "started_at",
)


def forbidden_columns(cols: list[str], extra=()) -> list[str]:
    """Identifiers, labels and row-order columns among the proposed features."""
    return sorted(
        c for c in cols
        if c in FORBIDDEN or c in extra or c.endswith("_id") or "row_order" in c
    )


def interact(df: DataFrame, cols: list[str], class_col, classes: list[str]) -> DataFrame:
    """Add each column times each class indicator, classes in the given order."""
    cls = as_col(class_col)
    return df.withColumns({
        f"{c}__x__{k}": F.when(cls == k, F.col(c)).otherwise(F.lit(0.0))
        for k in classes for c in cols
    })


def interacted_names(cols: list[str], classes: list[str]) -> list[str]:
    return [*cols, *[f"{c}__x__{k}" for k in classes for c in cols]]


def exposure_normalize(df: DataFrame, count_scale: float, drop=(), count="shared_hands_calc",
                       per_hundred=("dominant_flow_bb",)) -> DataFrame:
    """Scale the group count, turn listed totals into rates per 100 groups, drop listed columns."""
    n = F.nullif(F.col(count).cast("double"), F.lit(0.0))
    rates = {c: F.lit(100.0) * F.col(c).cast("double") / n for c in per_hundred if c in df.columns}
    return df.withColumns({**rates, count: n * F.lit(count_scale)}).drop(*drop)


def sample_sensitive(cols: list[str], ks: dict[str, float], threshold: float = 0.075) -> list[str]:
    """Maxima and time-bin features whose shift is at least the threshold."""
    return [
        c for c in cols
        if (c.endswith("__max") or re.search(r"__t[0-3]$", c)) and ks.get(c, 0.0) >= threshold
    ]
