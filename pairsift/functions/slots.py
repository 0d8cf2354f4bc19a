"""Evidence slots: a short ordered list of ids kept as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import EVIDENCE_SLOTS, NO_EVIDENCE


def slot_array(cols: list[str], sentinel: str = NO_EVIDENCE) -> Column:
    """Trimmed, non-empty slot values in order."""
    trimmed = F.transform(F.array(*[F.col(c).cast("string") for c in cols]), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != "") & (x != sentinel))


def clean_slots(cols: list[str], sentinel: str = NO_EVIDENCE, k: int = 5) -> Column:
    """The first k usable slot values."""
    return F.slice(slot_array(cols, sentinel), 1, k)


def slots_to_long(df: DataFrame, id_col: str, cols: list[str] = EVIDENCE_SLOTS,
                  slot: str = "slot", value: str = "hand_id") -> DataFrame:
    """One row per slot."""
    return df.select(id_col, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [id_col], cols, slot, value
    )


def to_wide(df: DataFrame, key: str, pivot: str, value: str, values: list, prefix: str = "",
            keep: list[str] | None = None) -> DataFrame:
    """Fixed pivot values to columns named prefix + value."""
    return df.groupBy(key).agg(
        *[F.first(c, True).alias(c) for c in keep or []],
        *[F.max(F.when(F.col(pivot) == v, F.col(value))).alias(f"{prefix}{v}") for v in values],
    )


def finalize_slots(df: DataFrame, leading: list[str], cols: list[str] = EVIDENCE_SLOTS,
                   sentinel: str = NO_EVIDENCE) -> DataFrame:
    """Empty slots become the sentinel; fixed column order."""
    return df.select(
        *leading, *[F.coalesce(F.col(c).cast("string"), F.lit(sentinel)).alias(c) for c in cols]
    )
