"""Set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .quality import multi_valued, require_empty


def union_tagged(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn(tag, F.lit(name)) for name, df in tables.items()],
    )


def distinct_on(df: DataFrame, keys: list[str], check: list[str] | None = None) -> DataFrame:
    """One row per key; columns in `check` must be single-valued, so the choice cannot matter."""
    for c in check or []:
        require_empty(multi_valued(df, keys, c), f"{c} varies within {keys}")
    return df.select(*keys, *(check or [])).dropDuplicates(keys) if check else df.dropDuplicates(keys)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def keys_except(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).join(b.select(key), key, "left_anti").distinct()
