"""NULL-safe scalar helpers."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import as_col


def num0(c) -> Column:
    """Number, or 0 when missing or not a number."""
    return F.coalesce(as_col(c).try_cast("double"), F.lit(0.0))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    x = as_col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def finite0(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace NULL, NaN and infinities by 0 in `cols`."""
    return df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in cols})


def clip(c, lo=None, hi=None) -> Column:
    """Bound a value; NULL stays NULL."""
    x = as_col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def strict_least(a, b) -> Column:
    """Smaller value; NULL when either is NULL."""
    a, b = as_col(a), as_col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def safe_ratio(n, d, default=None, lo=None, hi=None) -> Column:
    """n/d; a zero or missing denominator, or a non-finite result, gives `default`."""
    r = finite(F.try_divide(as_col(n).cast("double"), as_col(d).cast("double")))
    if default is not None:
        r = F.coalesce(r, F.lit(float(default)))
    return clip(r, lo, hi) if lo is not None or hi is not None else r


def sigmoid(c) -> Column:
    """Logistic squash."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(c)))


def log1p0(c) -> Column:
    """log1p of a value floored at 0."""
    return F.log1p(clip(c, 0.0))


def time_bin(progress, bins: int = 4) -> Column:
    """Equal-width bin of a 0..1 progress; the last bin is closed, NULL goes to bin 0."""
    return F.least(F.lit(bins - 1), F.floor(F.coalesce(as_col(progress), F.lit(0.0)) * bins)).cast("int")


def flag(cond: Column) -> Column:
    """0/1 indicator; NULL counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def total(cols) -> Column:
    return reduce(add, [as_col(c) for c in cols])


def hash_uniform(seed, *keys) -> Column:
    """Deterministic number in [0,1) from md5 of the seed and keys; independent of partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def md5_order(seed, *keys) -> Column:
    """Hex digest used as a reproducible random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys]))
