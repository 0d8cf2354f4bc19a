"""Ordered scans and exact quantiles that no single large group can stall.

A window keeps one group in one task. Before using one, these helpers check the largest
group. Groups above the limit are range-partitioned on their order, scanned piece by
piece, and the pieces are stitched together with one small row per piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .session import DEFAULT_MAX_GROUP_ROWS, ensure_checkpoint_dir, max_group_rows

_PIECE = "__piece"
#: Rows of a group that may be listed in one place to read quantiles off.
LIST_ROWS = 8192
#: Cells into which a refinement cuts each open cell of a larger group.
CELLS = 4096
#: Rows a task gets, on average, where rows are dealt to tasks before they are grouped or joined.
TASK_ROWS = 200_000


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """`df`, of about `rows` rows, with equal keys in one task and about TASK_ROWS rows a task.

    For keys whose groups are small. The number of tasks follows the rows, not the bytes of a
    compressed shuffle, so that the memory of a task that groups or joins them is bounded.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


_known: dict[tuple, tuple[int, int]] = {}


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows in the largest group and in all; counts combine before the shuffle.

    The answer only steers how a group is processed, so it is kept per plan and session.
    """
    frame = df.select(*keys) if keys else df
    known = (df.sparkSession.sparkContext.applicationId, frame.semanticHash(), tuple(keys))
    if known not in _known:
        if keys:
            found = frame.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
            _known[known] = found[0] or 0, found[1] or 0
        else:
            rows = frame.count()
            _known[known] = rows, rows
    return _known[known]


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the largest group."""
    return group_sizes(df, keys)[0]


def large_groups(df: DataFrame, keys: list[str], limit: int, largest: int | None = None) -> DataFrame | None:
    """Keys of groups above `limit` rows, or None when there is none.

    `largest` is a known bound on the group size, which saves the count.
    """
    if (largest_group(df, keys) if largest is None else largest) <= limit:
        return None
    return df.groupBy(*keys).count().where(F.col("count") > limit).drop("count")


def same_keys_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on equally named keys where NULL matches NULL."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    )
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def split_large(df: DataFrame, keys: list[str], limit: int, largest: int | None = None):
    """Rows of groups within `limit`, and rows of the larger groups (None when none)."""
    if not keys:
        rows = largest_group(df, []) if largest is None else largest
        return (df, None) if rows <= limit else (df.where(F.lit(False)), df)
    large = large_groups(df, keys, limit, largest)
    if large is None:
        return df, None
    return same_keys_join(df, large, keys, "left_anti"), same_keys_join(df, large, keys, "left_semi")


def _scan_columns(part, order, sums, totals, lags, lasts):
    by = part or [F.lit(0)]
    ordered = W.partitionBy(*by).orderBy(*order)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    return [
        *[F.sum(as_col(v)).over(upto).alias(k) for k, v in sums.items()],
        *[F.sum(as_col(v)).over(whole).alias(k) for k, v in totals.items()],
        *[F.lag(as_col(v)).over(ordered).alias(k) for k, v in lags.items()],
        *[F.last(as_col(v), True).over(before).alias(k) for k, v in lasts.items()],
    ]


def cut_pieces(df: DataFrame, part: list[str], order: list, limit: int) -> DataFrame:
    """Rows with the number of their piece, which rises along (part, order); at most `limit` rows each.

    Pieces are cut from sorted ranges. Ranges are tasks, and every task reports to the driver:
    small pieces share a range, so that ranges grow with rows / 2 million, not rows / limit.
    """
    rows = df.count()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(tasks, -(-rows // DEFAULT_MAX_GROUP_ROWS) * 2)
    ranges = max(2, min(-(-rows // limit) * 2, most))
    # The id holds the range and, in its last 33 bits, the row's place in it.
    place = F.col("__id").bitwiseAND((1 << 33) - 1)
    return (
        df.repartitionByRange(ranges, *part, *order).sortWithinPartitions(*part, *order)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn(_PIECE, F.col("__id") - place + F.floor(place / limit)).drop("__id")
    )


def ordered_scan(
    df: DataFrame,
    order: list,
    part: list[str] | tuple[str, ...] = (),
    *,
    sums: dict | None = None,
    totals: dict | None = None,
    lags: dict | None = None,
    lasts: dict | None = None,
    limit: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add order-dependent columns within `part`; `largest` is a known bound on its groups.

    `sums` are running sums including the current row, `totals` whole-group sums, `lags`
    values of the previous row, `lasts` the latest non-null value before the row. `order`
    must be total, or its ties must not matter to the caller.
    """
    sums, totals, lags, lasts = sums or {}, totals or {}, lags or {}, lasts or {}
    part = list(part)
    limit = limit or max_group_rows(df.sparkSession)
    small, large = split_large(df, part, limit, largest)
    if large is None:
        return df.select("*", *_scan_columns(part, order, sums, totals, lags, lasts))

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # The range cut points come from a sample, so the rows are pinned before reuse.
    large = cut_pieces(large, part, order, limit).checkpoint()
    scope = [*part, _PIECE]
    by = W.partitionBy(*scope).orderBy(*order)
    whole = W.partitionBy(*scope)
    tail = {f"__tail_{k}": v for k, v in lasts.items()}
    upto = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    scanned = large.select(
        "*",
        *_scan_columns(scope, order, sums, totals, lags, lasts),
        F.row_number().over(by).alias("__n"),
        F.count(F.lit(1)).over(whole).alias("__size"),
        *[F.last(as_col(v), True).over(upto).alias(k) for k, v in tail.items()],
    )
    # One row per piece: what the piece adds to the rows after it.
    edges = scanned.where(F.col("__n") == F.col("__size")).select(
        *scope,
        *[F.col(k).alias(f"__sum_{k}") for k in sums],
        *[F.col(k).alias(f"__tot_{k}") for k in totals],
        *[as_col(v).alias(f"__lag_{k}") for k, v in lags.items()],
        *[F.col(f"__tail_{k}") for k in lasts],
    )
    chain = W.partitionBy(*(part or [F.lit(0)])).orderBy(_PIECE)
    earlier = chain.rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*(part or [F.lit(0)]))
    offsets = edges.select(
        *scope,
        *[F.coalesce(F.sum(f"__sum_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in sums],
        *[F.sum(f"__tot_{k}").over(group).alias(f"__o_{k}") for k in totals],
        *[F.lag(f"__lag_{k}").over(chain).alias(f"__o_{k}") for k in lags],
        *[F.last(f"__tail_{k}", True).over(earlier).alias(f"__o_{k}") for k in lasts],
    )
    joined = same_keys_join(scanned, offsets, scope, "left")
    fixed = joined.select(
        *df.columns,
        *[(F.col(k) + F.col(f"__o_{k}")).alias(k) for k in sums],
        *[F.col(f"__o_{k}").alias(k) for k in totals],
        *[F.when(F.col("__n") == 1, F.col(f"__o_{k}")).otherwise(F.col(k)).alias(k) for k in lags],
        *[F.coalesce(F.col(k), F.col(f"__o_{k}")).alias(k) for k in lasts],
    )
    rest = small.select("*", *_scan_columns(part, order, sums, totals, lags, lasts))
    return rest.unionByName(fixed)


def numbered(df: DataFrame, order: list, part=(), name: str = "rn", limit=None) -> DataFrame:
    """Row number within `part`."""
    return ordered_scan(df, order, part, sums={name: F.lit(1)}, limit=limit)


def to_long(df: DataFrame, keys: list[str], cols: list[str], name="feature", value="value") -> DataFrame:
    """Wide numeric columns to (keys, name, value) rows."""
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(keys, cols, name, value)


def value_counts_scan(long: DataFrame, part: list[str], value: str, limit=None) -> DataFrame:
    """Distinct values per group with count, running count (`upto`) and group size (`n`)."""
    hist = long.where(F.col(value).isNotNull()).groupBy(*part, value).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return ordered_scan(
        hist, [F.col(value)], part, sums={"upto": "cnt"}, totals={"n": "cnt"}, limit=limit
    )


def pick_linear(p: float, value: str = "value") -> Column:
    """Linear quantile from a value_counts_scan, as an aggregate."""
    pos = (F.col("n") - 1) * F.lit(p)
    low = F.min(F.when(F.col("upto") > F.floor(pos), F.col(value)))
    high = F.min(F.when(F.col("upto") > F.ceil(pos), F.col(value)))
    frac = F.max(pos - F.floor(pos))
    return low + (high - low) * frac


def pick_nearest(p: float, value: str = "value") -> Column:
    """Quantile at the nearest rank (half up) from a value_counts_scan, as an aggregate."""
    pos = F.floor((F.col("n") - 1) * F.lit(p) + F.lit(0.5))
    return F.min(F.when(F.col("upto") > pos, F.col(value)))


def _linear(low: Column, high: Column, part: Column) -> Column:
    return F.when(low == high, low).otherwise(low + (high - low) * part)


def listed(df: DataFrame, keys: list[str], cols: list[str], aggregates=()) -> DataFrame:
    """`aggregates` of every group and its rows as one list, `__rows`, for groups known to be small.

    Rows are sent as they are: where nearly every row of a task has a key of its own, partial
    sums would send several numbers for each value.
    """
    return df.repartition(*keys).groupBy(*keys).agg(*aggregates, F.collect_list(F.struct(*cols)).alias("__rows"))


def list_quantiles(packed: DataFrame, cols: list[str], probs: dict[str, float]) -> DataFrame:
    """Linear quantiles of the numbers `cols` in the list `__rows`, which they replace."""
    keep = [c for c in packed.columns if c != "__rows"]
    value = lambda c: F.sort_array(F.filter(F.transform("__rows", lambda x: x[c]), lambda v: v.isNotNull()))
    made = packed.select(*keep, *[value(c).alias(f"__l_{c}") for c in cols])
    out = []
    for c in cols:
        values = F.col(f"__l_{c}")
        last = F.greatest(F.size(values) - 1, F.lit(0))
        for s, p in probs.items():
            at = last * F.lit(p)
            low, high = (F.get(values, f(at).cast("int")).cast("double") for f in (F.floor, F.ceil))
            out.append(_linear(low, high, at - F.floor(at)).alias(f"{c}{s}"))
    return made.select(*keep, *out)


def _listed_quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of groups of at most LIST_ROWS rows: one list of rows, sorted per column."""
    if not keys:
        return list_quantiles(df.groupBy().agg(F.collect_list(F.struct(*cols)).alias("__rows")), cols, probs)
    return list_quantiles(listed(df, keys, cols), cols, probs)


def _magnitude(value: Column) -> Column:
    """A number that never falls as the value grows: sign and binary magnitude."""
    size = F.abs(value)
    power = F.when(F.isnan(value), 3000).when(size == float("inf"), 2900).when(size == 0.0, 0).otherwise(
        1100 + F.floor(F.log2(F.when(size > 0, size))).cast("int"))
    return F.when(value < 0, -power).otherwise(power)


def _refined_quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of groups of any size by radix selection.

    Values are counted in cells of equal magnitude, per group and column and for all
    columns at once. A wanted rank lies in one cell; if the cell holds several values, only
    its rows are counted again, in CELLS parts between its least and greatest value. A
    magnitude holds 2^52 doubles, so a few passes end it. Counts combine before every
    shuffle: no group's values are gathered.
    """
    ensure_checkpoint_dir(df.sparkSession)
    part = [*keys, "feature"]
    long = to_long(df, keys, cols).where("value IS NOT NULL").withColumn("parent", F.lit(None).cast("double"))
    span = [F.count(F.lit(1)).alias("cnt"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    cells = long.groupBy(*part, "parent", _magnitude(F.col("value")).alias("cell")).agg(*span).checkpoint()
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs.values())]))
    want = cells.groupBy(*part).agg(F.sum("cnt").alias("n")).select("*", asked.alias("q")).withColumn("at", (F.col("n") - 1) * F.col("q.p"))
    want = want.select(
        *part, F.lit(None).cast("double").alias("parent"), F.col("q.i").alias("i"), (F.col("at") - F.floor("at")).alias("part"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("side"), f("at").alias("rank")) for k, f in enumerate((F.floor, F.ceil))])).alias("r"),
    ).select(*part, "parent", "i", "part", "r.side", "r.rank")
    settled = None
    while True:
        upto = F.sum("cnt").over(W.partitionBy(*part, "parent").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow))
        ranked = cells.withColumn("before", upto - F.col("cnt"))
        found = same_keys_join(want, ranked, [*part, "parent"], "inner").where("rank >= before AND rank < before + cnt")
        found = found.withColumn("rank", F.col("rank") - F.col("before"))
        value = F.when((F.col("lo") == F.col("hi")) | (F.col("rank") == 0), F.col("lo")).when(F.col("rank") == F.col("cnt") - 1, F.col("hi"))
        found = found.select(*part, "i", "part", "side", "rank", "lo", "hi", value.alias("value")).checkpoint()
        done = found.where("value IS NOT NULL").select(*part, "i", "part", "side", "value")
        settled = done if settled is None else settled.unionByName(done)
        rest = found.where("value IS NULL")
        if rest.isEmpty():
            break
        want = rest.select(*part, F.col("lo").alias("parent"), "i", "part", "side", "rank")
        spans = rest.select(*part, "lo", "hi").distinct()
        inside = same_keys_join(long.drop("parent"), spans, part, "inner").where("value BETWEEN lo AND hi")
        cell = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS).cast("int")
        cells = inside.select(*part, F.col("lo").alias("parent"), cell.alias("cell"), "value").groupBy(*part, "parent", "cell").agg(*span).checkpoint()
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("value")))
    per = settled.groupBy(*part, "i").agg(pick(0).alias("low"), pick(1).alias("high"), F.max("part").alias("part"))
    per = per.select(*keys, "feature", "i", _linear(F.col("low"), F.col("high"), F.col("part")).alias("value"))
    wide = per.groupBy(*keys).agg(*[
        F.max(F.when((F.col("feature") == c) & (F.col("i") == i), F.col("value"))).alias(f"{c}{s}")
        for c in cols for i, s in enumerate(probs)
    ])
    return wide if not keys else same_keys_join(df.select(*keys).distinct(), wide, keys, "left")


def exact_quantiles(
    df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float], limit=None, largest=None
) -> DataFrame:
    """Linear quantiles per group; columns `{col}{suffix}` for each `suffix: p` in probs.

    Groups of at most LIST_ROWS rows (or `limit`, if less) are listed and sorted; larger
    ones are refined cell by cell.
    """
    limit = min(limit or LIST_ROWS, LIST_ROWS)
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    small, large = split_large(typed, keys, limit, largest)
    if large is None:
        return _listed_quantiles(typed, keys, cols, probs)
    refined = _refined_quantiles(large, keys, cols, probs)
    return refined if not keys else _listed_quantiles(small, keys, cols, probs).unionByName(refined)
