"""Data-quality operators. Each returns the violations it finds; empty means clean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import forbidden_columns
from ..functions.game import pair_key
from ..functions.slots import slot_array, slots_to_long
from ..scale import as_col, to_long
from ..schema import ALLOWED_BEHAVIORS, EVIDENCE_SLOTS, NO_EVIDENCE


class QualityError(ValueError):
    """Raised by `require_empty` when violations exist."""


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise with a few examples when there is any violation."""
    found = violations.take(3)
    if found:
        raise QualityError(f"{message}: {[r.asDict() for r in found]}")


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    spark = df.sparkSession
    lost = sorted(set(required) - set(df.columns))
    return spark.createDataFrame([(c,) for c in lost], "column string")


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Table name, rows, column count and column names."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows",
            F.lit(len(df.columns)).alias("columns"),
            F.lit(",".join(df.columns)).alias("column_names"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def key_coverage(expected: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """Counts of keys missing from and extra in `received`."""
    e = expected.select(F.col(key).cast("string").alias("k")).distinct()
    r = received.select(F.col(key).cast("string").alias("k")).distinct()
    both = e.withColumn("e", F.lit(1)).join(r.withColumn("r", F.lit(1)), "k", "full_outer")
    return both.agg(
        F.count(F.when(F.col("r").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("e").isNull(), 1)).alias("extra"),
    )


def domain_rule(column: str, lo=None, hi=None, values=None, nullable: bool = True) -> tuple[str, Column]:
    """(column, condition that marks a violation)."""
    c = F.col(column)
    bad = F.lit(False)
    if lo is not None or hi is not None:
        x = c.cast("string").try_cast("double")
        bad = bad | x.isNull() | F.isnan(x)
        if lo is not None:
            bad = bad | (x < lo)
        if hi is not None:
            bad = bad | (x > hi)
    if values is not None:
        bad = bad | ~c.cast("string").isin(*values)
    if not nullable:
        bad = bad | c.isNull()
    return column, F.coalesce(bad, F.lit(not nullable))


def domain_violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Violation count per ruled column, in one pass."""
    counted = df.agg(*[F.count_if(bad).cast("double").alias(c) for c, bad in rules])
    return to_long(counted, [], [c for c, _ in rules], "column", "violations").select(
        "column", F.col("violations").cast("bigint").alias("violations")
    ).where("violations > 0")


def row_slot_repeats(df: DataFrame, cols: list[str] = EVIDENCE_SLOTS, sentinel: str = NO_EVIDENCE) -> DataFrame:
    used = slot_array(cols, sentinel)
    return df.where(F.size(used) != F.size(F.array_distinct(used)))


def submitted_members(sub: DataFrame, cols: list[str] = EVIDENCE_SLOTS, sentinel: str = NO_EVIDENCE) -> DataFrame:
    long = slots_to_long(sub.withColumn("pair_id", F.col("pair_id").cast("string")), "pair_id", cols)
    long = long.withColumn("hand_id", F.trim("hand_id"))
    return long.where((F.col("hand_id") != sentinel) & (F.col("hand_id") != "")).select("pair_id", "hand_id")


def illegal_members(sub: DataFrame, legal: DataFrame, cols: list[str] = EVIDENCE_SLOTS) -> DataFrame:
    """Submitted (pair, hand) keys that are not in the legal set."""
    keys = legal.select(F.col("pair_id").cast("string"), F.col("hand_id").cast("string"))
    return submitted_members(sub, cols).join(keys, ["pair_id", "hand_id"], "left_anti")


def membership_summary(sub: DataFrame, legal: DataFrame, cols: list[str] = EVIDENCE_SLOTS) -> DataFrame:
    keys = legal.select(F.col("pair_id").cast("string"), F.col("hand_id").cast("string")).distinct()
    marked = submitted_members(sub, cols).join(
        keys.withColumn("legal", F.lit(1)), ["pair_id", "hand_id"], "left"
    )
    per = marked.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count("legal").alias("legal"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("submitted_evidence_hands"),
        F.coalesce(F.sum("legal"), F.lit(0)).alias("legal_evidence_hands"),
        F.count_if(F.col("n") == len(cols)).alias("pairs_with_all_slots"),
    )


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                 validate: str | None = "many_to_one", fill=None) -> DataFrame:
    """Join after asserting that the side(s) named unique really are."""
    if validate in ("many_to_one", "one_to_one"):
        require_empty(duplicate_keys(right, on), f"right side repeats {on}")
    if validate in ("one_to_many", "one_to_one"):
        require_empty(duplicate_keys(left, on), f"left side repeats {on}")
    out = left.join(right, on, how)
    return out if fill is None else out.na.fill(fill, [c for c in right.columns if c not in on])


def group_size_violations(df: DataFrame, key: list[str], n: int, member: str | None = None) -> DataFrame:
    size = F.count_distinct(member) if member else F.count(F.lit(1))
    return df.groupBy(*key).agg(size.alias("members")).where(F.col("members") != n)


def multi_valued(df: DataFrame, key: list[str], attr: str) -> DataFrame:
    """Keys with more than one value; min and max suffice, so no distinct set is built."""
    return (
        df.groupBy(*key).agg(F.min(attr).alias("first_value"), F.max(attr).alias("last_value"))
        .where(F.col("first_value") != F.col("last_value"))
    )


def feature_readiness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: missing, non-finite and non-zero counts, and whether it is constant."""
    long = to_long(df, [], cols)
    v = F.col("value")
    odd = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    good = F.when(~odd, v)
    return long.groupBy("feature").agg(
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(odd).alias("non_finite"),
        F.count_if(good != 0).alias("non_zero"),
        F.coalesce(F.min(good) == F.max(good), F.lit(True)).cast("int").alias("constant"),
    )


def latent_violations(unlabelled: DataFrame, known: DataFrame, role: str = "unlabeled") -> DataFrame:
    """Rules an unlabelled pair table must keep, with the number of breaches of each."""
    spark = unlabelled.sparkSession
    key = pair_key("player_1", "player_2").alias("k")
    overlap = unlabelled.select(key).join(known.select(key), "k", "left_semi").agg(
        F.count(F.lit(1)).alias("breaches"))
    copies = duplicate_keys(unlabelled, ["pair_id"]).agg(F.count(F.lit(1)).alias("breaches"))
    roles = unlabelled.agg(
        F.count_if(~F.col("training_role").eqNullSafe(F.lit(role))).alias("breaches"))
    label = spark.createDataFrame([(int("label" in unlabelled.columns),)], "breaches bigint")
    parts = {"label_column": label, "role": roles, "duplicate_id": copies, "known_pair": overlap}
    return reduce(
        DataFrame.unionByName, [d.select(F.lit(n).alias("rule"), "breaches") for n, d in parts.items()]
    )


def forbidden_features(spark: SparkSession, cols: list[str], extra=()) -> DataFrame:
    return spark.createDataFrame([(c,) for c in forbidden_columns(cols, extra)], "column string")


def rank_violations(df: DataFrame, key: str, rank: str, k: int = 5) -> DataFrame:
    """Ranks outside 1..k, or repeated within a key."""
    r = F.col(rank).try_cast("int")
    return (
        df.groupBy(F.col(key), F.col(rank)).agg(F.count(F.lit(1)).alias("copies"))
        .where(r.isNull() | ~r.between(1, k) | (F.col("copies") > 1))
    )


#: Buckets of rows whose summed hashes are compared before any row is.
DIFF_BUCKETS = 4096


def _bucketed(df: DataFrame) -> DataFrame:
    """`df` with the bucket of each row and two hashes; NULLs are hashed by their place."""
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in df.columns])
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.withColumns({
        "__h1": F.xxhash64(nulls, *cols), "__h2": F.xxhash64(F.lit(1), nulls, *cols),
    }).withColumn("__bucket", F.pmod("__h1", F.lit(DIFF_BUCKETS)).cast("int"))


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose row count, or whose sum of row hashes, is not the same in both tables."""
    def sums(df: DataFrame, name: str) -> DataFrame:
        total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
        return _bucketed(df).groupBy("__bucket").agg(F.struct(F.count(F.lit(1)), total("__h1"), total("__h2")).alias(name))

    both = sums(a, "__a").join(sums(b, "__b"), "__bucket", "full_outer")
    return both.where(~F.col("__a").eqNullSafe(F.col("__b"))).select("__bucket")


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in one table (copies counted).

    Rows are summed into buckets by 64-bit hashes first, in any order; only those of buckets
    that differ are compared, so equal tables shuffle nothing but the sums.
    """
    b = b.select(*a.columns)
    # At most DIFF_BUCKETS numbers.
    odd = F.broadcast(differing_buckets(a, b))
    part = lambda df: _bucketed(df).join(odd, "__bucket", "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
    x, y = part(a), part(b)
    return (
        x.exceptAll(y).withColumn("only_in", F.lit("a"))
        .unionByName(y.exceptAll(x).withColumn("only_in", F.lit("b")))
    )


def coverage_violations(observed: DataFrame, expected: DataFrame, keys: list[str], counts: list[str],
                        floors: dict[str, int] | None = None) -> DataFrame:
    """Cells whose counts differ from the expected ones, or fall below a floor."""
    e = expected.select(*keys, *[F.col(c).alias(f"expected_{c}") for c in counts])
    both = observed.select(*keys, *counts).join(e, keys, "full_outer")
    differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"expected_{c}")) for c in counts])
    low = F.lit(False)
    for c, floor in (floors or {}).items():
        low = low | (F.coalesce(F.col(c), F.lit(0)) < floor)
    return both.withColumns({"differs": differs.cast("int"), "below_floor": low.cast("int")}).where(
        "differs = 1 OR below_floor = 1"
    )


def pool_overlap(train: DataFrame, valid: DataFrame, pool: str) -> DataFrame:
    return train.select(pool).intersect(valid.select(pool))


def validate_submission(sub: DataFrame, expected: DataFrame, slots: list[str] = EVIDENCE_SLOTS,
                        behaviors=ALLOWED_BEHAVIORS, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Every submission rule with its number of breaches."""
    need = ["pair_id", "risk_score", "predicted_behavior", *slots]
    lost = missing_columns(sub, need)
    rules = lost.agg(F.count(F.lit(1)).alias("breaches")).select(F.lit("missing_column").alias("rule"), "breaches")
    if set(need) - set(sub.columns):
        return rules
    rows = sub.agg(
        F.count_if(domain_rule("risk_score", lo, hi)[1]).alias("risk_score"),
        F.count_if(domain_rule("predicted_behavior", values=behaviors, nullable=False)[1]).alias("predicted_behavior"),
        F.count_if(reduce(lambda x, y: x | y, [as_col(c).isNull() for c in slots])).alias("empty_slot"),
        F.count_if(
            F.size(slot_array(slots)) != F.size(F.array_distinct(slot_array(slots)))
        ).alias("repeated_slot"),
    )
    names = rows.columns
    rows = to_long(rows, [], names, "rule", "breaches").select("rule", F.col("breaches").cast("bigint").alias("breaches"))
    copies = duplicate_keys(sub, ["pair_id"]).agg(F.count(F.lit(1)).alias("breaches")).select(
        F.lit("duplicate_id").alias("rule"), "breaches")
    cover = key_coverage(expected, sub, "pair_id")
    cover = to_long(cover, [], ["missing", "extra"], "rule", "breaches").select(
        F.concat(F.col("rule"), F.lit("_pair")).alias("rule"), F.col("breaches").cast("bigint").alias("breaches"))
    return reduce(DataFrame.unionByName, [rules, copies, cover, rows])
