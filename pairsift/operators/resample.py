"""Folds, samples and cluster resampling. Randomness comes from md5, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import hash_uniform, md5_order
from ..scale import exact_quantiles, numbered, same_keys_join


def _serpentine(rn: str, k: int) -> F.Column:
    """1, 2, .. k, k, .. 2, 1, 1, .. mapped to folds 0..k-1."""
    i = (F.col(rn) - 1) % (2 * k)
    return F.least(i, F.lit(2 * k - 1) - i).cast("int")


def group_kfold(df: DataFrame, pool: str, k: int, fold: str = "fold", limit=None) -> DataFrame:
    """Pool to fold: whole pools, largest first in serpentine order."""
    sizes = df.groupBy(pool).agg(F.count(F.lit(1)).alias("n"))
    ranked = numbered(sizes, [F.col("n").desc(), F.col(pool)], limit=limit)
    return ranked.select(pool, _serpentine("rn", k).alias(fold))


def stratified_group_kfold(df: DataFrame, pool: str, stratum: str, k: int, seed: int = 7401,
                           fold: str = "fold", by=(), limit=None) -> DataFrame:
    """Pool to fold: whole pools dealt per dominant stratum, then size, then seeded order."""
    by = list(by)
    counts = df.groupBy(*by, pool, stratum).agg(F.count(F.lit(1)).alias("n"))
    pools = counts.groupBy(*by, pool).agg(
        F.max(F.struct(F.col("n"), F.col(stratum).alias("s")))["s"].alias("dominant"), F.sum("n").alias("size")
    )
    order = [F.col("dominant"), F.col("size").desc(), md5_order(seed, *by, pool), F.col(pool)]
    return numbered(pools, order, by, limit=limit).select(*by, pool, _serpentine("rn", k).alias(fold))


def with_folds(df: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(folds, keys, "left")


def extend_folds(folds: DataFrame, labelled: DataFrame, unlabelled: DataFrame, pool: str, k: int,
                 fold: str = "fold", limit=None) -> DataFrame:
    """Folds for pools without labels: the larger pools first, to the smaller folds first.

    Folds are 0 to k - 1; those without a labelled row take part as the smallest, so every
    pool gets a fold.
    """
    every = folds.sparkSession.range(k).select(F.col("id").cast(folds.schema[fold].dataType).alias(fold))
    counted = labelled.join(folds, pool).groupBy(fold).agg(F.count(F.lit(1)).alias("n"))
    sizes = every.join(counted, fold, "left").na.fill(0, ["n"])
    order = numbered(sizes, [F.col("n"), F.col(fold)], limit=limit).select(
        (F.col("rn") - 1).cast("int").alias("slot"), fold)
    fresh = unlabelled.groupBy(pool).agg(F.count(F.lit(1)).alias("n")).join(folds, pool, "left_anti")
    dealt = numbered(fresh, [F.col("n").desc(), F.col(pool)], limit=limit).select(pool, _serpentine("rn", k).alias("slot"))
    added = dealt.join(order, "slot").select(pool, fold)
    return folds.select(pool, fold).unionByName(added)


def nested_folds(df: DataFrame, outer: str, pool: str, stratum: str, outer_k: int = 5, k: int = 3,
                 seed: int = 7401, limit=None) -> DataFrame:
    """Inner folds of each outer-training part: (held_out, pool, inner_fold)."""
    rows = df.select(outer, pool, stratum, F.explode(F.sequence(F.lit(0), F.lit(outer_k - 1))).alias("held_out"))
    rows = rows.where(F.col(outer) != F.col("held_out"))
    return stratified_group_kfold(rows, pool, stratum, k, seed, "inner_fold", ["held_out"], limit)


def nested_feasibility(per_pair: DataFrame, outer: str, pool: str, family: str, outer_k: int = 5, k: int = 3,
                       seed: int = 7401, limit=None) -> DataFrame:
    """Training and validation counts per direction, outer fold, inner fold and family.

    `per_pair` is the output of `query_counts` with pool, fold and family.
    """
    inner = nested_folds(per_pair, outer, pool, family, outer_k, k, seed, limit)
    rows = per_pair.join(inner, pool).where(F.col(outer) != F.col("held_out"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("inner"))
    directions = F.inline(F.array(*[
        F.struct(
            F.lit(f"{s}_to_{t}").alias("direction"),
            F.col(f"{s}_evidence").alias("se"), F.col(f"{s}_unjudged").alias("su"),
            F.col(f"{s}_preferences").alias("sp"), F.col(f"{t}_evidence").alias("te"),
        )
        for s, t in (("early", "late"), ("late", "early"))
    ]))
    long = rows.select(
        F.col("held_out").alias("outer_fold"), "inner", "inner_fold", F.col(family).alias("family"), directions
    )
    train = (F.col("inner_fold") != F.col("inner")) & (F.col("se") > 0)
    valid = (F.col("inner_fold") == F.col("inner")) & (F.col("te") > 0)
    return long.groupBy("direction", "outer_fold", F.col("inner").alias("inner_fold"), "family").agg(
        F.count_if(train).alias("train_pairs"), F.coalesce(F.sum(F.when(train, F.col("se"))), F.lit(0)).alias("train_evidence"),
        F.count_if(train & (F.col("su") > 0)).alias("trainable_pairs"),
        F.coalesce(F.sum(F.when(train, F.col("sp"))), F.lit(0)).alias("preferences"),
        F.count_if(valid).alias("valid_pairs"), F.coalesce(F.sum(F.when(valid, F.col("te"))), F.lit(0)).alias("valid_evidence"),
    )


def feasibility_minima(rows: DataFrame) -> DataFrame:
    return rows.groupBy("direction").agg(*[
        F.min(c).alias(f"min_{c}") for c in ("train_pairs", "trainable_pairs", "valid_pairs")
    ])


#: Hash buckets of a fold and bag in which keys are counted to find a draw's threshold.
HASH_BUCKETS = 1 << 16


def _below_threshold(unlabelled: DataFrame, labelled: DataFrame, key: str, fold: str, label: str, bags: int,
                     folds: int, seed: int) -> DataFrame:
    """(held_out, bag, key, __o, wanted) of the keys whose hash bucket a draw can reach.

    Keys are counted per fold, bag and bucket of their hash, so the table of thresholds has
    a row for each draw: the bucket at which a draw has all the rows it wants.
    """
    held = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held_out")
    sizes = labelled.select(fold, label, held).where(F.col(fold) != F.col("held_out")).groupBy("held_out").agg(
        F.greatest(F.count_if(F.col(label) == 0), 4 * F.count_if(F.col(label) == 1)).alias("wanted")
    )
    rows = unlabelled.select(key, fold, F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("bag").cast("string"), F.col(key).cast("string")))
    rows = rows.withColumn("__o", order).withColumn("__h", F.conv(F.substring("__o", 1, 4), 16, 10).cast("int"))
    counted = rows.groupBy(fold, "bag", "__h").agg(F.count(F.lit(1)).alias("n"))
    seen = counted.select("*", held).where(F.col(fold) != F.col("held_out")).groupBy("held_out", "bag", "__h").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("held_out", "bag").orderBy("__h").rowsBetween(W.unboundedPreceding, W.currentRow))
    cuts = seen.withColumn("upto", upto).join(sizes, "held_out").groupBy("held_out", "bag", "wanted").agg(
        F.coalesce(F.min(F.when(F.col("upto") >= F.col("wanted"), F.col("__h"))), F.lit(HASH_BUCKETS)).alias("cut")
    )
    # folds * bags rows, whatever the data, so every task can hold them.
    reach = rows.join(F.broadcast(cuts), "bag").where((F.col(fold) != F.col("held_out")) & (F.col("__h") <= F.col("cut")))
    return reach.select("held_out", "bag", key, "__o", "wanted")


def bag_sample(unlabelled: DataFrame, labelled: DataFrame, key: str, fold: str, label: str, bags: int = 5,
               folds: int = 5, seed: int = 7401, limit=None) -> DataFrame:
    """Unlabelled keys drawn without replacement per (held_out, bag).

    Each draw takes min(all, max(negatives, 4 x positives)) rows of the training folds: those
    with the least hashes. Only rows below the draw's threshold are sorted, a bucket's worth
    more than it takes.
    """
    reach = _below_threshold(unlabelled, labelled, key, fold, label, bags, folds, seed)
    ranked = numbered(reach, [F.col("__o"), F.col(key)], ["held_out", "bag"], limit=limit)
    return ranked.where(F.col("rn") <= F.col("wanted")).select("held_out", "bag", key)


#: Draws of one block; a block is an array column, summed element by element.
DRAW_BLOCK = 32


def weight_blocks(pools: DataFrame, pool: str, fold: str, draws: int = 5000, seed: int = 7401, width: int = DRAW_BLOCK) -> DataFrame:
    """Exponential weights, scaled to mean 1 in each draw and fold: pool, fold, block and an
    array with the weights of draws block * width, block * width + 1, and so on."""
    base = pools.select(pool, fold).distinct()
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // width) - 1))).alias("block")

    def drawn(k: int) -> Column:
        draw = (F.col("block") * width + k).cast("string")
        u = hash_uniform(seed, draw, fold, pool)
        return F.when(F.col("block") * width + k < draws, -F.ln(F.greatest(u, F.lit(2.0**-52))))

    rows = base.select(pool, fold, blocks).withColumn("e", F.array(*[drawn(k) for k in range(width)]))
    means = rows.groupBy(fold, "block").agg(F.array(*[F.avg(F.col("e")[k]) for k in range(width)]).alias("m"))
    scaled = F.transform(F.arrays_zip("e", "m"), lambda x: x["e"] / x["m"])
    return rows.join(means, [fold, "block"]).select(pool, fold, "block", scaled.alias("weights"))


def cluster_weights(pools: DataFrame, pool: str, fold: str, draws: int = 5000, seed: int = 7401) -> DataFrame:
    """The weights of weight_blocks() as rows: draw, pool, fold, weight."""
    blocks = weight_blocks(pools, pool, fold, draws, seed)
    rows = blocks.select("*", F.posexplode("weights").alias("k", "weight")).withColumn("draw", F.col("block") * DRAW_BLOCK + F.col("k"))
    return rows.where(F.col("draw") < draws).select("draw", pool, fold, "weight")


def sensitivity_tree(delta: DataFrame, blocks: DataFrame, draws: int, pool: str = "table_id", fold: str = "outer_fold",
                     family: str = "behavior_family", lo: float = 0.05, hi: float = 0.95, width: int = DRAW_BLOCK) -> DataFrame:
    """Point delta and weighted-draw quantiles overall, per family, fold, both, and family macro.

    Deltas are summed per pool first and meet whole blocks of draws (weight_blocks), whose
    elements are summed side by side: rows grow with pools times blocks, not with draws.
    """
    d = delta.select(F.col(pool).alias("pool"), F.col(fold).alias("fold"), F.col(family).alias("family"), "delta")
    cells = d.groupBy("pool", "fold", "family").agg(F.sum("delta").alias("s"), F.count(F.lit(1)).alias("n"))
    w = blocks.select("block", F.col(pool).alias("pool"), F.col(fold).alias("fold"), "weights")
    sets = [[], [F.col("family")], [F.col("fold")], [F.col("fold"), F.col("family")]]
    level = lambda gid: (
        F.when(gid == 3, "overall").when(gid == 1, "family").when(gid == 2, "fold").otherwise("fold_family")
    )
    point = d.groupingSets(sets, "family", "fold").agg(
        F.grouping_id().alias("gid"), F.avg("delta").alias("point_delta")
    ).select(level(F.col("gid")).alias("level"), "family", "fold", "point_delta")
    # Only sums over pools are kept per cell and block, so the four levels add up few rows.
    summed = cells.join(w, ["pool", "fold"]).groupBy("block", "family", "fold").agg(
        *[F.sum(F.col("weights")[k] * F.col("s")).alias(f"a{k}") for k in range(width)],
        *[F.sum(F.col("weights")[k] * F.col("n")).alias(f"b{k}") for k in range(width)],
    )
    ratio = F.array(*[F.sum(f"a{k}") / F.sum(f"b{k}") for k in range(width)])
    bsets = [[F.col("block"), *s] for s in sets]
    per = summed.groupingSets(bsets, "block", "family", "fold").agg(F.grouping_id().alias("gid"), ratio.alias("v")).select(
        "block", level(F.col("gid")).alias("level"), "family", "fold", F.posexplode("v").alias("k", "v")
    )
    per = per.withColumn("draw", F.col("block") * width + F.col("k")).where(F.col("draw") < draws)
    probs = {"lower": lo, "upper": hi}

    def band(rows: DataFrame, keys: list[str]) -> DataFrame:
        got = exact_quantiles(rows, keys, ["v"], {f"__{n}": p for n, p in probs.items()}, largest=draws)
        return got.select(*keys, *[F.col(f"v__{n}").alias(n) for n in probs])

    out = same_keys_join(point, band(per, ["level", "family", "fold"]), ["level", "family", "fold"], "left")
    fam = per.where(F.col("level") == "family").groupBy("draw").agg(F.avg("v").alias("v"))
    macro_band = band(fam.withColumn("level", F.lit("macro_family")), ["level"])
    macro_point = point.where(F.col("level") == "family").agg(F.avg("point_delta").alias("point_delta")).withColumn(
        "level", F.lit("macro_family"))
    types = dict(out.dtypes)
    macro = macro_point.join(macro_band, "level").select(
        "level", F.lit(None).cast(types["family"]).alias("family"), F.lit(None).cast(types["fold"]).alias("fold"),
        "point_delta", "lower", "upper",
    )
    return out.unionByName(macro)
