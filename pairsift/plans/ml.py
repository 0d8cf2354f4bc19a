"""Model jobs on Spark ML: training and scoring stay distributed, coefficients and trees are the
only things the driver holds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from math import ceil
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import forbidden_columns, interact, interacted_names, ranked_columns
from ..functions.scalars import clip, finite0, hash_uniform, sigmoid
from ..operators import resample as R
from ..operators.agg import apply_robust, fit_robust
from ..operators.metrics import ap_at_k, expected_tie_ap
from ..operators.pairs import pairwise_preferences
from ..operators.rank import active_fraction, active_top_n, argmax_class, slots_from_ranked
from ..operators.windows import pct_rank_avg, top_k
from ..scale import exact_quantiles, numbered
from ..schema import FAMILIES
from ..session import ensure_checkpoint_dir

# The ranker's grid, bag weight, and hard-negative weights.
C_GRID = (0.01, 0.1, 1.0, 10.0)
BAG_WEIGHT = 0.35
HARD_WEIGHT, EASY_WEIGHT = 2.5, 0.5
# Rows for each task of a fit whose every tree level is a job.
FIT_ROWS = 50_000


@dataclass(frozen=True)
class Trees:
    """Boosted-tree settings."""

    max_iter: int = 280
    step: float = 0.055
    depth: int = 5
    min_rows: int = 12
    seed: int = 7401

    def fit(self, df: DataFrame, label: str = "label", weight: str | None = None, shift: int = 0):
        model = GBTClassifier(
            featuresCol="features", labelCol=label, maxIter=self.max_iter, stepSize=self.step,
            maxDepth=self.depth, minInstancesPerNode=self.min_rows, seed=self.seed + shift,
        )
        return (model.setWeightCol(weight) if weight else model).fit(df)


def pin(df: DataFrame) -> DataFrame:
    """Materialise training data once, in the checkpoint folder, for the many passes of a fit."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def side_by_side(spark, fits: list[Callable], tasks: int) -> list:
    """Models of fits that need nothing of each other, in their order.

    A fit is a long series of short jobs of `tasks` tasks that leaves cores idle between them, so
    fits run at once until each core is offered two tasks.
    """
    at_once = max(2, 2 * spark.sparkContext.defaultParallelism // tasks)
    with ThreadPool(max(1, min(len(fits), at_once))) as pool:
        return pool.map(lambda fit: fit(), [inheritable_thread_target(spark)(fit) for fit in fits], chunksize=1)


def with_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add `features`, the cleaned columns as one vector; identifiers are refused."""
    bad = forbidden_columns(cols)
    if bad:
        raise ValueError(f"columns that must not be features: {bad}")
    # One lambda over an array keeps the generated code small however many columns there are.
    values = F.array(*[F.col(c).cast("double") for c in cols])
    clean = F.transform(values, lambda x: F.coalesce(
        F.when(~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), x), F.lit(0.0)))
    return df.withColumn("features", array_to_vector(clean))


def score(model, df: DataFrame, name: str) -> DataFrame:
    """Probability of class 1 as `name`."""
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def mean_score(models: list, df: DataFrame, name: str) -> DataFrame:
    """Average probability over several models, in one pass."""
    out = df
    for i, m in enumerate(models):
        out = score(m, out, f"__p{i}")
    parts = [F.col(f"__p{i}") for i in range(len(models))]
    return out.withColumn(name, reduce(lambda a, b: a + b, parts) / len(parts)).drop(*[f"__p{i}" for i in range(len(models))])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _folds(df: DataFrame, fold: str) -> list:
    return sorted(r[0] for r in df.select(fold).distinct().collect())


def _classes(df: DataFrame, col: str) -> list:
    return sorted(r[0] for r in df.select(col).distinct().collect() if r[0] is not None)


def oof_risk(train: DataFrame, evaluation: DataFrame | None, cols: list[str], label: str, fold: str,
             trees: Trees = Trees(), name: str = "risk"):
    """(out-of-fold scores of train, fold-averaged scores of evaluation).

    With one fold or one class a single model scores everything.
    """
    data = pin(with_features(train, cols))
    folds = _folds(data, fold)
    if len(folds) < 2 or len(_classes(data, label)) < 2:
        models = [trees.fit(data, label)]
        oof = score(models[0], data, name)
    else:
        models, parts = [], []
        for i, f in enumerate(folds):
            models.append(trees.fit(data.where(F.col(fold) != f), label, shift=i))
            parts.append(score(models[-1], data.where(F.col(fold) == f), name))
        oof = _union(parts)
    scored = None if evaluation is None else mean_score(models, with_features(evaluation, cols), name).drop("features")
    return oof.drop("features"), scored


def fit_family(positives: DataFrame, family: str, classes: list[str], trees: Trees = Trees(), shift: int = 0) -> list:
    """One binary model per class."""
    return [
        trees.fit(positives.withColumn("__is", (F.col(family) == k).cast("double")), "__is", shift=shift + i)
        for i, k in enumerate(classes)
    ]


def score_family(models: list, df: DataFrame, classes: list[str], prefix: str = "p_") -> DataFrame:
    """Class probabilities, scaled to sum to 1."""
    out = df
    for m, k in zip(models, classes):
        out = score(m, out, f"__{k}")
    total = reduce(lambda a, b: a + b, [F.col(f"__{k}") for k in classes])
    return out.withColumns({f"{prefix}{k}": F.col(f"__{k}") / total for k in classes}).drop(*[f"__{k}" for k in classes])


def family_probs(train: DataFrame, evaluation: DataFrame, cols: list[str], label: str, family: str,
                 classes: list[str] = FAMILIES, trees: Trees = Trees()) -> DataFrame:
    """Class probabilities from the positives; uniform when they hold one class only."""
    positives = pin(with_features(train.where(F.col(label) == 1), cols))
    seen = [k for k in classes if k in _classes(positives, family)]
    if len(seen) < 2:
        return evaluation.withColumns({f"p_{k}": F.lit(1.0 / len(classes)) for k in classes})
    models = fit_family(positives, family, seen, trees, 91)
    out = score_family(models, with_features(evaluation, cols), seen).drop("features")
    return out.withColumns({f"p_{k}": F.lit(0.0) for k in classes if k not in seen})


def oof_family(source: DataFrame, target: DataFrame, cols: list[str], fold: str, label: str = "label",
               family: str = "behavior_family", classes: list[str] = FAMILIES, trees: Trees = Trees()) -> DataFrame:
    """Class probabilities of target rows from models that never saw their fold.

    The true family is dropped from the output.
    """
    data = pin(with_features(source.where(F.col(label) == 1), cols))
    asked = with_features(target.drop(family), cols)
    parts = []
    for i, f in enumerate(_folds(target, fold)):
        part = data.where(F.col(fold) != f)
        lost = set(classes) - set(_classes(part, family))
        if lost:
            raise ValueError(f"fold {f} trains without {sorted(lost)}")
        models = fit_family(part, family, classes, trees, i * 10)
        parts.append(score_family(models, asked.where(F.col(fold) == f), classes))
    return _union(parts).drop("features")


def routed(df: DataFrame, classes: list[str] = FAMILIES, name: str = "predicted_route") -> DataFrame:
    return df.withColumn(name, argmax_class([f"p_{k}" for k in classes], classes))


def predict_pairs(train: DataFrame, evaluation: DataFrame, cols: list[str], label: str, family: str, fold: str,
                  key: str = "pair_id", classes: list[str] = FAMILIES, trees: Trees = Trees()):
    """(predictions, out-of-fold train scores): risk, a family for the riskiest rows, a route for all."""
    oof, risk = oof_risk(train, evaluation, cols, label, fold, trees, "risk_score")
    rate = train.agg(F.avg(label)).first()[0]
    probs = family_probs(train, risk, cols, label, family, classes, trees)
    picked = argmax_class([f"p_{k}" for k in classes], classes)
    rows = pin(probs.select(key, clip("risk_score", 0.0, 1.0).alias("risk_score"), picked.alias("evidence_behavior")))
    marked = active_top_n(rows, "risk_score", key, active_fraction(0.01 if rate is None else rate))
    return marked.select(
        key, "risk_score",
        F.when(F.col("active") == 1, F.col("evidence_behavior")).otherwise("none").alias("predicted_behavior"),
        "evidence_behavior",
    ), oof


def bagged_pu(labelled: DataFrame, unlabelled: DataFrame, cols: list[str], label: str, fold: str, key: str,
              bags: int = 5, trees: Trees = Trees(), name: str = "pu_score"):
    """(labelled, unlabelled) scores averaged over bags of sampled unlabelled rows.

    Sampled rows stand in as weighted zeros inside a fit only; no label is stored.
    """
    known = pin(with_features(labelled, cols))
    latent = pin(with_features(unlabelled, cols))
    folds = _folds(known, fold)
    draws = pin(R.bag_sample(latent, known, key, fold, label, bags, len(folds), trees.seed))
    part = lambda d, y, w: d.select("features", y.cast("double").alias("__y"), F.lit(w).alias("__w"))
    done_known, done_latent = [], []
    for f in folds:
        base = part(known.where(F.col(fold) != f), F.col(label), 1.0)
        models = []
        for b in range(bags):
            drawn = latent.join(draws.where((F.col("held_out") == f) & (F.col("bag") == b)).select(key), key, "left_semi")
            models.append(trees.fit(base.unionByName(part(drawn, F.lit(0), BAG_WEIGHT)), "__y", "__w", 100 + b))
        done_known.append(mean_score(models, known.where(F.col(fold) == f), name))
        done_latent.append(mean_score(models, latent.where(F.col(fold) == f), name))
    return _union(done_known).drop("features"), _union(done_latent).drop("features")


def hard_negative(train: DataFrame, targets: list[DataFrame], cols: list[str], label: str,
                  trees: Trees = Trees(), name: str = "score") -> list[DataFrame]:
    """Refit with the pilot's top quarter of negatives weighted up and the rest down."""
    data = pin(with_features(train, cols))
    pilot = pin(score(trees.fit(data, label), data, "__pilot"))
    negatives = pilot.where(F.col(label) == 0)
    cut = exact_quantiles(negatives, [], ["__pilot"], {"__q": 0.75}).first()[0]
    weight = F.when(F.col(label) == 1, 1.0).when(F.col("__pilot") >= F.lit(cut), HARD_WEIGHT).otherwise(EASY_WEIGHT)
    final = trees.fit(pilot.withColumn("__w", weight), label, "__w")
    return [score(final, with_features(t, cols), name).drop("features") for t in targets]


def _selector(known: DataFrame, latent: DataFrame, label: str, trees: Trees, shift: int):
    """Model of being a known positive; unlabelled rows share the weight of the known negatives."""
    negatives, n = known.where(F.col(label) == 0).count(), latent.count()
    part = lambda d, y, w: d.select("features", y.cast("double").alias("__s"), F.lit(float(w)).alias("__w"))
    data = part(known, F.col(label), 1.0)
    if n:
        data = data.unionByName(part(latent, F.lit(0), negatives / n))
    return trees.fit(data, "__s", "__w", shift)


def elkan_noto(labelled: DataFrame, unlabelled: DataFrame, cols: list[str], label: str, family: str, fold: str,
               pool: str, trees: Trees = Trees(), name: str = "pu_score", own_constant: bool = True):
    """(labelled, unlabelled) scores of the selector divided by its labelling rate.

    The rate is the mean score of held-out positives, kept in [.05, .95]. By default the
    same selector gives the rate and the scores; `own_constant=False` scores with a second
    selector fitted on the whole training part.
    """
    known, latent = pin(with_features(labelled, cols)), pin(with_features(unlabelled, cols))
    done_known, done_latent = [], []
    for i, f in enumerate(_folds(known, fold)):
        train, fresh = known.where(F.col(fold) != f), latent.where(F.col(fold) != f)
        inner = R.stratified_group_kfold(train, pool, family, 3, trees.seed + 100 + i, "__inner")
        split = train.join(inner, pool)
        fit_pools = inner.where("__inner <> 0").select(pool)
        model = _selector(split.where("__inner <> 0"), fresh.join(fit_pools, pool, "left_semi"), label, trees, 200 + i)
        held = score(model, split.where((F.col("__inner") == 0) & (F.col(label) == 1)), "__s")
        rate = held.agg(F.avg("__s")).first()[0]
        if rate is None:
            raise ValueError(f"fold {f} has no held-out positives")
        rate = min(max(rate, 0.05), 0.95)
        final = model if own_constant else _selector(train, fresh, label, trees, i)
        scaled = clip(F.col("__s") / F.lit(rate), 0.0, 1.0)
        for rows, done in ((known, done_known), (latent, done_latent)):
            done.append(score(final, rows.where(F.col(fold) == f), "__s").withColumn(name, scaled).drop("__s"))
    return _union(done_known).drop("features"), _union(done_latent).drop("features")


@dataclass(frozen=True)
class LinearRanker:
    """Coefficients of a linear scorer without intercept."""

    cols: tuple[str, ...]
    coef: tuple[float, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"`{c}`") for c, w in zip(self.cols, self.coef)])


def fit_pairwise_linear(prefs: DataFrame, cols: list[str], c: float, max_iter: int = 200, tol: float = 1e-8) -> LinearRanker:
    """L2-regularised logistic model of preference differences, without intercept."""
    bad = forbidden_columns(cols)
    if bad:
        raise ValueError(f"columns that must not be features: {bad}")
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(prefs).select("features", "target", "weight")
    total = data.agg(F.sum("weight")).first()[0]
    if not total:
        raise ValueError("no trainable preference")
    model = LogisticRegression(
        labelCol="target", weightCol="weight", fitIntercept=False, standardization=False,
        regParam=1.0 / (c * total), maxIter=max_iter, tol=tol,
    ).fit(data)
    return LinearRanker(tuple(cols), tuple(float(x) for x in model.coefficients))


def select_c(query_scores: DataFrame, c: str = "c", value: str = "query_ap5") -> DataFrame:
    """Mean per grid value and the chosen one: largest mean, the smaller value on an exact tie."""
    means = query_scores.groupBy(c).agg(F.avg(value).alias("mean_ap"), F.count(F.lit(1)).alias("queries"))
    best = means.agg(F.max(F.struct(F.col("mean_ap"), (-F.col(c)).alias("n")))["n"].alias("n")).select((-F.col("n")).alias("__b"))
    marked = means.join(best.withColumn("chosen", F.lit(1)), F.col(c) == F.col("__b"), "left").drop("__b")
    return marked.na.fill(0, ["chosen"])


def ranker_features(train: DataFrame, cols: list[str], family: str | None, classes: list[str]):
    """(function preparing rows for the linear ranker, its feature names), fitted on `train` only."""
    params = fit_robust(train, cols)
    names = interacted_names(cols, classes) if family else list(cols)

    def prepare(df: DataFrame) -> DataFrame:
        out = apply_robust(df, params, cols)
        return interact(out, cols, family, classes) if family else out

    return prepare, names


def choose_c(hands: DataFrame, cols: list[str], inner: str, pair: str, label: str, score_hands: DataFrame | None = None,
             family: str | None = None, route: str | None = None, classes: list[str] = FAMILIES,
             grid=C_GRID, max_iter: int = 200) -> tuple[float, DataFrame]:
    """Grid value with the best pooled inner-fold query AP.

    Training rows carry their known family; validation rows are scored by their predicted
    route. The per-query table holds no family.
    """
    held = score_hands if score_hands is not None else hands
    parts = []
    for f in _folds(hands, inner):
        train, valid = hands.where(F.col(inner) != f), held.where(F.col(inner) == f)
        prepare, names = ranker_features(train, cols, family, classes)
        prefs = pin(pairwise_preferences(prepare(train), pair, label, names, "one"))
        ready = prepare_valid(prepare, valid, family, route)
        for c in grid:
            ranker = fit_pairwise_linear(prefs, names, c, max_iter)
            scored = ready.select(pair, label, ranker.column().alias("__s"))
            parts.append(expected_tie_ap(scored, pair, label, "__s").withColumn("c", F.lit(c)))
    table = pin(select_c(_union(parts)))
    return table.where("chosen = 1").first()["c"], table


def prepare_valid(prepare, valid: DataFrame, family: str | None, route: str | None) -> DataFrame:
    """Validation rows for the ranker, with the predicted route in place of the family."""
    if family and route:
        valid = valid.drop(family).withColumn(family, F.col(route))
    out = prepare(valid)
    return out.drop(family) if family and route else out


def evidence_ranker(dev: DataFrame, evaluation: DataFrame, cols: list[str], pool: str = "table_id", pair: str = "pair_id",
                    item: str = "hand_id", label: str = "is_evidence", family: str = "behavior_family",
                    route: str = "predicted_route", classes: list[str] = FAMILIES, folds: int = 5, c: float = 1.0,
                    max_iter: int = 100):
    """(evidence slots of evaluation pairs, out-of-fold AP per development pair).

    One linear ranker per family over the measures and their within-pair percentiles, tested
    on whole held-out pools; evaluation rows are scored by their predicted family's ranker.
    """
    ranked = ranked_columns(cols)
    names = [*cols, *[f"{x}__pair_pct" for x in ranked]]
    enrich = lambda d: finite0(pct_rank_avg(d, [pair], ranked, "__pair_pct"), names)
    dev = pin(enrich(dev))
    target = pin(enrich(evaluation))
    oof, scored = [], []
    for k in classes:
        rows = dev.where(F.col(family) == k)
        parts = pin(rows.join(R.group_kfold(rows.select(pool, pair).distinct(), pool, folds, "__fold"), pool))

        def fit(train):
            prepare, cols_ = ranker_features(train, names, None, classes)
            prefs = pin(pairwise_preferences(prepare(train), pair, label, cols_, "one"))
            return prepare, fit_pairwise_linear(prefs, cols_, c, max_iter)

        kept = _folds(parts, "__fold")
        for f in kept if len(kept) > 1 else []:
            prepare, ranker = fit(parts.where(F.col("__fold") != f))
            valid = prepare(parts.where(F.col("__fold") == f)).select(pair, item, label, ranker.column().alias("__s"))
            oof.append(ap_at_k(valid, pair, label, "__s", item).withColumn("family", F.lit(k)))
        prepare, ranker = fit(parts)
        scored.append(prepare(target.where(F.col(route) == k)).select(pair, item, ranker.column().alias("evidence_score")))
    best = top_k(_union(scored), [pair], [F.col("evidence_score").desc(), F.col(item)], 5)
    return slots_from_ranked(best, pair, item), (_union(oof) if oof else None)


def sampled_preferences(df: DataFrame, label: str, key: str, cols: list[str], per_positive: int = 16, seed: int = 7401) -> DataFrame:
    """Positive minus negative differences over the whole table, `per_positive` random negatives each."""
    negatives = numbered(df.where(F.col(label) == 0), [F.col(key)], name="__n")
    size = df.where(F.col(label) == 0).count()
    draws = df.where(F.col(label) == 1).select(key, *cols, F.explode(F.sequence(F.lit(1), F.lit(per_positive))).alias("__d"))
    draws = draws.withColumn("__n", F.floor(hash_uniform(seed, key, "__d") * F.lit(size)).cast("bigint") + 1)
    right = negatives.select("__n", *[F.col(c).alias(f"{c}__u") for c in cols])
    d = draws.join(right, "__n").withColumn("target", (F.col("__d") % 2).cast("int"))
    side = F.when(F.col("target") == 1, 1.0).otherwise(-1.0)
    return d.select(F.lit(1.0 / per_positive).alias("weight"), "target", *[(side * (F.col(c) - F.col(f"{c}__u"))).alias(c) for c in cols])


def global_pairwise_risk(train: DataFrame, targets: list[DataFrame], cols: list[str], label: str, key: str,
                         c: float = 1.0, per_positive: int = 16, name: str = "score") -> list[DataFrame]:
    """One ranking over all labelled pairs, squashed to (0, 1)."""
    prepare, names = ranker_features(train, cols, None, [])
    ready = pin(prepare(train))
    ranker = fit_pairwise_linear(pin(sampled_preferences(ready, label, key, names, per_positive)), names, c)
    return [t.join(prepare(t).select(key, sigmoid(ranker.column()).alias(name)), key) for t in targets]


def time_transfer(early: DataFrame, late: DataFrame, cols: list[str], label: str, fold: str, key: str,
                  trees: Trees = Trees()) -> DataFrame:
    """Scores of each half's pairs by models of either half that never saw their pools."""
    halves = {"early": pin(with_features(early, cols)), "late": pin(with_features(late, cols))}
    asked = [(src, f, 20 * i + j) for i, (src, data) in enumerate(halves.items()) for j, f in enumerate(_folds(data, fold))]
    tasks = max(1, ceil(max(data.count() for data in halves.values()) / FIT_ROWS))

    def fit(src: str, f, shift: int):
        return trees.fit(halves[src].where(F.col(fold) != f).coalesce(tasks), label, shift=shift)

    models = side_by_side(early.sparkSession, [partial(fit, *x) for x in asked], tasks)
    tables = []
    for src in halves:
        for dst, rows in halves.items():
            name = f"{src}_to_{dst}"
            parts = [score(m, rows.where(F.col(fold) == f), name) for (own, f, _), m in zip(asked, models) if own == src]
            tables.append(_union(parts).select(key, name))
    base = early.select(key, label, fold)
    return reduce(lambda a, b: a.join(b, key), [base, *tables])
