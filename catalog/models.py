"""Model queries. Scores depend on the learner, so most are checked by rows and by tests."""

from pyspark.sql import functions as F

from pairsift.operators import metrics as M, resample as R
from pairsift.plans import ml
from pairsift.schema import FAMILIES, SIGNALS

from .base import LANGS, register, sql

# Small fits: the protocol is what the query shows.
TREES = ml.Trees(max_iter=3, depth=3, min_rows=5)
COLS = ["n_chars", "words", "digits", "upper", "lines", "accents", "spread"]


def documents(t, part: str = "full"):
    """Numeric traits of every document, over its whole text or its early or late half."""
    d = t.raw["documents"]
    middle = F.floor(F.length("text") / 2).cast("int")
    half = {"early": F.substring(F.col("text"), F.lit(1), middle), "late": F.substring(F.col("text"), middle + 1, F.length("text"))}
    if part in half:
        d = d.withColumn("text", half[part]).withColumn("n_chars", F.length("text").cast("long"))
    text = F.col("text")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return d.select(
        "doc_id", F.col("lang").alias("family"), F.col("source").alias("pool"), "n_chars",
        F.size(F.split(text, r"\s+")).alias("words"), count("[0-9]").alias("digits"), count("[A-Z]").alias("upper"),
        count("\n").alias("lines"), (F.octet_length(text) - F.length(text)).alias("accents"),
        F.size(F.array_distinct(F.split(text, r"\s+"))).alias("spread"),
    )


def split(t, k: int = 2):
    """(labelled with folds, unlabelled with folds)."""
    d = documents(t)
    y = t.raw["labels"].select("doc_id", F.col("quality").alias("label"))
    both = t.stage(d.join(y, "doc_id", "left"))
    known, latent = both.where("label IS NOT NULL"), both.where("label IS NULL").drop("label")
    folds = R.stratified_group_kfold(known, "pool", "family", k)
    folds = t.stage(R.extend_folds(folds, known, latent, "pool", k))
    return t.stage(known.join(folds, "pool")), t.stage(latent.join(folds, "pool"))


@register("l01_oof_risk")
def oof_risk(t):
    known, latent = split(t)
    oof, ev = ml.oof_risk(known, latent, COLS, "label", "fold", TREES)
    return oof.select("doc_id", "fold", "risk", F.lit("oof").alias("part")).unionByName(
        ev.select("doc_id", "fold", "risk", F.lit("evaluation").alias("part")))


@register("l02_family_probs")
def family_probs(t):
    known, latent = split(t)
    out = ml.family_probs(known, latent, COLS, "label", "family", LANGS, TREES)
    return out.select("doc_id", *[f"p_{k}" for k in LANGS])


@register("l03_oof_family")
def oof_family(t):
    known, _ = split(t)
    out = ml.oof_family(known, known, COLS, "fold", "label", "family", LANGS, TREES)
    return ml.routed(out, LANGS).select("doc_id", "fold", "predicted_route", *[f"p_{k}" for k in LANGS])


@register("l04_predict_pairs")
def predict_pairs(t):
    known, latent = split(t)
    return ml.predict_pairs(known, latent, COLS, "label", "family", "fold", "doc_id", LANGS, TREES)[0]


@register("l05_bagged_pu")
def bagged_pu(t):
    known, latent = split(t)
    a, b = ml.bagged_pu(known, latent, COLS, "label", "fold", "doc_id", 2, TREES)
    return a.select("doc_id", "fold", "pu_score").unionByName(b.select("doc_id", "fold", "pu_score"))


@register("l06_hard_negative")
def hard_negative(t):
    known, latent = split(t)
    return ml.hard_negative(known, [latent], COLS, "label", TREES)[0].select("doc_id", "score")


@register("l07_elkan_noto")
def elkan_noto(t):
    known, latent = split(t)
    a, b = ml.elkan_noto(known, latent, COLS, "label", "family", "fold", "pool", TREES)
    return a.select("doc_id", "pu_score").unionByName(b.select("doc_id", "pu_score"))


RANKED = ["net_gap_bb", "transfer_any_bb", "pair_passive", "pair_pot_share"]


@register("l08_fit_pairwise_linear", digits=4)
def fit_pairwise(t):
    """Every evidence-bearing hand scored by the family-aware ranker."""
    from pairsift.operators.pairs import pairwise_preferences

    hands = t.stage(t.evidence_hands.select("pair_id", "hand_id", "is_evidence", "behavior_family", *RANKED))
    prepare, names = ml.ranker_features(hands, RANKED, "behavior_family", FAMILIES)
    ready = prepare(hands)
    prefs = ml.pin(pairwise_preferences(ready, "pair_id", "is_evidence", names, "one"))
    ranker = ml.fit_pairwise_linear(prefs, names, 1.0, 50)
    return ready.select("pair_id", "hand_id", ranker.column().alias("score"))


@register("l09_select_c", sql("scored", """
    WITH q AS (SELECT pool, c, round(avg(CASE WHEN score >= c THEN label ELSE 0 END), 9) AS v FROM scored, (SELECT unnest([0.01e0, 0.1e0, 1e0]) AS c) GROUP BY 1, 2),
    m AS (SELECT c, avg(v) AS mean_ap, count(*) AS queries FROM q GROUP BY c)
    SELECT *, CASE WHEN row_number() OVER (ORDER BY mean_ap DESC, c) = 1 THEN 1 ELSE 0 END AS chosen FROM m""", "c mean_ap"))
def select_c(t):
    wide = t.scored.select("pool", "score", "label", F.explode(F.array(F.lit(0.01), F.lit(0.1), F.lit(1.0))).alias("c"))
    q = wide.groupBy("pool", "c").agg(F.round(F.avg(F.when(F.col("score") >= F.col("c"), F.col("label")).otherwise(0)), 9).alias("query_ap5"))
    return ml.select_c(q)


ROUTE_COLS = [f"{c}__mean" for c in SIGNALS]


def route_features(hands, *keep: str):
    """Mean signals of every pair, all a family model sees of it, beside the kept columns."""
    return hands.groupBy("pair_id").agg(*[F.avg(c).alias(f"{c}__mean") for c in SIGNALS], *[F.min(c).alias(c) for c in keep]).withColumn("label", F.lit(1))


def held_out_routes(t, hands):
    """Family of each pair by models that never saw a pair of its outer fold."""
    pairs = t.stage(route_features(hands, "outer_fold", "behavior_family"))
    return ml.routed(ml.oof_family(pairs, pairs, ROUTE_COLS, "outer_fold", "label", "behavior_family", FAMILIES, TREES)).select("pair_id", "predicted_route")


@register("l10_evidence_ranker")
def evidence_ranker(t):
    """Evaluation pairs go to the ranker of the family that a model of the development pairs predicts."""
    dev = t.stage(t.evidence_hands)
    ev = t.stage(t.pair_hands("evaluation"))
    asked = route_features(ev).drop("label")
    routes = ml.routed(ml.family_probs(route_features(dev, "behavior_family"), asked, ROUTE_COLS, "label", "behavior_family", FAMILIES, TREES))
    return ml.evidence_ranker(dev, ev.join(routes.select("pair_id", "predicted_route"), "pair_id"), RANKED, folds=2, max_iter=8)[0]


@register("l11_global_pairwise_risk")
def global_pairwise(t):
    known, latent = split(t)
    return ml.global_pairwise_risk(known, [latent], COLS, "label", "doc_id")[0].select("doc_id", "score")


@register("l12_time_transfer")
def time_transfer(t):
    from pairsift.functions.filters import time_half

    hands = t.stage(t.evidence_hands.select("pair_id", "outer_fold", "phase_progress", "is_evidence", *RANKED))
    feats = lambda h: time_half(hands, h).groupBy("pair_id", F.col("outer_fold").alias("fold")).agg(
        *[F.avg(c).alias(f"{c}__mean") for c in RANKED], F.max("is_evidence").alias("label"))
    early, late = t.stage(feats("early")), t.stage(feats("late"))
    both = early.join(late.select("pair_id"), "pair_id", "left_semi")
    return ml.time_transfer(both, late.join(early.select("pair_id"), "pair_id", "left_semi"), [f"{c}__mean" for c in RANKED],
                            "label", "fold", "pair_id")
