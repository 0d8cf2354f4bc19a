"""Metric queries."""

from pyspark.sql import functions as F

from pairsift.operators import metrics as M
from pairsift.operators.windows import evidence_bearing

from .base import LANGS, register, sql
from .quality import SUBMISSION, submission


def AP(rows: str, y: str, s: str, key: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {sel}coalesce(sum(CASE WHEN y = 1 THEN h / p END) / nullif(sum(y), 0), 0) AS ap FROM (
        SELECT *, row_number() OVER w * 1e0 AS p, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS h
        FROM (SELECT *, {y} AS y, {s} AS s, {key} AS k FROM {rows}) WINDOW w AS ({part} ORDER BY s DESC, k)) {grp}"""


@register("m01_average_precision", sql("scored", AP("scored", "label", "score", "doc_id", "pool"), "ap"))
def average_precision(t):
    return M.average_precision(t.scored, "label", "score", "doc_id", "pool")


@register("m01_average_precision_global", sql("scored", AP("scored", "toxic", "score", "doc_id"), "ap"))
def average_precision_global(t):
    return M.average_precision(t.scored, "toxic", "score", "doc_id")


FAM = f"(SELECT doc_id, f AS fam, CAST(truth = f AS INTEGER) AS ty, CASE WHEN pred = f THEN score ELSE 0 END AS ts FROM scored, (SELECT unnest({LANGS}) AS f))"


@register("m02_behavior_map", sql("scored", f"SELECT avg(ap) AS behavior_map FROM ({AP(FAM, 'ty', 'ts', 'doc_id', 'fam')})", "behavior_map"))
def behavior_map(t):
    return M.behavior_map(t.scored, "truth", "pred", "score", "doc_id", LANGS)


def truth(t):
    """Half of the pairs are positive; their evidence is the submission's slots shifted by one."""
    s = submission(t)
    slots = [f"evidence_hand_{i}" for i in (2, 3, 4, 5)]
    return s.select(
        "pair_id", (F.col("risk_score") * 50 >= 3).cast("int").alias("risk_score"), "predicted_behavior",
        *[F.col(c).alias(f"evidence_hand_{i + 1}") for i, c in enumerate(slots)], F.lit("NO_EVIDENCE").alias("evidence_hand_5"),
    )


def sub_sql(body: str) -> str:
    return f"""WITH sub AS ({SUBMISSION}), truth AS (SELECT pair_id, CAST(risk_score * 50 >= 3 AS INTEGER) AS y, predicted_behavior AS fam,
        list_filter([evidence_hand_2, evidence_hand_3, evidence_hand_4, evidence_hand_5], lambda x: x <> 'NO_EVIDENCE') AS rel FROM sub),
    got AS (SELECT pair_id, unnest(list_filter([evidence_hand_1, evidence_hand_2, evidence_hand_3, evidence_hand_4, evidence_hand_5], lambda x: x <> 'NO_EVIDENCE')) AS h,
        generate_subscripts(list_filter([evidence_hand_1, evidence_hand_2, evidence_hand_3, evidence_hand_4, evidence_hand_5], lambda x: x <> 'NO_EVIDENCE'), 1) AS r FROM sub),
    hits AS (SELECT g.pair_id, r, CAST(list_contains(rel, h) AS INTEGER) AS hit FROM got g JOIN truth t ON t.pair_id = g.pair_id),
    eap AS (SELECT t.pair_id, coalesce(x.s / nullif(least(len(rel), 5), 0), 0) AS ap FROM truth t LEFT JOIN (
        SELECT pair_id, sum(hit * c / (r * 1e0)) AS s FROM (SELECT *, sum(hit) OVER (PARTITION BY pair_id ORDER BY r) AS c FROM hits) GROUP BY pair_id) x
        ON x.pair_id = t.pair_id WHERE y = 1) {body}"""


@register("m03_evidence_ap", sql("pair_hands pairs", sub_sql("SELECT pair_id, ap AS evidence_ap FROM eap"), "evidence_ap"))
def evidence_ap(t):
    return M.evidence_ap(truth(t), submission(t))


JOINED = "(SELECT s.pair_id, y AS ty, risk_score, fam, predicted_behavior FROM sub s JOIN truth t ON t.pair_id = s.pair_id)"
BEH = f"""(SELECT pair_id, f, CAST(fam = f AS INTEGER) AS by_, CASE WHEN predicted_behavior = f THEN risk_score ELSE 0 END AS bs FROM {JOINED},
    (SELECT unnest(['directed_transfer', 'soft_play', 'coordinated_isolation']) AS f))"""


@register("m04_composite_score", sql("pair_hands pairs", sub_sql(f"""
    SELECT pair_ap, evidence_map5, behavior_map, 0.7e0 * pair_ap + 0.2e0 * evidence_map5 + 0.1e0 * behavior_map AS score FROM (SELECT
        (SELECT ap FROM ({AP(JOINED, "ty", "risk_score", "pair_id")})) AS pair_ap, (SELECT avg(ap) FROM eap) AS evidence_map5,
        (SELECT avg(ap) FROM ({AP(BEH, "by_", "bs", "pair_id", "f")})) AS behavior_map)"""), "pair_ap evidence_map5 behavior_map score"))
def composite(t):
    return M.composite_score(truth(t), submission(t))


@register("m05_map_at_k", sql("scored", """
    SELECT avg(coalesce(s / nullif(least(n, 5), 0), 0)) AS map_at_k FROM (SELECT pool, sum(CASE WHEN r <= 5 AND toxic = 1 THEN c / (r * 1e0) END) AS s, sum(toxic) AS n FROM (
        SELECT *, row_number() OVER w AS r, sum(toxic) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM scored WINDOW w AS (PARTITION BY pool ORDER BY score DESC, doc_id))
        GROUP BY pool)""", "map_at_k"))
def map_at_k(t):
    return M.map_at_k(t.scored, "pool", "toxic", "score", "doc_id", 5)


def TIE(rows: str, pair: str, y: str, s: str) -> str:
    return f"""SELECT {pair}, coalesce(sum(g) / nullif(least(max(tot), 5), 0), 0) AS ap FROM (
        SELECT {pair}, tot, CASE WHEN p + j.j <= 5 AND j.j <= n THEN (r / (n * 1e0)) * (q + 1 + (j.j - 1) * (r - 1) / (greatest(n - 1, 1) * 1e0)) / (p + j.j) ELSE 0 END AS g
        FROM (SELECT {pair}, n, r, sum(n) OVER w - n AS p, sum(r) OVER w - r AS q, sum(r) OVER (PARTITION BY {pair}) AS tot FROM (
            SELECT {pair}, {s} AS s, count(*) AS n, sum({y}) AS r FROM {rows} GROUP BY {pair}, {s}) WINDOW w AS (PARTITION BY {pair} ORDER BY s DESC)) b
        CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS j) j) GROUP BY {pair}"""


@register("m06_expected_tie_ap", sql("scored", f"SELECT pool, ap AS query_ap5 FROM ({TIE('scored', 'pool', 'label', 'coarse')})", "query_ap5"))
def expected_tie_ap(t):
    return M.expected_tie_ap(t.scored, "pool", "label", "coarse", 5)


EB = "(SELECT *, round(directed_signal, 1) AS s1 FROM evidence_hands WHERE pair_id IN (SELECT pair_id FROM evidence_hands WHERE is_evidence = 1))"
QAP = f"""SELECT m.*, ap AS query_ap5 FROM (SELECT pair_id, min(table_id) AS table_id, min(outer_fold) AS outer_fold, count(*) AS candidate_hands,
        CAST(sum(is_evidence) AS BIGINT) AS evidence_hands, min(behavior_family) AS behavior_family FROM {EB} GROUP BY pair_id) m
    JOIN ({TIE(EB, 'pair_id', 'is_evidence', 's1')}) a ON a.pair_id = m.pair_id"""


def queried(t):
    rows = t.evidence_hands.select(
        "pair_id", "table_id", "outer_fold", "behavior_family", "is_evidence", F.round("directed_signal", 1).alias("s1"))
    rows = evidence_bearing(t.stage(rows), ["pair_id"], "is_evidence")
    return t.stage(M.query_ap(rows, "s1", keep=["behavior_family"]))


@register("m07_query_ap", sql("evidence_hands", f"SELECT * REPLACE (CAST(outer_fold AS INTEGER) AS outer_fold) FROM ({QAP})", "query_ap5"))
def query_ap(t):
    return queried(t)


def views(order: str, by: str) -> str:
    return AP("scored", "label", "coarse", order, by)


@register("m08_tie_views", sql("scored", f"""
    WITH b AS (SELECT pool, coarse, count(*) AS n, sum(label) AS r FROM scored GROUP BY 1, 2),
    g AS (SELECT pool, sum(r * cr / (cn * 1e0)) / nullif(sum(r), 0) AS grouped_tie_ap FROM (SELECT *, sum(n) OVER w AS cn, sum(r) OVER w AS cr FROM b
        WINDOW w AS (PARTITION BY pool ORDER BY coarse DESC)) GROUP BY pool)
    SELECT k.pool, k.ap AS key_order_ap, coalesce(grouped_tie_ap, 0) AS grouped_tie_ap, be.ap AS best_tie_ap, wo.ap AS worst_tie_ap,
        (SELECT count(*) FROM scored s WHERE s.pool = k.pool AND coarse = 0) AS zero_tie_rows,
        CAST((SELECT coalesce(sum(label), 0) FROM scored s WHERE s.pool = k.pool AND coarse = 0) AS BIGINT) AS zero_tie_positive_rows
    FROM ({views("doc_id", "pool")}) k JOIN ({views("1 - label", "pool")}) be ON be.pool = k.pool JOIN ({views("label", "pool")}) wo ON wo.pool = k.pool
    JOIN g ON g.pool = k.pool""", "key_order_ap grouped_tie_ap best_tie_ap worst_tie_ap"))
def tie_views(t):
    return M.tie_views(t.scored, "label", "coarse", "doc_id", "pool")


def SHUFFLED(rows: str, rounds: int = M.SHUFFLE_ROUNDS, prime: int = M.SHUFFLE_PRIME) -> str:
    """Rows with x, n, a, b: x moved by the operator's permutation of 0 .. n - 1."""
    for i in range(rounds):
        key = f"((a + {i + 1} * b) % {prime})"
        rows = f"SELECT * EXCLUDE (o, d) REPLACE (CASE WHEN (d >> 12) & 1 = 1 THEN o ELSE x END AS x) FROM (SELECT *, ((greatest(x, o) % {prime}) * ({key} % 1000003 + 1) % {prime}) * 48271 % {prime} AS d FROM (SELECT *, (({key} * 48271 % {prime}) % n + n - x) % n AS o FROM ({rows})))"
    return rows


def RANDOM(rows: str, label: str, score: str, key: str, by: str, draws: int = 512) -> str:
    """The operator's random tie statistics; every block goes through the permutation."""
    start = f"""SELECT {by}, s, draw, n, p0, r0, j AS x, ('0x' || substr(h, 1, 7))::BIGINT AS a, ('0x' || substr(h, 8, 7))::BIGINT AS b FROM (
        SELECT *, md5(concat_ws('|', '9917', CAST(draw AS VARCHAR), CAST(p0 AS VARCHAR), CAST(n AS VARCHAR))) AS h FROM pos JOIN sc USING ({by}, s), (SELECT unnest(range({draws})) AS draw))"""
    return f"""SELECT {by}, avg(ap) AS random_tie_mean_ap, stddev_pop(ap) AS random_tie_std_ap, min(ap) AS random_tie_min_ap, max(ap) AS random_tie_max_ap FROM (
        WITH base AS (SELECT *, {label} AS y, {score} AS s FROM {rows}),
        bl AS (SELECT {by}, s, count(*) AS n, CAST(sum(y) AS BIGINT) AS r FROM base GROUP BY ALL),
        sc AS MATERIALIZED (SELECT *, CAST(sum(n) OVER w AS BIGINT) - n AS p0, CAST(sum(r) OVER w AS BIGINT) - r AS r0, sum(r) OVER (PARTITION BY {by}) AS tot FROM bl WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)),
        pos AS (SELECT {by}, s, row_number() OVER (PARTITION BY {by}, s ORDER BY {key}) - 1 AS j FROM base WHERE y = 1),
        placed AS (SELECT {by}, draw, (r0 + row_number() OVER (PARTITION BY {by}, s, draw ORDER BY x)) / (p0 + x + 1e0) AS g FROM ({SHUFFLED(start)})),
        per AS (SELECT {by}, draw, sum(g) AS g FROM placed GROUP BY ALL)
        SELECT {by}, draw, coalesce(g / nullif(tot, 0), 0) AS ap FROM (SELECT DISTINCT {by}, tot FROM sc) CROSS JOIN (SELECT unnest(range({draws})) AS draw) LEFT JOIN per USING ({by}, draw)
    ) GROUP BY {by}"""


@register("m09_random_tie_ap", sql("scored", RANDOM("scored", "label", "coarse", "doc_id", "pool"), "random_tie_mean_ap random_tie_std_ap random_tie_min_ap random_tie_max_ap"))
def random_tie_ap(t):
    return M.random_tie_ap(t.scored, "label", "coarse", "doc_id", "pool")


FRACTIONS = ", ".join(f"{f!r}e0" for f in M.ACTIVE_FRACTIONS)
CURVE = f"""(SELECT doc_id, fraction, f, CAST(active AS INTEGER) AS active, CAST(truth = f AS INTEGER) AS ty, CASE WHEN active AND pred = f THEN score ELSE 0 END AS ts FROM (
    SELECT *, fraction = 1 OR rank() OVER (PARTITION BY fraction ORDER BY score DESC) <= greatest(1, round_even(fraction * count(*) OVER (PARTITION BY fraction), 0)) AS active
    FROM scored, (SELECT unnest([{FRACTIONS}]) AS fraction)), (SELECT unnest({LANGS}) AS f))"""


def CV(order: str) -> str:
    return f"SELECT fraction, avg(ap) AS ap FROM ({AP(CURVE, 'ty', 'ts', order, 'fraction, f')}) GROUP BY fraction"


GROUPED = f"""SELECT fraction, avg(ap) AS ap FROM (SELECT fraction, f, coalesce(sum(r * cr / (cn * 1e0)) / nullif(sum(r), 0), 0) AS ap FROM (
    SELECT *, sum(n) OVER w AS cn, sum(r) OVER w AS cr FROM (SELECT fraction, f, ts, count(*) AS n, sum(ty) AS r FROM {CURVE} GROUP BY ALL)
    WINDOW w AS (PARTITION BY fraction, f ORDER BY ts DESC)) GROUP BY fraction, f) GROUP BY fraction"""


@register("m10_behavior_curve", sql("scored", f"""
    SELECT a.*, k.ap AS key_order_ap, gr.ap AS grouped_tie_ap, be.ap AS best_tie_ap, wo.ap AS worst_tie_ap, rt.ap AS random_tie_mean_ap
    FROM (SELECT fraction, CAST(sum(active) AS BIGINT) AS active_rows, avg(active) AS actual_active_fraction FROM {CURVE} WHERE f = '{LANGS[0]}' GROUP BY fraction) a
    JOIN ({CV("doc_id")}) k USING (fraction) JOIN ({CV("1 - ty")}) be USING (fraction) JOIN ({CV("ty")}) wo USING (fraction) JOIN ({GROUPED}) gr USING (fraction)
    JOIN (SELECT fraction, avg(random_tie_mean_ap) AS ap FROM ({RANDOM(CURVE, "ty", "ts", "doc_id", "fraction, f")}) GROUP BY fraction) rt USING (fraction)""",
    "actual_active_fraction key_order_ap grouped_tie_ap best_tie_ap worst_tie_ap random_tie_mean_ap"))
def behavior_curve(t):
    return M.behavior_curve(t.scored, "truth", "pred", "score", "doc_id", families=LANGS, draws=512)


P3 = "greatest(least({p}, 1 - 2.220446049250313e-16), 2.220446049250313e-16)"


@register("m11_classification_report", sql("scored", f"""
    SELECT *, (recall_de + recall_en + recall_es + recall_fr) / 4 AS macro_recall FROM (
    SELECT count(*) AS rows, avg(CAST(pred = family AS INTEGER)) AS accuracy,
        {", ".join(f"avg(CAST(pred = family AS INTEGER)) FILTER (family = '{k}') AS recall_{k}" for k in LANGS)},
        avg(-ln(CASE WHEN pred = family THEN 0.7e0 ELSE 0.1e0 END)) AS log_loss,
        avg({" + ".join(f"power(CASE WHEN pred = '{k}' THEN 0.7e0 ELSE 0.1e0 END - CAST(family = '{k}' AS INTEGER), 2)" for k in LANGS)}) AS brier FROM scored)""",
    "accuracy recall_de recall_en recall_es recall_fr log_loss brier macro_recall"))
def classification(t):
    s = t.scored.withColumns({f"p_{k}": F.when(F.col("pred") == k, 0.7).otherwise(0.1) for k in LANGS})
    return M.classification_report(s, "family", "pred", {k: f"p_{k}" for k in LANGS})


@register("m11_confusion", sql("scored", "SELECT family AS truth, pred AS predicted, count(*) AS rows FROM scored GROUP BY 1, 2"))
def confusion(t):
    return M.confusion(t.scored, "family", "pred")


FAP = f"(SELECT doc_id, score, label, f AS fam FROM scored, (SELECT unnest({LANGS}) AS f) WHERE label = 0 OR family = f)"


@register("m12_family_ap", sql("scored", f"SELECT fam AS family, ap FROM ({AP(FAP, 'label', 'score', 'doc_id', 'fam')})", "ap"))
def family_ap(t):
    return M.family_ap(t.scored, "label", "family", "score", "doc_id", LANGS)


MIXED = "(SELECT * FROM scored WHERE pool IN (SELECT pool FROM scored GROUP BY pool HAVING min(label) <> max(label)))"


@register("m12_pool_ap", sql("scored", AP(MIXED, "label", "score", "doc_id", "pool"), "ap"))
def pool_ap(t):
    return M.pool_ap(t.scored, "label", "score", "doc_id", "pool")


@register("m12_compare_pools", sql("scored", f"""
    SELECT count(*) AS pools, avg(d) AS mean_delta, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses,
        quantile_cont(d, 0.5) AS median_delta FROM (SELECT b.ap - a.ap AS d FROM ({AP(MIXED, "label", "score", "doc_id", "pool")}) a JOIN ({AP(MIXED, "label", "coarse", "doc_id", "pool")}) b USING (pool))""",
    "mean_delta median_delta"))
def compare_pools(t):
    return M.compare_pools(M.pool_ap(t.scored, "label", "score", "doc_id", "pool"), M.pool_ap(t.scored, "label", "coarse", "doc_id", "pool"), "pool")


PCT = """SELECT p.pool, p.score, (count(*) FILTER (u.score < p.score) + 0.5e0 * count(*) FILTER (u.score = p.score)) / count(*) AS pct, any_value(p.freq) AS freq
    FROM (SELECT pool, score, count(*) AS freq FROM scored WHERE toxic = 1 GROUP BY 1, 2) p JOIN (SELECT * FROM scored WHERE toxic = 0) u ON u.pool = p.pool GROUP BY 1, 2"""


def sides(t):
    return t.scored.where("toxic = 1"), t.scored.where("toxic = 0")


@register("m13_percentile_rows", sql("scored", PCT, "score pct"))
def percentile_rows(t):
    return M.percentile_rows(*sides(t), "pool", "score")


@register("m13_positive_percentiles", sql("scored", f"""
    SELECT avg(pct) AS percentile_mean, quantile_cont(pct, 0.5) AS percentile_median, avg(CAST(pct >= 0.95 AS INTEGER)) AS above_p95_rate, avg(CAST(pct >= 0.99 AS INTEGER)) AS above_p99_rate
    FROM (SELECT pct, unnest(range(freq)) FROM ({PCT}))""", "percentile_mean percentile_median above_p95_rate above_p99_rate"))
def positive_percentiles(t):
    return M.positive_percentiles(*sides(t), "pool", "score")


@register("m14_metric_tree", sql("evidence_hands", f"""
    WITH q AS ({QAP}), tree AS (SELECT CASE WHEN grouping(behavior_family) = 1 AND grouping(outer_fold) = 1 THEN 'overall' WHEN grouping(outer_fold) = 1 THEN 'family'
        WHEN grouping(behavior_family) = 1 THEN 'fold' ELSE 'fold_family' END AS level, behavior_family AS family, CAST(outer_fold AS INTEGER) AS fold, avg(query_ap5) AS value,
        count(*) AS queries, CAST(sum(candidate_hands) AS BIGINT) AS candidates, CAST(sum(evidence_hands) AS BIGINT) AS evidence, count(DISTINCT table_id) AS pools FROM q
        GROUP BY GROUPING SETS ((), (behavior_family), (outer_fold), (outer_fold, behavior_family)))
    SELECT * FROM tree UNION ALL SELECT 'macro_family', NULL, NULL, avg(value) FILTER (level = 'family'), max(queries) FILTER (level = 'overall'),
        max(candidates) FILTER (level = 'overall'), max(evidence) FILTER (level = 'overall'), max(pools) FILTER (level = 'overall') FROM tree""", "value"))
def metric_tree(t):
    return M.metric_tree(queried(t))


@register("m15_brier", sql("scored", "SELECT avg(power(score - label, 2)) AS brier FROM scored", "brier"))
def brier(t):
    return M.brier(t.scored, "label", "score")


FOLDED = "(SELECT *, doc_id % 5 AS fold FROM scored)"


@register("m16_fold_deltas", sql("scored", f"""
    SELECT a.fold, a.ap AS base_ap, b.ap AS cand_ap, b.ap - a.ap AS delta FROM ({AP(FOLDED, "label", "coarse", "doc_id", "fold")}) a JOIN ({AP(FOLDED, "label", "score", "doc_id", "fold")}) b USING (fold)""",
    "base_ap cand_ap delta"))
def fold_deltas(t):
    return M.fold_deltas(t.scored.withColumn("fold", F.col("doc_id") % 5), "label", "coarse", "score", "doc_id", "fold")


@register("m16_fold_delta_summary", sql("scored", f"""
    SELECT min(b.ap) - min(a.ap) AS worst_fold_delta, min(b.ap - a.ap) AS min_delta, avg(b.ap - a.ap) AS mean_delta
    FROM ({AP(FOLDED, "label", "coarse", "doc_id", "fold")}) a JOIN ({AP(FOLDED, "label", "score", "doc_id", "fold")}) b USING (fold)""", "worst_fold_delta min_delta mean_delta"))
def fold_delta_summary(t):
    return M.fold_delta_summary(fold_deltas(t))


@register("m17_evaluate_gate", sql("scored", """
    WITH m AS (SELECT 'brier' AS metric, avg(power(score - label, 2)) AS value FROM scored UNION ALL SELECT 'rate', avg(label) FROM scored),
    c AS (SELECT r.metric, op, threshold, value, CAST(CASE op WHEN '>=' THEN value >= threshold ELSE value <= threshold END AS INTEGER) AS passed
        FROM (VALUES ('brier', '<=', 0.9e0), ('rate', '>=', 0.99e0)) r(metric, op, threshold) JOIN m ON m.metric = r.metric)
    SELECT * FROM c UNION ALL SELECT 'overall', '', NULL, NULL, min(passed) FROM c""", "threshold value"))
def gate(t):
    m = t.scored.agg(F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"), F.avg("label").alias("rate"))
    return M.evaluate_gate(m.unpivot([], ["brier", "rate"], "metric", "value"), [("brier", "<=", 0.9), ("rate", ">=", 0.99)])


@register("m18_saturation", sql("scored", """
    SELECT avg(CAST(score >= 1 AS INTEGER)) AS at_bound, count(DISTINCT score) / (count(*) * 1e0) AS distinct_share FROM scored""", "at_bound distinct_share"))
def saturation(t):
    return M.saturation(t.scored, "score")


@register("j15_inversions", sql("scored", """
    SELECT p.doc_id, count(*) FILTER (n.score >= p.score) AS score_outranking, count(*) FILTER (n.coarse >= p.coarse) AS coarse_outranking
    FROM (SELECT * FROM scored WHERE toxic = 1) p, (SELECT * FROM scored WHERE toxic = 0) n GROUP BY p.doc_id"""))
def inversions(t):
    return M.inversions(t.scored, "toxic", ["score", "coarse"], "doc_id")


@register("j15_inversion_changes", sql("scored", """
    SELECT CAST(sum(b) AS BIGINT) AS base_inversions, CAST(sum(c) AS BIGINT) AS remaining_inversions, CAST(sum(fixed) AS BIGINT) AS fixed, CAST(sum(created) AS BIGINT) AS created,
        count(*) FILTER (c < b) AS positives_with_fewer, count(*) FILTER (c > b) AS positives_with_more FROM (
    SELECT p.doc_id, count(*) FILTER (n.score >= p.score) AS b, count(*) FILTER (n.alt >= p.alt) AS c, count(*) FILTER (n.score >= p.score AND n.alt < p.alt) AS fixed,
        count(*) FILTER (n.score < p.score AND n.alt >= p.alt) AS created
    FROM (SELECT *, doc_id * 7919 % 1009 AS alt FROM scored WHERE toxic = 1) p, (SELECT *, doc_id * 7919 % 1009 AS alt FROM scored WHERE toxic = 0) n GROUP BY p.doc_id)"""))
def inversion_changes(t):
    return M.inversion_changes(t.scored.withColumn("alt", F.col("doc_id") * 7919 % 1009), "toxic", "score", "alt", "doc_id")


@register("k06_hard_positives", sql("scored", """
    SELECT p.doc_id, any_value(p.pool) AS pool, any_value(p.score) AS score, any_value(p.coarse) AS coarse, count(*) FILTER (n.score >= p.score) AS score_outranking, count(*) FILTER (n.coarse >= p.coarse) AS coarse_outranking,
        count(*) FILTER (n.score >= p.score) - count(*) FILTER (n.coarse >= p.coarse) AS coarse_net_removed
    FROM (SELECT * FROM scored WHERE toxic = 1) p, (SELECT * FROM scored WHERE toxic = 0) n GROUP BY p.doc_id""", "score coarse"))
def hard_positives(t):
    return M.hard_positives(t.scored, "toxic", "score", ["coarse"], "doc_id", ["pool"])
