"""Data-quality queries."""

from pyspark.sql import functions as F

from pairsift.operators import quality as Q
from pairsift.operators.sets import union_tagged
from pairsift.schema import EVIDENCE_SLOTS

from .base import Tables, register, sql
from .rank import SLOTS, routed

SUBMISSION = f"""
    SELECT r.pair_id, CAST(shared_hands AS DOUBLE) / 50 AS risk_score, predicted_behavior,
        {", ".join(f"coalesce(CAST(evidence_hand_{i} AS VARCHAR), 'NO_EVIDENCE') AS evidence_hand_{i}" for i in range(1, 6))}
    FROM pairs p JOIN (SELECT pair_id, {SLOTS} FROM (
        SELECT pair_id, hand_id, row_number() OVER (PARTITION BY pair_id ORDER BY transfer_any_bb DESC, hand_id) AS rn FROM pair_hands)
        WHERE rn <= 5 GROUP BY pair_id) r ON r.pair_id = p.pair_id
    JOIN (SELECT pair_id, CASE (player_1 + player_2) % 4 WHEN 0 THEN 'directed_transfer' WHEN 1 THEN 'soft_play'
        WHEN 2 THEN 'coordinated_isolation' ELSE 'none' END AS predicted_behavior FROM pairs) q ON q.pair_id = p.pair_id"""


def submission(t: Tables):
    """A result table whose evidence slots hold real development hands."""
    from pairsift.functions.slots import finalize_slots
    from pairsift.operators.rank import slots_from_ranked
    from pairsift.operators.windows import top_k

    best = top_k(t.pair_hands().select("pair_id", "hand_id", "transfer_any_bb"), ["pair_id"],
                 [F.col("transfer_any_bb").desc(), F.col("hand_id")], 5)
    slots = slots_from_ranked(best).join(
        routed(t.pairs).select("pair_id", (F.col("shared_hands").cast("double") / 50).alias("risk_score"), "predicted_behavior"), "pair_id"
    )
    return finalize_slots(slots, ["pair_id", "risk_score", "predicted_behavior"])


@register("q01_missing_columns", sql("", " UNION ALL ".join(f"""
    SELECT '{n}' AS "table", c AS "column", (SELECT count(*) FROM {n}) AS rows FROM (SELECT unnest({need}) AS c)
    WHERE c NOT IN (SELECT column_name FROM (DESCRIBE {n}))""" for n, need in (
        ("orders", ["o_orderkey", "o_shippriority", "o_comment"]), ("lineitem", ["l_tax", "l_comment"])))))
def missing(t):
    """Columns a consumer needs and does not get, with the rows concerned."""
    need = {"orders": ["o_orderkey", "o_shippriority", "o_comment"], "lineitem": ["l_tax", "l_comment"]}
    rows = Q.profile({n: t.raw[n] for n in need}).select("table", "rows")
    lost = union_tagged({n: Q.missing_columns(t.raw[n], c) for n, c in need.items()}, "table")
    return lost.join(rows, "table")


PROFILED = ("nation", "supplier", "orders", "lineitem")


@register("q02_profile", sql("", " UNION ALL ".join(f"""
    SELECT '{n}' AS "table", (SELECT count(*) FROM {n}) AS rows, CAST((SELECT count(*) FROM (DESCRIBE {n})) AS INTEGER) AS columns,
        (SELECT string_agg(column_name, ',') FROM (DESCRIBE {n})) AS column_names""" for n in PROFILED)))
def profile(t):
    return Q.profile({n: t.raw[n] for n in PROFILED})


@register("q03_duplicate_keys", sql("", """
    SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""))
def duplicates(t):
    return Q.duplicate_keys(t.raw["lineitem"], ["l_orderkey", "l_linenumber"])


@register("q04_key_coverage", sql("", """
    SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS missing,
        (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS extra"""))
def coverage(t):
    k = lambda d, c: d.select(F.col(c).alias("k0"))
    return Q.key_coverage(k(t.raw["orders"], "o_orderkey"), k(t.raw["lineitem"], "l_orderkey"), "k0")


@register("q05_domain", sql("", """
    SELECT * FROM (SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity NOT BETWEEN 2 AND 49) AS violations FROM lineitem
        UNION ALL SELECT 'l_returnflag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
        UNION ALL SELECT 'l_linestatus', count(*) FILTER (l_linestatus IS NULL OR l_linestatus NOT IN ('O', 'F')) FROM lineitem)
    WHERE violations > 0"""))
def domain(t):
    return Q.domain_violations(t.raw["lineitem"], [
        Q.domain_rule("l_quantity", 2, 49), Q.domain_rule("l_returnflag", values=["A", "N"]),
        Q.domain_rule("l_linestatus", values=["O", "F"], nullable=False),
    ])


@register("q06_row_slot_repeats", sql("", """
    SELECT event_id, event_type, CAST(user_id % 10 AS VARCHAR) AS a, CAST(event_id % 10 AS VARCHAR) AS b FROM events
    WHERE user_id % 10 = event_id % 10 AND user_id % 10 <> 0"""))
def slot_repeats(t):
    e = t.raw["events"].select(
        "event_id", "event_type", (F.col("user_id") % 10).cast("string").alias("a"), (F.col("event_id") % 10).cast("string").alias("b"))
    return Q.row_slot_repeats(e, ["a", "b"], "0")


def _shifted(t):
    """The submission with one slot moved off its pair for some pairs."""
    moved = F.when(F.col("risk_score") > 0.5, F.lit("-1")).otherwise(F.col("evidence_hand_3"))
    return submission(t).withColumn("evidence_hand_3", moved)


SHIFTED = f"SELECT * REPLACE (CASE WHEN risk_score > 0.5 THEN '-1' ELSE evidence_hand_3 END AS evidence_hand_3) FROM ({SUBMISSION})"
LONG = " UNION ALL ".join(f"SELECT pair_id, evidence_hand_{i} AS hand_id FROM sub" for i in range(1, 6))


@register("q07_illegal_members", sql("pair_hands pairs", f"""
    SELECT pair_id, hand_id FROM (WITH sub AS ({SHIFTED}) {LONG}) s WHERE hand_id <> 'NO_EVIDENCE'
    AND NOT EXISTS (SELECT 1 FROM pair_hands h WHERE h.pair_id = s.pair_id AND CAST(h.hand_id AS VARCHAR) = s.hand_id)"""))
def illegal(t):
    return Q.illegal_members(_shifted(t), t.pair_hands().select("pair_id", "hand_id"))


@register("q07_membership_summary", sql("pair_hands pairs", f"""
    SELECT CAST(sum(n) AS BIGINT) AS submitted_evidence_hands, CAST(sum(legal) AS BIGINT) AS legal_evidence_hands, count(*) FILTER (n = 5) AS pairs_with_all_slots
    FROM (SELECT s.pair_id, count(*) AS n, count(h.hand_id) AS legal FROM (WITH sub AS ({SHIFTED}) {LONG}) s
        LEFT JOIN pair_hands h ON h.pair_id = s.pair_id AND CAST(h.hand_id AS VARCHAR) = s.hand_id
        WHERE s.hand_id <> 'NO_EVIDENCE' GROUP BY s.pair_id)"""))
def membership(t):
    return Q.membership_summary(_shifted(t), t.pair_hands().select("pair_id", "hand_id"))


@register("q08_checked_join", sql("", """
    SELECT s_suppkey, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey""", "s_acctbal"))
def checked(t):
    n = t.raw["nation"].withColumnRenamed("n_nationkey", "s_nationkey")
    return Q.checked_join(t.raw["supplier"], n, ["s_nationkey"]).select("s_suppkey", "n_name", "s_acctbal")


@register("q09_group_size", sql("", """
    SELECT l_orderkey, count(*) AS members FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4"""))
def group_size(t):
    return Q.group_size_violations(t.raw["lineitem"], ["l_orderkey"], 4)


@register("q10_multi_valued", sql("", """
    SELECT o_custkey, min(o_orderstatus) AS first_value, max(o_orderstatus) AS last_value FROM orders GROUP BY o_custkey
    HAVING count(DISTINCT o_orderstatus) > 1"""))
def multi_valued(t):
    return Q.multi_valued(t.raw["orders"], ["o_custkey"], "o_orderstatus")


READY = ["l_quantity", "l_discount", "l_tax", "ratio"]


@register("q11_feature_readiness", sql("", " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, count(*) FILTER ({e} IS NULL) AS missing, CAST(0 AS BIGINT) AS non_finite,
        count(*) FILTER ({e} <> 0) AS non_zero, CAST(coalesce(min({e}) = max({e}), true) AS INTEGER) AS "constant" FROM lineitem"""
    for c, e in [("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_tax", "l_tax"), ("ratio", "(l_tax / nullif(l_discount, 0))")])))
def readiness(t):
    li = t.raw["lineitem"].withColumn("ratio", F.try_divide("l_tax", "l_discount"))
    return Q.feature_readiness(li, READY)


@register("q12_latent_violations", sql("known_pairs", """
    SELECT 'label_column' AS rule, CAST(0 AS BIGINT) AS breaches UNION ALL SELECT 'role', CAST(0 AS BIGINT) UNION ALL SELECT 'duplicate_id', CAST(0 AS BIGINT)
    UNION ALL SELECT 'known_pair', count(*) FROM known_pairs WHERE shared_hands >= 3"""))
def latent(t):
    unl = t.written_pairs.where("shared_hands >= 3").withColumn("training_role", F.lit("unlabeled"))
    return Q.latent_violations(unl, t.known_pairs)


@register("q13_forbidden_columns", sql("", """
    SELECT 'event_id' AS "column", count(*) FILTER (event_id <> 0) AS non_zero FROM events
    UNION ALL SELECT 'user_id', count(*) FILTER (user_id <> 0) FROM events"""))
def forbidden(t):
    """Proposed features that are identifiers, with the rows that carry them."""
    e = t.raw["events"]
    bad = Q.forbidden_features(t.spark, e.columns)
    used = Q.feature_readiness(e, ["event_id", "user_id", "value"]).select(F.col("feature").alias("column"), "non_zero")
    return bad.join(used, "column")


@register("q14_rank_violations", sql("", """
    SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber
    HAVING l_linenumber NOT BETWEEN 1 AND 5 OR count(*) > 1"""))
def rank_violations(t):
    return Q.rank_violations(t.raw["lineitem"], "l_orderkey", "l_linenumber", 5)


@register("q15_table_diff", sql("", """
    SELECT *, 'a' AS only_in FROM (SELECT l_orderkey, l_suppkey FROM lineitem EXCEPT ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 10)
    UNION ALL SELECT *, 'b' FROM (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 10 EXCEPT ALL SELECT l_orderkey, l_suppkey FROM lineitem)"""))
def table_diff(t):
    a = t.raw["lineitem"].select("l_orderkey", "l_suppkey")
    b = t.raw["lineitem"].where("l_quantity > 10").select("l_orderkey", "l_suppkey")
    return Q.table_diff(a, b)


@register("q16_coverage_violations", sql("", """
    SELECT coalesce(o.k, e.k) AS k, n, expected_n, CAST(n IS DISTINCT FROM expected_n AS INTEGER) AS differs, CAST(coalesce(n, 0) < 9 AS INTEGER) AS below_floor
    FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) o
    FULL JOIN (SELECT c_nationkey AS k, count(*) AS expected_n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) e ON o.k = e.k
    WHERE n IS DISTINCT FROM expected_n OR coalesce(n, 0) < 9"""))
def coverage_violations(t):
    o = t.raw["supplier"].groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    e = t.raw["customer"].where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return Q.coverage_violations(o, e, ["k"], ["n"], {"n": 9})


@register("q17_pool_overlap", sql("", """
    SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal <= 5000"""))
def pool_overlap(t):
    s = t.raw["supplier"]
    return Q.pool_overlap(s.where("s_acctbal > 5000"), s.where("s_acctbal <= 5000"), "s_nationkey")


@register("q18_validate_submission", sql("pair_hands pairs", f"""
    SELECT rule, CAST(breaches AS BIGINT) AS breaches FROM (WITH sub AS ({SHIFTED})
    SELECT 'missing_column' AS rule, 0 AS breaches UNION ALL SELECT 'duplicate_id', 0
    UNION ALL SELECT 'missing_pair', count(*) FROM (SELECT pair_id FROM pairs EXCEPT SELECT pair_id FROM sub)
    UNION ALL SELECT 'extra_pair', count(*) FROM (SELECT pair_id FROM sub EXCEPT SELECT pair_id FROM pairs)
    UNION ALL SELECT 'risk_score', count(*) FILTER (risk_score NOT BETWEEN 0 AND 0.7) FROM sub
    UNION ALL SELECT 'predicted_behavior', count(*) FILTER (predicted_behavior NOT IN ('none', 'soft_play')) FROM sub
    UNION ALL SELECT 'empty_slot', 0
    UNION ALL SELECT 'repeated_slot', 0)"""))
def validate(t):
    return Q.validate_submission(_shifted(t), t.pairs.select("pair_id"), EVIDENCE_SLOTS, ["none", "soft_play"], 0.0, 0.7)
