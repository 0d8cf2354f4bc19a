"""Window queries."""

from pyspark.sql import functions as F

from pairsift.operators import windows as WN
from pairsift.scale import ordered_scan

from .agg import TRANS
from .base import register, sql


@register("w01_progress", sql("timed", "SELECT hand_id, phase, table_id, phase_progress FROM timed", "phase_progress"))
def progress(t):
    return WN.progress(t.hands, ["table_id", "phase"], [F.col("started_at"), F.col("hand_id")]).select("hand_id", "phase", "table_id", "phase_progress")


def _pct(c, part):
    return (f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {c} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2e0) / count({c}) OVER (PARTITION BY {part}) END")


@register("w02_pct_rank_avg", sql("", f"""
    SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, {_pct("l_quantity", "l_suppkey")} AS l_quantity__pct, {_pct("ratio", "l_suppkey")} AS ratio__pct
    FROM (SELECT *, round(l_tax / nullif(l_discount, 0), 6) AS ratio FROM lineitem)""", "l_quantity__pct ratio__pct"))
def pct_rank_avg(t):
    li = t.raw["lineitem"].withColumn("ratio", F.round(F.try_divide("l_tax", "l_discount"), 6))
    return WN.pct_rank_avg(li.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "ratio"), ["l_suppkey"], ["l_quantity", "ratio"]).drop("l_quantity", "ratio")


@register("w03_pct_rank_global", sql("pairs", f"""
    SELECT pair_id, least(greatest({_pct("shared_hands", "1")}, 0.000001e0), 1 - 0.000001e0) AS pct FROM pairs""", "pct"))
def pct_rank_global(t):
    return WN.pct_rank_global(t.written_pairs, "shared_hands").select("pair_id", "pct")


@register("w04_transitions", sql("context event_hands_timed", f"""
    SELECT s.*, phase, phase_progress FROM ({TRANS}) s JOIN event_hands_timed h ON h.hand_id = s.hand_id""", "phase_progress"))
def transitions(t):
    return WN.transitions(t.context, t.event_hands_timed)


@register("w05_rank_in_group", sql("", """
    SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders"""))
def rank_in_group(t):
    return WN.rank_in_group(t.raw["orders"].select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"],
                            [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "o_custkey", "rank")


@register("w06_top_k", sql("", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5"""))
def top_k(t):
    li = t.raw["lineitem"].select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return WN.top_k(li, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 5).drop("l_extendedprice")


@register("w07_with_totals", sql("", """
    SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total FROM lineitem""", "total"))
def with_totals(t):
    li = t.raw["lineitem"].select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_quantity")
    return WN.with_totals(li, ["l_suppkey"], {"total": "l_quantity"}).drop("l_quantity")


@register("w08_evidence_bearing", sql("seats", """
    SELECT hand_id, player_id, flagged FROM seats WHERE hand_id IN (SELECT hand_id FROM seats WHERE flagged = 1)"""))
def evidence_bearing(t):
    return WN.evidence_bearing(t.seats.select("hand_id", "player_id", "flagged"), ["hand_id"], "flagged")


@register("w09_cumulative_hits", sql("scored", """
    SELECT pool, doc_id, row_number() OVER w AS position, CAST(sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hits FROM scored
    WINDOW w AS (PARTITION BY pool ORDER BY score DESC, doc_id)"""))
def cumulative_hits(t):
    return WN.cumulative_hits(t.scored, ["pool"], [F.col("score").desc(), F.col("doc_id")], "label").select("pool", "doc_id", "position", "hits")


@register("g00_prefix_sum", sql("", """
    SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey) AS running, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position
    FROM orders""", "running", 2), digits=2)
def prefix_sum(t):
    """Global running sum, forced through the split path: no piece may hold over 2,000 rows."""
    o = t.raw["orders"].select("o_orderkey", "o_orderdate", "o_totalprice")
    return ordered_scan(o, [F.col("o_orderdate"), F.col("o_orderkey")], sums={"running": "o_totalprice", "position": F.lit(1)},
                        limit=2000).select("o_orderkey", "running", "position")
