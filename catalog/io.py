"""Source and sink queries."""

import uuid

from pyspark.sql import functions as F

from pairsift.session import ensure_checkpoint_dir
from pairsift.sources import sinks as S, tables as T

from .base import register, sql


def _scratch(t, name: str) -> str:
    """Work folder beside the session's checkpoint folder, new for each call."""
    ensure_checkpoint_dir(t.spark)
    base = t.spark.sparkContext.getCheckpointDir()
    return f"{base}/stage-{name}-{uuid.uuid4().hex}"


@register("io01_load_tables", sql("", """
    SELECT n_name, r_name, count(*) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
    GROUP BY n_name, r_name"""))
def load(t):
    d = T.load_tables(t.spark, t.folder, {n: f"{n}.parquet" for n in ("nation", "region", "supplier")})
    return (
        d["supplier"].join(d["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(d["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("suppliers"))
    )


@register("io02_pruned_scan", sql("", "SELECT l_orderkey, l_extendedprice FROM lineitem", "l_extendedprice"))
def pruned(t):
    return T.scan(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_extendedprice"])


@register("io03_pushed_scan", sql("", """
    SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45""", "l_quantity"))
def pushed(t):
    return T.scan(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"],
                  (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))


@register("io04_materialize", sql("seats", "SELECT player_id, count(*) AS hands, round(sum(net_chips), 2) AS net FROM seats GROUP BY player_id", "net", 2), 2)
def materialize(t):
    path = _scratch(t, "seats")
    first = T.materialize(t.spark, lambda: t.seats.select("player_id", "net_chips"), path)
    again = T.materialize(t.spark, lambda: first.where(F.lit(False)), path)  # read, not rebuilt
    return again.groupBy("player_id").agg(F.count(F.lit(1)).alias("hands"), F.round(F.sum("net_chips"), 2).alias("net"))


@register("io05_write_csv", sql("", "SELECT s_suppkey, s_name, s_nationkey FROM supplier"))
def write_csv(t):
    path = _scratch(t, "csv")
    S.write_table(t.raw["supplier"].select("s_suppkey", "s_name", "s_nationkey"), path, "csv")
    return T.scan(t.spark, path, fmt="csv", schema="s_suppkey long, s_name string, s_nationkey int")


@register("io06_publish", sql("seats", "SELECT hand_id, player_id, seat_no FROM seats"))
def publish(t):
    path = _scratch(t, "published")
    S.publish(t.seats.select("hand_id", "player_id", "seat_no"), path)
    return t.spark.read.parquet(path)


@register("io07_report", sql("", """
    SELECT '{"nation":' || s_nationkey || ',"suppliers":' || count(*) || '}' AS report FROM supplier GROUP BY s_nationkey"""))
def report(t):
    return S.report_json(t.raw["supplier"].groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers")))


@register("io08_fingerprint", sql("", """
    SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR),
        o_orderpriority, o_orderstatus)), 1, 13)) AS BIGINT)) AS VARCHAR) AS hash FROM orders"""))
def fingerprint(t):
    return T.fingerprint(t.raw["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
