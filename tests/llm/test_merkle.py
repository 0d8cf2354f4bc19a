import pytest
from pyspark.sql import functions as F

from pairsift.llm import merkle
from pairsift.llm.queries import ORACLE_SQL, op4_warc_fixity

from ..compare import compare, connect
from .data import SMALL, have_tables


def pages(spark, n=700):
    return spark.range(n).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat('é', int(id % 17)) AS html", "1 AS file", "2 AS hash")


@pytest.mark.parametrize("records", [10, 2048])
def test_locates_damage(spark, records):
    first = merkle.archive(pages(spark), records=records)
    assert merkle.audit(first, first).count() == 0
    second = first.where("page_id != 699").withColumn("record", F.when(F.col("page_id").isin(3, 350), F.lit("bad")).otherwise(F.col("record")))
    second = second.union(first.where("page_id = 0").withColumn("file", F.lit(0).cast("long")).withColumn("row", F.lit(99999).cast("long")))
    found = {(r.page_id, r.status) for r in merkle.audit(first, second).where("status != 'moved'").collect()}
    assert found == {(3, "changed"), (350, "changed"), (699, "missing"), (0, "added")}


def test_a_record_lost_in_the_middle(spark):
    """The replica is archived anew without one page: it alone is missing, others moved."""
    made = pages(spark, 400).withColumn("html", F.concat("html", F.col("page_id").cast("string")))
    first, second = merkle.archive(made), merkle.archive(made.where("page_id != 7"))
    found = [(r.page_id, r.status) for r in merkle.audit(first, second).collect()]
    assert [f for f in found if f[1] != "moved"] == [(7, "missing")]
    assert sorted(f[0] for f in found if f[1] == "moved") == list(range(8, 400))


def test_offsets(spark):
    first = merkle.archive(pages(spark, 100), records=30)
    whole = {}
    for r in first.orderBy("file", "row").collect():
        data = r.record.encode()
        whole.setdefault(r.file, b"")
        whole[r.file] += data
    for r in merkle.leaves(first).join(first.select("file", "row", "record"), ["file", "row"]).collect():
        assert whole[r.file][r.start : r.start + r.length] == r.record.encode()


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (1, None, "x" * 300_000)], "page_id long, url string, html string")
    first = merkle.archive(rows)
    assert first.count() == 4
    second = first.withColumn("record", F.when(F.col("page_id").isNull(), F.lit("")).otherwise(F.col("record")))
    assert [(r.page_id, r.status) for r in merkle.audit(first, second).where("status = 'changed'").collect()] == [(None, "changed")]
    none = merkle.archive(rows.limit(0))
    assert merkle.audit(none, none).count() == 0
    assert {r.status for r in merkle.audit(first, none).collect()} == {"missing"}


@pytest.mark.skipif(not have_tables(), reason="no tables")
def test_query(spark):
    assert compare(op4_warc_fixity(spark, SMALL), connect(SMALL), ORACLE_SQL["op4_warc_fixity"]) is None
