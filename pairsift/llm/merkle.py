"""WARC fixity audit by Merkle trees.

Pages become WARC records in a total order, cut by ranges into archive files. A leaf is the
sha256 of a record with its offset range in its file; a node hashes the leaves or nodes of
FAN neighbours, in order, with their ranges; file roots form a further tree up to one root.
Two replicas are compared from the root down: at each level only the children of nodes that
differ are read, and at the leaves the damaged records are named with their offsets.

Inside differing nodes, records of a file are matched by hash, then by page_id, so one that
was lost leaves the later ones "moved" at most.

A null field is written as empty. Records with equal ids are ordered by url and record. A
record that only one replica holds is "missing" (second lacks it) or "added". An empty
archive has no nodes and equals another empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import staged

FAN_BITS = 4
#: Records of one archive file, on average.
RECORDS = 2048
CRLF = "\r\n"


def record(url, body):
    """One WARC resource record as text."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"),
        F.lit(CRLF + CRLF), body, F.lit(CRLF + CRLF),
    )


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", records: int = RECORDS) -> DataFrame:
    """Written archive: file, row, page_id, record; files are ranges of the order."""
    made = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), record(F.col(url), F.col(html)).alias("record"))
    files = max(1, -(-pages.count() // records))
    keyed = made.withColumn("h", F.xxhash64("record")).withColumn("r", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(files, "page_id", "url", "h", "r").sortWithinPartitions("page_id", "url", "h", "r")
    # The file and the place in it are fixed by writing them down.
    place = F.monotonically_increasing_id()
    return staged(
        ordered.select(F.shiftright(place, 33).alias("file"), place.bitwiseAND((1 << 33) - 1).alias("row"), "page_id", "record"), "archive"
    )


def leaves(replica: DataFrame) -> DataFrame:
    """file, row, page_id, start, length, hash of each record; `start` is the offset in the file."""
    made = replica.select("file", "row", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("hash"))
    before = W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    return staged(made.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0))), "leaves")


def _parents(level: DataFrame, keys: list) -> DataFrame:
    """Nodes over at most FAN children; the children's ranges are hashed with them."""
    child = F.struct("at", F.concat_ws(":", "start", "end", "hash").alias("said"))
    joined = F.concat_ws("|", F.transform(F.sort_array(F.collect_list(child)), lambda c: c["said"]))
    return level.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(joined, 256).alias("hash"))


def tree(nodes: DataFrame, heights: tuple[int, int]) -> list[DataFrame]:
    """Levels from the leaves to the root: file, at, start, end, hash; `at` is the place in the level."""
    level = nodes.select("file", F.col("row").alias("at"), "start", (F.col("start") + F.col("length")).alias("end"), "hash")
    out = [level]
    for _ in range(heights[0]):
        level = staged(_parents(level.withColumn("up", F.shiftright("at", FAN_BITS)), ["file", "up"]).withColumnRenamed("up", "at"), "nodes")
        out.append(level)
    # From here on a node stands for a range of files.
    level = level.withColumn("at", F.col("file"))
    for _ in range(heights[1]):
        level = staged(_parents(level.withColumn("up", F.shiftright("at", FAN_BITS)), ["up"]).select(F.lit(-1).cast("long").alias("file"), F.col("up").alias("at"), "start", "end", "hash"), "nodes")
        out.append(level)
    return out


def _height(count: int) -> int:
    height = 0
    while count > 1:
        count = -(-count // (1 << FAN_BITS))
        height += 1
    return height


def heights(*replicas: DataFrame) -> tuple[int, int]:
    """Levels within files and above them that bring every replica to one root."""
    rows = files = 0
    for r in replicas:
        found = r.agg(F.max("row"), F.max("file")).first()
        rows, files = max(rows, (found[0] or 0) + 1), max(files, (found[1] or 0) + 1)
    return _height(rows), _height(files)


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes (file, at) whose hash or range is not the same in both."""
    left = a.select("file", "at", F.struct("start", "end", "hash").alias("a"))
    right = b.select("file", "at", F.struct("start", "end", "hash").alias("b"))
    return left.join(right, ["file", "at"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "at", "a", "b")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Damaged records of two replicas (file, row, page_id, record), which need not be written
    down: file, row, page_id, status, start, length, hash_a, hash_b; offsets are the first's where it has the record."""
    a, b = leaves(first), leaves(second)
    height = heights(a, b)
    levels_a, levels_b = tree(a, height), tree(b, height)
    bad = staged(_differ(levels_a[-1], levels_b[-1]).select("file", "at"), "bad")
    for depth in range(len(levels_a) - 2, -1, -1):
        above = depth >= height[0]  # children are nodes over files, or the files' roots
        keys = [F.shiftright("file" if depth == height[0] else "at", FAN_BITS).alias("up_at"), (F.lit(-1).cast("long") if above else F.col("file")).alias("up_file")]
        suspects = bad.select(F.col("file").alias("up_file"), F.col("at").alias("up_at"))
        below = [
            side[depth].select("*", *keys).join(suspects, ["up_file", "up_at"], "left_semi").drop("up_at", "up_file")
            for side in (levels_a, levels_b)
        ]
        if depth:
            bad = staged(_differ(*below).select("file", "at"), "bad")
    if len(levels_a) == 1:
        below = [levels_a[0], levels_b[0]]
    return _aligned(*below, a, b)


def _aligned(left: DataFrame, right: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves below differing nodes, matched by hash before place, so that a record lost in
    the middle of a file does not accuse those after it. What is left pairs up by page_id."""
    side = lambda s, x: s.join(x.select("file", F.col("row").alias("at"), "page_id"), ["file", "at"]).withColumn(
        "nth", F.row_number().over(W.partitionBy("file", "hash").orderBy("at")))
    pick = lambda s, x, name: side(s, x).select("file", "hash", "nth", F.struct("at", "page_id", "start", "end", "hash").alias(name))
    met = pick(left, a, "a").join(pick(right, b, "b"), ["file", "hash", "nth"], "full_outer")
    moved = met.where("a IS NOT NULL AND b IS NOT NULL AND (a.start != b.start OR a.end != b.end)").select("file", "a", "b")

    def alone(name: str, other: str) -> DataFrame:
        rows = met.where(f"{other} IS NULL").select("file", F.col(f"{name}.page_id").alias("page_id"), name)
        return rows.withColumn("nth", F.row_number().over(W.partitionBy("file", "page_id").orderBy(f"{name}.at")))

    x, y = alone("a", "b").alias("x"), alone("b", "a").alias("y")
    same = (F.col("x.file") == F.col("y.file")) & F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.nth") == F.col("y.nth"))
    rest = x.join(y, same, "full_outer").select(F.coalesce("x.file", "y.file").alias("file"), "a", "b")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(
        F.col("a.hash") == F.col("b.hash"), "moved").otherwise("changed")
    return moved.union(rest).select(
        "file", F.coalesce("a.at", "b.at").alias("row"), F.coalesce("a.page_id", "b.page_id").alias("page_id"), status.alias("status"),
        F.coalesce("a.start", "b.start").alias("start"),
        (F.coalesce("a.end", "b.end") - F.coalesce("a.start", "b.start")).alias("length"),
        F.col("a.hash").alias("hash_a"), F.col("b.hash").alias("hash_b"),
    )


def file_starts(replica: DataFrame) -> DataFrame:
    """file, base: bytes of all files before it. One row per file crosses to one task."""
    sizes = replica.groupBy("file").agg(F.sum(F.octet_length("record").cast("long")).alias("size"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
