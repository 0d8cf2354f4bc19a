"""Exact metric range join of unit vectors: pivots, boundary replication, independent cells.

Cosine c between unit vectors is distance sqrt(2 - 2c), a metric. Each vector belongs to
the cell of its nearest pivot. It is also sent to every other cell whose members may be
within the radius: if y is in the cell of p and x in that of q, then |xy| is at least
(|xp|^2 - |xq|^2) / (2 |pq|), which the triangle inequality on the line pq gives. Cells are
then joined apart: the members at home in a cell, in blocks of bounded size, meet the
cell's vectors as these stream past. A crowded cell has many blocks, never a large one.

Equal vectors collapse into one class with a count. A block returns per home vector the
number of links, and of the links themselves only a spanning forest, so rows out never
grow with the square of a group.

In high dimensions a large radius replicates to most cells. The result stays exact; the
work then nears the product of blocks and vectors, done as matrix products.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; so do vectors of different lengths with each other. Rows that repeat a vec_id
count as rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_columns, components, ship, staged

#: Home vectors that one block holds.
BLOCK = 4096
#: Pivots; the most vectors that may be drawn to choose them from.
PIVOTS, POOL = 24, 4096
_ROUND = 1e-11


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so nothing overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _usable(values) -> bool:
    if values is None or not len(values) or any(v is None for v in values):
        return False
    found = np.asarray(values, np.float64)
    return bool(np.isfinite(found).all() and found.any())


def _vectors(df: DataFrame, embedding: str) -> DataFrame:
    """Add `vec`, the doubles of a usable vector as bytes, else null."""

    def run(batch: pa.RecordBatch) -> list:
        rows = batch.column(0).to_pylist()
        # Adding zero makes -0.0 equal to 0.0.
        return [pa.array([(np.asarray(v, np.float64) + 0.0).tobytes() if _usable(v) else None for v in rows], pa.binary())]

    return arrow_columns(df, [embedding], [T.StructField("vec", T.BinaryType())], run)


def choose_pivots(classes: DataFrame, dim_bytes: int, pivots: int = PIVOTS) -> np.ndarray:
    """Far-apart unit vectors out of at most POOL, picked by hash of the vector.

    Only the amount of replication depends on the pivots, never the result.
    """
    picked = (
        classes.where(F.length("vec") == dim_bytes).select("vec").orderBy(F.xxhash64("vec"), "vec").limit(POOL).toArrow()
    )
    pool = unit(np.frombuffer(b"".join(x.as_py() for x in picked.column(0)), np.float64).reshape(len(picked), -1))
    chosen = [0]
    far = ((pool - pool[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(pool)) and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((pool - pool[chosen[-1]]) ** 2).sum(axis=1))
    return pool[chosen]


def placements(vectors: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and the cells (vectors x pivots) it must be sent to."""
    square = np.maximum(0, 2 - 2 * vectors @ pivots.T)
    home = square.argmin(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    gap = square - square[np.arange(len(vectors)), home][:, None]
    return home, gap <= 2 * (radius + 1e-9) * apart


def _cos(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


class _Block:
    """Home vectors of one block; links are counted, and joined into a forest."""

    def __init__(self, ids, counts, raw, cosine):
        self.ids, self.raw, self.cosine = np.array(ids, np.int64), np.stack(raw), cosine
        self.vectors = unit(self.raw)
        self.single = self.vectors.astype(np.float32)
        self.links = np.array(counts, np.int64) - 1
        self.parent = np.arange(len(ids))
        self.edges: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def meet(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray) -> None:
        other = unit(raw)
        # Single precision is wrong by far less than the margin; what passes is done in double.
        y, x = np.nonzero(other.astype(np.float32) @ self.single.T >= self.cosine - 1e-4)
        if not len(y):
            return
        exact = np.einsum("ij,ij->i", other[y], self.vectors[x])
        for i in np.flatnonzero(np.abs(exact - self.cosine) < _ROUND):
            exact[i] = _cos(raw[y[i]], self.raw[x[i]])
        good = (exact >= self.cosine) & (ids[y] != self.ids[x])
        y, x = y[good], x[good]
        np.add.at(self.links, x, counts[y])
        last = -1
        for i, j in zip(y.tolist(), x.tolist()):
            a = self._root(j)
            if i != last:
                self.edges.append((int(ids[i]), int(self.ids[a])))
                last, joined = i, a
            elif a != joined:
                # Both have met y; one link keeps them together.
                self.edges.append((int(self.ids[joined]), int(self.ids[a])))
                self.parent[a] = joined


def _join_cells(sent: DataFrame, cosine: float, dim: int) -> DataFrame:
    """Rows (cell, block, guest, id, cnt, vec), sorted so that home rows come first -> a, b, links.

    A row with b null gives a's number of links; the others are forest edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, block = None, ([], [], []), None
        done: list[tuple] = []

        def result():
            if block is not None:
                done.extend((int(i), None, int(n)) for i, n in zip(block.ids, block.links))
                done.extend((a, b, None) for a, b in block.edges)

        for batch in batches:
            cells, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            guest, ids, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            raw = np.frombuffer(b"".join(v.as_py() for v in batch.column(5)), np.float64).reshape(-1, dim)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(blocks) != 0) | (np.diff(guest.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if (cells[a], blocks[a]) != key:
                    result()
                    key, home, block = (cells[a], blocks[a]), ([], [], []), None
                if not guest[a]:
                    home[0].extend(ids[a:b]), home[1].extend(counts[a:b]), home[2].extend(raw[a:b])
                elif home[0]:
                    if block is None:
                        block = _Block(*home, cosine)
                    for i in range(a, b, 1024):
                        j = min(b, i + 1024)
                        block.meet(ids[i:j], counts[i:j], raw[i:j])
            if len(done) > 10_000:
                yield _rows(done)
                done.clear()
        result()
        yield _rows(done)

    return sent.mapInArrow(run, "a long, b long, links long")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])


def range_join(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable), kept; one row per vector."""
    spark = vectors.sparkSession
    ship(spark)
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = staged(_vectors(named, "embedding").drop("embedding").withColumn("rid", F.monotonically_increasing_id()), "vectors")
    classes = staged(
        rows.where("vec IS NOT NULL").groupBy("vec").agg(
            F.min("rid").alias("cid"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("cnt")
        ), "classes",
    )
    per_length = classes.groupBy(F.length("vec").alias("bytes")).count().collect()
    radius = float(np.sqrt(2 - 2 * cosine))
    found = spark.createDataFrame([], "a long, b long, links long")
    for length, total in per_length:  # one pass per vector length, of which a table has one or a few
        pivots = choose_pivots(classes, length)
        cells = spark.sparkContext.broadcast(pivots)
        width = T.ArrayType(T.IntegerType())

        def place(batch: pa.RecordBatch, cells=cells, length=length) -> list:
            block = unit(np.frombuffer(b"".join(v.as_py() for v in batch.column(0)), np.float64).reshape(-1, length // 8))
            home, sent = placements(block, cells.value, radius)
            return [pa.array(home, pa.int32()), pa.array([np.flatnonzero(s).tolist() for s in sent], pa.list_(pa.int32()))]

        placed = staged(
            arrow_columns(classes.where(F.length("vec") == length), ["vec"], [T.StructField("home", T.IntegerType()), T.StructField("sent", width)], place),
            "placed",
        )
        blocks = {r["home"]: -(-r["count"] // BLOCK) for r in placed.groupBy("home").count().collect()}
        count = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
        at_home = placed.select(
            F.col("home").alias("cell"), F.pmod(F.xxhash64("vec"), count[F.col("home")]).cast("int").alias("block"),
            F.lit(False).alias("guest"), "cid", "cnt", "vec",
        )
        guests = placed.select(F.explode("sent").alias("cell"), "cid", "cnt", "vec").where(count[F.col("cell")].isNotNull()).select(
            "cell", F.explode(F.sequence(F.lit(0), (count[F.col("cell")] - 1).cast("int"))).alias("block"),
            F.lit(True).alias("guest"), "cid", "cnt", "vec",
        )
        both = at_home.unionByName(guests)
        ordered = both.repartition(max(1, sum(blocks.values())), "cell", "block").sortWithinPartitions("cell", "block", "guest")
        found = found.unionByName(_join_cells(ordered, cosine, length // 8))
    found = staged(found, "links")

    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("n_links")).toDF("cid", "n_links")
    roots = components(found.where("b IS NOT NULL")).toDF("cid", "root")
    owner = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = owner.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = owner.join(lowest, "root").join(counts, "cid", "left").select("vec", "component_id", "n_links")
    out = rows.select("vec_id", "vec").join(owner, "vec", "left")
    component = F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.col("vec").isNull()).alias("kept"),
    )
