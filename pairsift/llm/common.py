"""Shared by the operators: written stages, Arrow column maps, file order, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Rows worked on at once; bounds the memory beside the Arrow batch itself.
ROWS = 512
#: Most rows of an Arrow batch.
BATCH = 1024
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on them, and bound
    the rows that Spark packs into one Arrow batch, since a row may hold a long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH:
        spark.conf.set(key, str(BATCH))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH")]))


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table once and read it back: cuts lineage and survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folder of a table made by staged() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: list[T.StructField],
    fn: Callable[[pa.RecordBatch], list],
) -> DataFrame:
    """Keep every column and add `outputs`, computed batch by batch from `inputs`.

    A column that already has an output's name is replaced.
    """
    ship(df.sparkSession)
    names = {f.name for f in outputs}
    kept = [c for c in df.columns if c not in names]
    asked = {c: f"__in_{i}" for i, c in enumerate(inputs)}
    frame = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(a) for c, a in asked.items()])
    schema = T.StructType([frame.schema[c] for c in kept] + outputs)
    n, labels = len(kept), list(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            made = fn(pa.RecordBatch.from_arrays(batch.columns[n:], names=labels))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*kept, *[f.name for f in outputs]])

    return frame.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32(doc_id as text) mod 3 is 1 are never learnt from; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def list_array(values, offsets, kind) -> pa.Array:
    """Arrow lists over a flat numpy array."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable for every node of `edges` (a long, b long): columns node, root.

    Each round takes the smallest root among a node's neighbours and then follows roots
    once more, so chains halve. Counts combine before the shuffle and hubs are only ever
    joined, never gathered. Every round is written, none is kept on one executor.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    both = staged(pairs.union(pairs.select("b", "a")).toDF("node", "other"), "edges")
    roots = staged(
        both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")), "roots"
    )
    for _ in range(rounds):
        nearest = (
            both.join(roots.toDF("other", "r"), "other").groupBy("node").agg(F.min("r").alias("m"))
        )
        lower = roots.join(nearest, "node").select(
            "node", F.col("root").alias("was"), F.least("root", "m").alias("root")
        )
        lower = staged(lower, "lower")
        ahead = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = staged(
            lower.join(ahead, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("was")).alias("moved")
            ),
            "roots",
        )
        roots = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {rounds} rounds")
