"""Reading tables and keeping stage tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scale import as_col


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where=None,
         fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Read a table; Spark prunes to `columns` and pushes `where` into the scan."""
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def load_tables(spark: SparkSession, folder: str, spec: dict[str, str | tuple]) -> dict[str, DataFrame]:
    """Read named tables. A spec value is a file name, or (file name, schema) for CSV."""
    out = {}
    for name, entry in spec.items():
        file, schema = entry if isinstance(entry, tuple) else (entry, None)
        fmt = "csv" if file.endswith(".csv") else "parquet"
        out[name] = scan(spark, f"{folder.rstrip('/')}/{file}", fmt=fmt, schema=schema)
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table path exists, on any file system Spark can reach."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def _file(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, on any file system Spark can reach; None if it is not there."""
    jpath, fs = _file(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    jpath, fs = _file(spark, path)
    stream = fs.create(jpath, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def inputs_manifest(inputs: dict) -> str:
    """What a stage is made from, as text: each table's schema, plan and files (path, length,
    time of change), or its content if it has no files; every other value as it prints."""
    out = {}
    for name, value in inputs.items():
        if not isinstance(value, DataFrame):
            out[name] = repr(value)
            continue
        files = []
        for path in sorted(value.inputFiles()):
            jpath, fs = _file(value.sparkSession, path)
            status = fs.getFileStatus(jpath)
            files.append([path, status.getLen(), status.getModificationTime()])
        if not files:
            files = [str(x) for x in fingerprint(value).first()]
        plan = value._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        out[name] = {"schema": value.schema.simpleString(), "plan": hashlib.md5(plan.encode()).hexdigest(), "files": files}
    return json.dumps(out, sort_keys=True)


#: File beside a stage's data that says what it was made from; written last.
MANIFEST = "_stage.json"


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str, inputs: dict | None = None) -> DataFrame:
    """Compute a stage once.

    A stage is read again only if its data and its manifest are complete and the manifest
    says the same of `inputs` (tables and parameters). One that was cut short, or that was
    made from other files or parameters, is built anew. Without `inputs`, complete data is
    taken as it is.
    """
    path = path.rstrip("/")
    done = path_exists(spark, f"{path}/_SUCCESS")
    wanted = None if inputs is None else inputs_manifest(inputs)
    if not done or (wanted is not None and read_text(spark, f"{path}/{MANIFEST}") != wanted):
        build().write.mode("overwrite").parquet(path)
        if wanted is not None:
            write_text(spark, f"{path}/{MANIFEST}", wanted)
    return spark.read.parquet(path)


def _row_hash(cols: list) -> F.Column:
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("\x00")) for c in cols]
    digest = F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 13)
    return F.conv(digest, 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, cols: list | None = None) -> DataFrame:
    """Row count and an order-free content hash."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(_row_hash(cols or sorted(df.columns))).cast("string").alias("hash"),
    )
