"""Writing tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scale import as_col


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet, or CSV with a header."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def publish(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write once: fails when the target exists."""
    write_table(df, path, fmt, mode="errorifexists")


def report_json(df: DataFrame, name: str = "report") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*[as_col(c) for c in df.columns])).alias(name))


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document per row, as text lines."""
    report_json(df).write.mode("overwrite").text(path)
