"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration.

A text becomes statistics of its characters, words and lines, each on a bounded or
logarithmic scale. Standardised, they go through cosines with Gaussian frequencies, whose
products approximate a Gaussian kernel. Each partition sums its part of the normal
equations, per fold; the folds' sums are added up in Spark and are of a fixed size. Every
fold is scored by the ridge fitted without it, which also chooses the penalty; pooled
scores are calibrated by isotonic regression on scores rounded to 1/STEPS.

Learning uses all labelled rows it is given. Null, empty and blank texts have statistics of
zero and are scored like any other. Without labels of both kinds every score is 0.5, or the
one kind's value. Rows that repeat a doc_id count as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_columns, ship

COSINES, FOLDS, STEPS = 192, 4, 1000
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
#: Kernel width in standard deviations times the root of the number of statistics.
WIDTH = 1.0

_KIND = np.zeros(256, np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[128:] = 5
_KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 6
_KIND[(_KIND == 0)] = 7
STATISTICS = 22


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text."""
    out = np.zeros(STATISTICS)
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return out
    b = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_KIND[b], minlength=8) / len(b)
    out[0:8] = np.sqrt(kinds)
    histogram = np.bincount(b, minlength=256)
    p = histogram[histogram > 0] / len(b)
    out[8] = -(p * np.log2(p)).sum() / 8
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = len(words)
    out[9] = np.log1p(n)
    out[10] = np.log1p(sizes.mean())
    out[11] = np.log1p(sizes.std())
    out[12] = np.log1p(sizes.max())
    out[13] = (sizes <= 3).mean()
    distinct = len(set(words))
    out[14] = distinct / n
    out[15] = np.log1p(n) - np.log1p(distinct)
    pairs = len(set(zip(words, words[1:])))
    out[16] = pairs / max(1, n - 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[17] = np.log1p(len(lines))
    out[18] = len(set(lines)) / len(lines)
    out[19] = np.log1p(len(data) / len(lines))
    upper = histogram[65:91].sum()
    out[20] = upper / max(1, upper + histogram[97:123].sum())
    out[21] = np.mean([w[-1:] in b".,!?;:" for w in words])
    return out


def add_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Add the statistics of the whole text as an array of doubles."""

    def run(batch: pa.RecordBatch) -> list:
        rows = [statistics(t) for t in batch.column(0).to_pylist()]
        flat = np.concatenate(rows) if rows else np.empty(0)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * STATISTICS
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

    return arrow_columns(docs, [text], [T.StructField(out, T.ArrayType(T.DoubleType()))], run)


def cosines(rows: np.ndarray, centre: np.ndarray, spread: np.ndarray, seed: int = 11) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    rng = np.random.Generator(np.random.PCG64(seed))
    omega = rng.normal(size=(STATISTICS, COSINES)) / (WIDTH * np.sqrt(STATISTICS))
    phase = rng.uniform(0, 2 * np.pi, COSINES)
    scaled = np.clip((rows - centre) / spread, -8, 8)
    return np.hstack([np.cos(scaled @ omega + phase) * np.sqrt(2 / COSINES), np.ones((len(rows), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, STATISTICS)


def normal_equations(rows: DataFrame, centre: np.ndarray, spread: np.ndarray) -> list[np.ndarray]:
    """Per fold the sums of z z' with z = (features, label), from rows (stats, label, fold)."""
    size = COSINES + 2
    upper = np.triu_indices(size)

    def run(batches):
        sums = np.zeros((FOLDS, size, size))
        for batch in batches:
            label = batch.column(1).to_numpy().astype(float)
            z = np.hstack([cosines(_matrix(batch.column(0)), centre, spread), label[:, None]])
            fold = batch.column(2).to_numpy()
            for f in range(FOLDS):
                sums[f] += z[fold == f].T @ z[fold == f]
        cells = len(upper[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(FOLDS), cells)), pa.array(np.tile(np.arange(cells), FOLDS)), pa.array(np.concatenate([s[upper] for s in sums]))],
            names=["fold", "cell", "v"],
        )

    ship(rows.sparkSession)
    summed = rows.mapInArrow(run, "fold long, cell long, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((FOLDS, size, size))
    fold, cell, v = (summed.column(i).to_numpy() for i in range(3))
    out[fold, upper[0][cell], upper[1][cell]] = v
    return [m + np.triu(m, 1).T for m in out]


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Weights that minimise the squared error plus penalty, from summed normal equations."""
    a, b = sums[:-1, :-1], sums[:-1, -1]
    n = max(sums[-2, -2], 1.0)
    weight = np.full(len(b), penalty * n / COSINES)
    weight[-1] = 1e-9
    return np.linalg.solve(a + np.diag(weight), b)


def isotonic(scores: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing means over ordered scores."""
    blocks: list[list[float]] = []
    for s, o, c in zip(scores, ones, counts):
        blocks.append([s, s, float(o), float(c)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, o2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + o2, blocks[-1][3] + c2]
    xs, ys = [], []
    for lo, hi, o, c in blocks:
        # One row of each kind keeps a small block off 0 and 1.
        y = (o + 0.5) / (c + 1)
        xs += [lo, hi] if hi > lo else [lo]
        ys += [y, y] if hi > lo else [y]
    return np.array(xs), np.maximum.accumulate(ys)


def fit(labelled: DataFrame) -> dict:
    """Model from all rows (doc_id, stats, label 0 or 1); rows with a null label are left out."""
    rows = labelled.where("label IS NOT NULL").select(
        "stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).alias("fold")
    )
    moments = rows.select(F.posexplode("stats").alias("i", "v"), "label").groupBy("i").agg(
        F.avg("v"), F.stddev_pop("v"), F.avg("label"), F.count(F.lit(1))
    ).orderBy("i").collect()
    if not moments:
        return {"constant": 0.5}
    if moments[0][3] in (0.0, 1.0):
        return {"constant": moments[0][3]}
    centre = np.array([m[1] for m in moments])
    spread = np.maximum(np.array([m[2] for m in moments]), 1e-6)
    sums = normal_equations(rows, centre, spread)
    whole = sum(sums)

    def loss(penalty: float) -> float:
        total = 0.0
        for s in sums:
            w = np.append(ridge(whole - s, penalty), -1.0)
            total += w @ s @ w
        return total

    penalty = min(PENALTIES, key=loss)
    apart = [ridge(whole - s, penalty) for s in sums]
    model = {"centre": centre, "spread": spread, "weights": ridge(whole, penalty)}

    def run(batch: pa.RecordBatch) -> list:
        z = cosines(_matrix(batch.column(0)), centre, spread)
        fold = batch.column(1).to_numpy()
        raw = (z * np.stack(apart)[fold]).sum(axis=1)
        return [pa.array(np.round(np.clip(raw, -1, 2) * STEPS).astype(np.int64))]

    scored = arrow_columns(rows, ["stats", "fold"], [T.StructField("step", T.LongType())], run)
    levels = scored.groupBy("step").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).orderBy("step").toArrow()
    xs, ys = isotonic(*(levels.column(i).to_numpy().astype(float) for i in range(3)))
    return model | {"xs": xs / STEPS, "ys": ys}


def score(rows: DataFrame, model: dict, stats: str = "stats") -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= 0.5) from the statistics."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        m = shared.value
        if "constant" in m:
            found = np.full(batch.num_rows, m["constant"])
        else:
            raw = cosines(_matrix(batch.column(0)), m["centre"], m["spread"]) @ m["weights"]
            found = np.interp(raw, m["xs"], m["ys"])
        return [pa.array(found), pa.array((found >= 0.5).astype(np.int32))]

    return arrow_columns(rows, [stats], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], run)
