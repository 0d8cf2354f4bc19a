"""Benchmark decontamination by spaced-seed hashing.

Texts are runs of words, lower-cased in A-Z. A benchmark item is cut into windows of SPAN
words, one at every word; an item of fewer words is one window of its own length. A
document matches a window where, at one place, all but a fifth of the words agree
(at least SPAN - SPARE of SPAN words; all of fewer than five).

Fixed masks ignore some positions and hash the others. The positions fall into four
classes, and each mask ignores two of them, so any two substitutions leave one mask
untouched: no match with up to SPARE = 2 substitutions is missed. Windows of fewer than
five words allow none and have one mask that hashes all. Hashes of documents that
pass a fixed-size filter of the benchmark's hashes are joined with them, and the words
around each hit are compared.

Windows with equal words are one row, owned by the smallest item_id, so a passage that
many items share is compared once. Null, empty and short texts match nothing. Rows that
repeat a doc_id are one document. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_columns, ship, staged
from .words import mix, word_hashes

#: Windows start at every STRIDE = 1 words, and items of LEAST = 1 words count.
SPAN, STRIDE, SPARE, LEAST = 12, 1, 2, 1
#: Slots of the hash filter; a fixed size, whatever the benchmark's.
SLOTS = 1 << 24
_GROUPS = 4
_WEIGHT = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, SPAN, dtype=np.uint64) | np.uint64(1)


def masks(span: int) -> list[np.ndarray]:
    """Kept positions of each mask: those of two of the four classes `position mod 4`."""
    place = np.arange(span)
    return [np.flatnonzero((place % _GROUPS == a) | (place % _GROUPS == b)) for a, b in combinations(range(_GROUPS), 2)]


def seeds(words: np.ndarray, span: int) -> np.ndarray:
    """Hash of every mask (rows) at every place (columns) of a text."""
    places = len(words) - span + 1
    kinds = masks(span) if span >= 5 else [np.arange(span)]
    out = np.empty((len(kinds), max(0, places)), np.uint64)
    for m, kept in enumerate(kinds if places > 0 else []):
        acc = np.full(places, np.uint64(span * 8 + m), np.uint64)
        for p in kept:
            acc += words[p : p + places] * _WEIGHT[p]
        out[m] = mix(acc)
    return out


def _cut(words: np.ndarray, place: int, span: int) -> bytes:
    return words[place : place + span].tobytes()


_HIT = "hash long, span int, words binary"


def _windows(text: str | None) -> list[tuple[int, int, bytes]]:
    """(hash, span, words) of every mask of an item's windows."""
    words = word_hashes((text or "").encode("utf-8", "replace"))
    n = len(words)
    if n < LEAST:
        return []
    span = min(SPAN, n)
    found = seeds(words, span).view(np.int64)
    return [(int(found[m, p]), span, _cut(words, p, span)) for p in range(0, n - span + 1, STRIDE) for m in range(len(found))]


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """hash, span, words, item_id (smallest with these words); one row per mask and window."""
    hits = T.ArrayType(T.StructType([
        T.StructField("hash", T.LongType()), T.StructField("span", T.IntegerType()), T.StructField("words", T.BinaryType()),
    ]))
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("span", pa.int32()), ("words", pa.binary())]))

    def run(batch: pa.RecordBatch) -> list:
        rows = [[{"hash": h, "span": s, "words": w} for h, s, w in _windows(t)] for t in batch.column(0).to_pylist()]
        return [pa.array(rows, kind)]

    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    made = arrow_columns(named, ["text"], [T.StructField("hits", hits)], run).select("item_id", F.inline("hits"))
    return made.groupBy("hash", "span", "words").agg(F.min("item_id").alias("item_id"))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps: doc_id, place (word number), span, equal (words that agree), item_id."""
    spark = docs.sparkSession
    ship(spark)
    windows = staged(benchmark_windows(items, item_id, item_text), "windows")
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())
    wanted = np.zeros(SLOTS, bool)
    slots = windows.select(F.col("hash").bitwiseAND(SLOTS - 1).cast("int")).distinct().toArrow()
    wanted[slots.column(0).to_numpy()] = True
    packed = spark.sparkContext.broadcast(np.packbits(wanted).tobytes())

    def run(batches):
        keep = np.unpackbits(np.frombuffer(packed.value, np.uint8)).view(bool)
        low = np.uint64(SLOTS - 1)
        for batch in batches:
            for ident, hashed, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = word_hashes((value.as_py() or "").encode("utf-8", "replace"))
                rows = []
                for span in spans:
                    found = seeds(words, span)
                    for m, p in zip(*np.nonzero(keep[found & low])):
                        rows.append((ident, hashed, int(p), int(found[m, p].view(np.int64)), span, _cut(words, p, span)))
                if rows:
                    columns = zip(*rows)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text_hash", "place", "hash", "span", "words"])

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    hits = named.mapInArrow(run, "doc_id long, text_hash long, place long, " + _HIT)
    # Words are 8 bytes each; the comparison is one hex text against another, word by word.
    def word(column: str, i: int):
        return F.substring(F.col(column), 8 * i + 1, 8)

    joined = hits.join(windows.withColumnRenamed("words", "theirs"), ["hash", "span"])
    equal = sum(F.when((F.col("span") > i) & (word("words", i) == word("theirs", i)), 1).otherwise(0) for i in range(SPAN))
    near = joined.withColumn("equal", equal).where(F.col("equal") >= F.col("span") - F.least(F.lit(SPARE), F.floor(F.col("span") / 5)))
    # Several masks find the same overlap.
    return near.groupBy("doc_id", "text_hash", "place", "span", "theirs").agg(F.max("equal").alias("equal"), F.min("item_id").alias("item_id")).drop("theirs")


def contaminated(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """One row per contaminated document: doc_id, item_ids (sorted list), n_windows, most_equal."""
    found = matches(docs, items, **names)
    return found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n_windows"),
        F.max("equal").cast("long").alias("most_equal"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`, all columns, without contaminated documents.

    Rows are judged by doc_id, compared null-safely, and text: a clean text stays beside a
    contaminated one of the same id, or of none.
    """
    found = matches(docs, items, doc_id=doc_id, text=text).select(F.col("doc_id").alias("__hit"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("__hit")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__hash"))
    return docs.join(found, same, "left_anti")
