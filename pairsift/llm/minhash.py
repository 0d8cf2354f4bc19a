"""MinHash near-duplicates: one-permutation hashing, optimal densification, star candidates.

The set of a document is its distinct k-word shingles. One hash per shingle fills the bins
of a single permutation; an empty bin borrows from the first filled bin in an order fixed
for that bin. Bins form bands, and equal bands put documents in one bucket.

Documents with the same set collapse into one class first. Per class, one star edge to the
smallest class of its buckets is verified on full sets, and the verified edges' components
are found. In two further rounds, classes meet a few members of another component in their
buckets, so that a large group merges at a cost in proportion to its size. Buckets that
then still hold several components are compared in full: across components, within the
size bound, and where the parity sketch leaves 0.8 possible. That sketch counts the set's
hashes modulo two in 512 slots; two sets differ in at least as many shingles as their
sketches in bits, so it never loses a link. 256 one-bit samples of the bins only rank the
members that a class meets first; in small sets the densified bins repeat a few values, so
their number of unequal bits excludes nothing. Every surviving pair is verified on full
sets, so a pair that shares a bucket is either verified or already connected. With many
shingles, a pair at similarity 0.8 shares no bucket with probability (1 - 0.8^6)^64 = 4e-9.

Null, empty and blank texts have the empty set and link with nothing. Rows that repeat a
doc_id count as rows; a null doc_id never is the smallest. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from .common import arrow_columns, components, list_array, staged
from .words import mix, shingles, word_hashes

BANDS, BAND_ROWS = 64, 6
BINS = BANDS * BAND_ROWS
SKETCH_BITS = 256
#: Slots of the parity sketch, as many longs of 64.
PARITY_BITS = 512
#: Longs of both sketches together: 4 of samples, then 8 of parities.
LONGS = (SKETCH_BITS + PARITY_BITS) // 64
#: Rounds in which a class meets at most TRIES members of another component.
ROUNDS, TRIES = 2, 4
#: Slots of the class filter; a fixed size, whatever the data.
SLOTS = 1 << 20
_KEY = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_EDGES = np.array([(i << 64) // BINS for i in range(1, BINS)], np.uint64)


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """Row j: the place of every bin in the order in which bin j borrows."""
    rng = np.random.Generator(np.random.PCG64(77))
    return np.argsort(rng.random((BINS, BINS)), axis=1).astype(np.int16)


def signature(items: np.ndarray) -> np.ndarray:
    """One value per bin from sorted, distinct, uniform 64-bit hashes; there must be some.

    Bins are equal ranges of the hash, so the least hash of a bin is its first in order.
    """
    cuts = np.concatenate([[0], np.searchsorted(items, _EDGES), [len(items)]])
    filled = np.flatnonzero(cuts[1:] > cuts[:-1])
    source = np.arange(BINS)
    if len(filled) < BINS:
        empty = np.flatnonzero(cuts[1:] == cuts[:-1])
        source[empty] = filled[_orders()[empty][:, filled].argmin(axis=1)]
    return mix(items[cuts[source]])


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    acc = _KEY.copy()
    for column in values.reshape(BANDS, BAND_ROWS).T:
        acc = mix(acc ^ column)
    return acc.view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """One bit of each of the first 256 bins, as four longs."""
    return np.packbits((values[:SKETCH_BITS] >> np.uint64(17)).astype(np.uint8) & 1).view(np.int64)


def parity(items: np.ndarray) -> np.ndarray:
    """How many hashes fall into each slot, modulo two, as eight longs."""
    slots = ((items >> np.uint64(7)) % np.uint64(PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    low = mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    n = np.uint64(len(items))
    pair = np.array([np.bitwise_xor.reduce(items), low.sum(dtype=np.uint64) + n], np.uint64)
    return tuple(int(x) for x in mix(pair).view(np.int64))


def _set(text: str | None, k: int) -> np.ndarray:
    return shingles(word_hashes((text or "").encode("utf-8", "replace")), k)


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text -> doc_id, n, hi, lo, bands (array of long), sketch (LONGS longs)."""

    def run(batch: pa.RecordBatch) -> list:
        n, hi, lo, keys, bits, sizes = [], [], [], [], [], [0]
        for text in batch.column(0).to_pylist():
            items = _set(text, k)
            n.append(len(items))
            if len(items):
                values = signature(items)
                a, b = fingerprint(items)
                keys.append(bands(values))
                bits += [sketch(values), parity(items)]
            else:
                a = b = 0
            hi.append(a), lo.append(b), sizes.append(bool(len(items)))
        offsets = np.cumsum(sizes).astype(np.int32)
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, bits)]
        return [
            pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
            list_array(flat[0], offsets * BANDS, pa.int64()), list_array(flat[1], offsets * LONGS, pa.int64()),
        ]

    longs = T.ArrayType(T.LongType())
    out = [_long("n"), _long("hi"), _long("lo"), T.StructField("bands", longs), T.StructField("sketch", longs)]
    return arrow_columns(docs, ["text"], out, run).drop("text")


def _sets(docs: DataFrame, k: int, classes: DataFrame) -> DataFrame:
    """cid, items (binary of sorted hashes) of `classes` (cid, hi, lo), one row per class.

    Workers drop documents whose fingerprint is in no wanted slot of a fixed-size filter;
    the join decides.
    """
    wanted = np.zeros(SLOTS, bool)
    slots = classes.select((F.col("lo").bitwiseAND(SLOTS - 1)).cast("int").alias("s")).distinct().toArrow()
    wanted[slots.column(0).to_numpy()] = True
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted).tobytes())

    def run(batch: pa.RecordBatch) -> list:
        keep = np.unpackbits(np.frombuffer(packed.value, np.uint8))
        hi, lo, items = [], [], []
        for text in batch.column(0).to_pylist():
            found = _set(text, k)
            a, b = fingerprint(found) if len(found) else (0, 0)
            hi.append(a), lo.append(b)
            items.append(found.tobytes() if len(found) and keep[b & (SLOTS - 1)] else None)
        return [pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(items, pa.large_binary()).cast(pa.binary())]

    made = arrow_columns(docs.select("text"), ["text"], [_long("hi"), _long("lo"), T.StructField("items", T.BinaryType())], run)
    found = made.where("items IS NOT NULL").select("hi", "lo", "items")
    # Equal sets combine within each task before they are dealt out.
    return found.join(classes, ["hi", "lo"]).groupBy("cid").agg(F.first("items").alias("items"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = (
        pairs.join(sets.toDF("b", "items_b"), "b")
        .join(sets.toDF("a", "items_a"), "a")
        .select("a", "b", "items_a", "items_b")
    )

    def run(batch: pa.RecordBatch) -> list:
        same = []
        for x, y in zip(batch.column(0), batch.column(1)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            inter = len(x) + len(y) - len(np.union1d(x, y))
            same.append(100 * inter >= percent * (len(x) + len(y) - inter))
        return [pa.array(same, pa.bool_())]

    checked = arrow_columns(both, ["items_a", "items_b"], [T.StructField("same", T.BooleanType())], run)
    return checked.where("same").select("a", "b")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, cid, n, s0.., root, low) of buckets that hold several components; `low` is the smallest."""
    named = members.join(labels, "cid")
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key", "low")
    return named.join(several, "key")


def _may_reach(percent: int):
    """Size bound and parities of classes a and b, which lose no link; and how many samples differ."""
    differ = [F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(LONGS)]
    samples = SKETCH_BITS // 64
    unequal, apart = sum(differ[:samples]), sum(differ[samples:])
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    # Similarity s leaves a difference of (1 - s) / (1 + s) of both sizes.
    return sizes & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))), unequal


def _side(rows: DataFrame, s: str) -> DataFrame:
    return rows.select("key", F.col("cid").alias(s), F.col("root").alias(f"r{s}"), F.col("n").alias(f"n{s}"), *[F.col(f"s{i}").alias(f"{s}{i}") for i in range(LONGS)])


def _spread_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Classes with a few members of their buckets' smallest component, drawn by hash anew in
    each bucket; the most alike are taken. At most TRIES pairs a class, so a crowd merges."""
    drawn = F.min_by(F.struct("cid", "root", "n", *[f"s{i}" for i in range(LONGS)]), F.xxhash64("cid", "key")).alias("x")
    low = _side(mixed.where("root = low").groupBy("key").agg(drawn).select("key", "x.*"), "a")
    near, unequal = _may_reach(percent)
    met = low.join(_side(mixed.where("root != low"), "b"), "key").where(near).select("a", "b", unequal.alias("u")).distinct()
    # A class has at most one row per band here.
    best = F.row_number().over(W.partitionBy("b").orderBy("u", "a"))
    return met.withColumn("rank", best).where(F.col("rank") <= TRIES).select("a", "b")


def _mixed_pairs(mixed: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a bucket, lie in different components and may reach `percent`."""
    near, _ = _may_reach(percent)
    met = _side(mixed, "a").join(_side(mixed, "b"), "key").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near)
    return met.select("a", "b").distinct().join(done, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept; one row per document."""
    return _row_components(docs, k, percent, doc_id, text).drop("text_hash")


def _row_components(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """near_duplicates() with `text_hash`, which tells rows of one doc_id apart."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = staged(signatures(docs, k).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    full = rows.where("n > 0")
    classes = staged(
        full.groupBy("hi", "lo").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("first"), F.first("n").alias("n")), "classes"
    )

    one = full.join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi")
    keys = one.select(F.explode("bands").alias("key"), F.col("rid").alias("cid"))
    shared = keys.groupBy("key").agg(F.min("cid").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = staged(keys.join(shared.select("key", "leader"), "key"), "buckets")
    known = buckets.select("cid").distinct()
    sets = staged(_sets(docs, k, classes.join(known, "cid", "left_semi").select("cid", "hi", "lo")), "sets")

    star = staged(
        buckets.where("cid != leader").groupBy("cid").agg(F.min("leader").alias("a")).select("a", F.col("cid").alias("b")), "star"
    )
    links = staged(verified(star, sets, percent), "links")
    bits = one.select(F.col("rid").alias("cid"), "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(LONGS)])
    members = buckets.select("key", "cid").join(staged(known.join(bits, "cid"), "members"), "cid")
    for last in [False] * ROUNDS + [True]:
        roots = components(links).toDF("cid", "found")
        labels = known.join(roots, "cid", "left").select("cid", F.coalesce("found", "cid").alias("root"))
        mixed = staged(_mixed(members, labels), "mixed")
        tried = _mixed_pairs(mixed, star, percent) if last else _spread_pairs(mixed, percent)
        links = staged(links.union(verified(tried, sets, percent)), "links")

    roots = components(links).toDF("cid", "root")
    named = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = named.join(lowest, "root").select("hi", "lo", "component_id")
    out = rows.select("doc_id", "text_hash", "n", "hi", "lo").join(owner, ["hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.col("n") == 0).alias("kept"), "text_hash",
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`, all columns, with one document of each group: that with the smallest doc_id.

    Documents without words are no duplicates and stay. Rows are judged by doc_id and text:
    those that repeat a kept doc_id stay beside it, a row that repeats a removed one's id
    with a text of its own stays, and in a group without any doc_id all rows stay.
    """
    found = _row_components(docs, k, percent, doc_id, text)
    gone = found.where("NOT kept AND component_id IS NOT NULL").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col(f"`{doc_id}`").cast(gone.schema["__gone"].dataType).eqNullSafe(F.col("__gone")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__hash"))
    return docs.join(gone, same, "left_anti")
