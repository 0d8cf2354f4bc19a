"""Token-id files: a static range asymmetric numeral system (rANS) over shared tables.

Documents are put in ascending order of doc_id and cut into segments of whole documents.
A segment has one frequency table over all its ids and independent blocks of up to BLOCK
ids. In a block, LANES coders take turns, so one step codes LANES ids at once; the block's
final states are its checkpoint, from which it is decoded alone, and a crc32 of its ids
tells a damaged block. A segment is a row of a Parquet table, which any file system that
Spark reads can hold; segments are decoded in parallel.

Ids are those of the library with its own settings, so an added token in a text, such as
<|endoftext|>, is that token. Null and empty texts are the end id alone. Rows that repeat a doc_id follow each other,
ordered by a hash of the text; a null doc_id comes first. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from .bpe import REMEMBERED, SHORT, runs_of
from .common import ROWS, ship

SEGMENT, BLOCK, LANES = 1 << 20, 1 << 18, 2048
#: Runs that go to the library in one string.
JOINED = 2048
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Table:
    """Frequencies of the ids of one segment, scaled to a power of two."""

    def __init__(self, ids: np.ndarray, scaled: np.ndarray):
        self.ids, self.scaled = ids, scaled
        total = int(scaled.sum())
        self.bits = total.bit_length() - 1
        if total != 1 << self.bits:
            raise ValueError("a frequency table must sum to a power of two")
        self.first = np.cumsum(scaled) - scaled

    @classmethod
    def count(cls, values: np.ndarray) -> "Table":
        ids, n = np.unique(values, return_counts=True)
        bits = max(16, int(len(ids)).bit_length() + 2)
        scaled = np.maximum(1, n.astype(np.int64) * (1 << bits) // int(n.sum()))
        over = int(scaled.sum()) - (1 << bits)
        if over <= 0:
            scaled[scaled.argmax()] -= over
        else:  # ids that were raised to one are paid for by the frequent ones
            order = np.argsort(-scaled, kind="stable")
            room = np.cumsum(scaled[order] - 1)
            full = int(np.searchsorted(room, over))
            spent = room[full - 1] if full else 0
            scaled[order[:full]] = 1
            scaled[order[full]] -= over - spent
        return cls(ids.astype(np.uint32), scaled.astype(np.uint32))


def encode_block(values: np.ndarray, table: Table) -> tuple[bytes, bytes]:
    """(final states, words) of ids that are all in the table."""
    at = np.searchsorted(table.ids, values)
    freq, first = table.scaled[at].astype(np.uint64), table.first[at].astype(np.uint64)
    bits = np.uint64(table.bits)
    state = np.full(min(LANES, len(values)), _LOW, np.uint64)
    words = []
    for start in range((len(values) - 1) // LANES * LANES, -1, -LANES):
        f, c = freq[start : start + LANES], first[start : start + LANES]
        x = state[: len(f)]
        full = x >= f << (np.uint64(63) - bits)
        if full.any():
            words.append(x[full].astype(np.uint32))
            x[full] >>= _WORD
        whole = x // f
        x[:] = (whole << bits) + (x - whole * f) + c
    return state.astype("<u8").tobytes(), np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""


def decode_block(states: bytes, words: bytes, n: int, table: Table) -> np.ndarray:
    state, stream = np.frombuffer(states, "<u8").copy(), np.frombuffer(words, "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(table.ids)), table.scaled)
    freq, first = table.scaled.astype(np.uint64), table.first.astype(np.uint64)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out, read = np.empty(n, np.int64), 0
    for start in range(0, n, LANES):
        x = state[: min(LANES, n - start)]
        slot = x & mask
        symbol = owner[slot.astype(np.int64)]
        out[start : start + len(x)] = symbol
        x[:] = freq[symbol] * (x >> bits) + slot - first[symbol]
        short = x < _LOW
        need = int(short.sum())
        if need:
            x[short] = x[short] << _WORD | stream[read : read + need]
            read += need
    return table.ids[out]


#: One row per segment; blocks are in order.
SCHEMA = (
    "part int, seq int, doc_ids array<bigint>, n_tokens array<bigint>, table_ids binary, table_counts binary, "
    "blocks array<struct<n: bigint, states: binary, words: binary, crc32: bigint>>"
)
_BLOCKS = pa.list_(pa.struct([("n", pa.int64()), ("states", pa.binary()), ("words", pa.binary()), ("crc32", pa.int64())]))


def segment_row(part: int, seq: int, doc_ids: list, sizes: list[int], values: np.ndarray) -> pa.RecordBatch:
    table = Table.count(values)
    blocks = []
    for i in range(0, len(values), BLOCK):
        piece = values[i : i + BLOCK]
        states, words = encode_block(piece, table)
        blocks.append({"n": len(piece), "states": states, "words": words, "crc32": zlib.crc32(piece.astype("<u4").tobytes())})
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
            pa.array([sizes], pa.list_(pa.int64())), pa.array([table.ids.astype("<u4").tobytes()], pa.binary()),
            pa.array([table.scaled.astype("<u4").tobytes()], pa.binary()), pa.array([blocks], _BLOCKS),
        ],
        names=["part", "seq", "doc_ids", "n_tokens", "table_ids", "table_counts", "blocks"],
    )


def segment_ids(row: dict) -> np.ndarray:
    """All ids of a segment; a block whose checksum fails raises an error that names it."""
    table = Table(np.frombuffer(row["table_ids"], "<u4"), np.frombuffer(row["table_counts"], "<u4"))
    parts = []
    for i, b in enumerate(row["blocks"]):
        try:
            ids = decode_block(b["states"], b["words"], b["n"], table)
        except ValueError:  # the words ran out
            ids = np.empty(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != b["crc32"]:
            raise ValueError(f"block {i} of segment {row['part']}/{row['seq']} is damaged")
        parts.append(ids)
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


class Library:
    """The tokenizers library, asked once for each run of characters between blanks.

    New runs are joined by blanks and encoded JOINED at a time; the ids are cut apart by the
    bytes they stand for. Texts that hold an added token, which the library finds before it
    splits, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # A character of a byte-level token is one byte.
        self.widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.widths[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of each run with a blank before it."""
        groups = [runs[i : i + JOINED] for i in range(0, len(runs), JOINED)]
        for group, ids in zip(groups, self._many([" " + " ".join(g) for g in groups])):
            ends = np.cumsum([len(r.encode("utf-8", "replace")) + 1 for r in group])
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
            data = ids.tobytes()
            begin = 0
            for run, cut in zip(group, cuts.tolist()):
                yield run, data[4 * begin : 4 * cut]
                begin = cut

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        whole = [any(a in t for a in self.added) for t in texts]
        cut = runs_of([t for t, w in zip(texts, whole) if not w])
        wanted = set().union(*[p[1:] for p in cut])
        if len(self.known) >= REMEMBERED:
            # Runs met since the last change stay within reach, others go.
            self.known, self.older = {}, self.known
        missing = wanted - self.known.keys()
        self.known.update((r, self.older[r]) for r in missing & self.older.keys())
        missing = sorted(missing - self.older.keys())
        self.known.update(self._runs([r for r in missing if len(r) <= SHORT]))
        # A run of any length may come; only short ones are remembered.
        long = dict(self._runs([r for r in missing if len(r) > SHORT]))
        known = (self.known | long if long else self.known).__getitem__
        plain = iter(zip(self._many([p[0] for p in cut]), cut))
        all_of = iter(self._many([t for t, w in zip(texts, whole) if w]))
        out = []
        for w in whole:
            if w:
                out.append(next(all_of).tobytes())
            else:
                first, parts = next(plain)
                out.append(first.tobytes() + b"".join(map(known, parts[1:])))
        return out


@lru_cache(maxsize=1)
def library(path: str) -> Library:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Library(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append `end_id`, and write the segments below `path`."""
    spark = docs.sparkSession
    ship(spark)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The last key splits rows that repeat a doc_id and text.
    keyed = named.withColumn("h", F.xxhash64("text")).withColumn("r", F.monotonically_increasing_id())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = keyed.repartitionByRange(parts, "doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r").select("doc_id", "text")

    def run(batches):
        coder, part, seq = library(tokenizer), TaskContext.get().partitionId(), 0
        end = np.uint32(end_id).tobytes()
        names, sizes, data, total = [], [], [], 0
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            coded = coder.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            for ident, ids in zip(batch.column(0).to_pylist(), coded):
                names.append(ident), sizes.append(len(ids) // 4 + 1), data.extend((ids, end))
                total += sizes[-1]
                if total >= SEGMENT:
                    yield segment_row(part, seq, names, sizes, np.frombuffer(b"".join(data), np.uint32))
                    names, sizes, data, total, seq = [], [], [], 0, seq + 1
        if names:
            yield segment_row(part, seq, names, sizes, np.frombuffer(b"".join(data), np.uint32))

    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, place (part, seq, order within the segment) and ids of every document, in any order."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                sizes = np.array(row["n_tokens"], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                n = len(sizes)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(segment_ids(row).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(offsets[:-1]), ids],
                    names=["doc_id", "part", "seq", "before", "ids"],
                )

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(run, "doc_id long, part int, seq int, before long, ids array<bigint>")


def index(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, base: how many ids stand before each segment. Reads no block."""
    sizes = spark.read.schema(SCHEMA).parquet(path).select(
        "part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    )
    # One row per part crosses to one task; segments are summed within their part.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part").select(
        "part", "seq", (F.col("start") + F.col("inner")).alias("base")
    )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                offsets = np.concatenate([[0], np.cumsum(np.array(row["n_tokens"], np.int64))])
                data = memoryview(segment_ids(row).astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()),
                     pa.array(offsets[:-1]), pa.array(row["n_tokens"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "seq", "before", "n_tokens", "ids_crc32"],
                )

    found = spark.read.schema(SCHEMA).parquet(path).mapInArrow(
        run, "doc_id long, part int, seq int, before long, n_tokens long, ids_crc32 long"
    )
    return found.join(index(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
