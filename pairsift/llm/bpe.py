"""Byte-level BPE encoding and decoding by published merge ranks.

Each piece that the split pattern finds is encoded on its own. A segment tree over the
piece's byte positions holds, at every node, the smallest (rank, position) below it; its
root is the leftmost pair of lowest rank. A merge changes at most three live positions,
each a point update up the tree, so a piece of n bytes takes O(n log n).

Null and empty texts have no ids and decode to no bytes. Ids outside the vocabulary
raise an error.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_columns, list_array

_NONE = 1 << 62
#: Runs remembered per worker, each of up to SHORT characters; a full store is kept as the older one.
REMEMBERED, SHORT = 300_000, 100
#: Pieces of up to so many bytes are merged in step, one tree a row; longer ones one by one.
TOGETHER = 64
#: Trees that are worked on in step; few enough to stay in a CPU's cache.
ROWS_AT_ONCE = 4096
#: Characters that end a run of letters as a piece of their own.
_STOPS = (".", ",", ";", ":", "!", "?")
_RUN = re.compile(r"(?<=\S) (?=\S)")


class MinTree:
    """Smallest value of an array under point updates; values carry their position."""

    def __init__(self, values: list[int]):
        size = 1
        while size < len(values):
            size *= 2
        self.size = size
        self.node = [_NONE] * size + values + [_NONE] * (size - len(values))
        for i in range(size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def set(self, place: int, value: int) -> None:
        node, i = self.node, self.size + place
        node[i] = value
        while i > 1:
            i //= 2
            low = min(node[2 * i], node[2 * i + 1])
            if node[i] == low:
                break
            node[i] = low

    def least(self) -> int:
        return self.node[1]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next live part; n ends the piece
    before = list(range(-1, n - 1))

    def key(start: int) -> int:
        mid = after[start]
        if mid >= n:
            return _NONE
        rank = ranks.get(piece[start : after[mid]])
        return _NONE if rank is None else rank << 32 | start

    tree = MinTree([key(i) for i in range(n)])
    while (low := tree.least()) != _NONE:
        at = low & 0xFFFFFFFF
        gone = after[at]
        after[at] = after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        tree.set(gone, _NONE)
        tree.set(at, key(at))
        if before[at] >= 0:
            tree.set(before[at], key(before[at]))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


def runs_of(texts: list[str]) -> list[list[str]]:
    """Each text cut at the blanks that stand between two characters that are no white space.

    The GPT-2 kind of split pattern always starts a piece at such a blank, so runs can be
    encoded apart: the first as it is, the others with the blank before them.
    """
    cut = [t.split(" ") for t in texts]
    odd = {r for r in set().union(*cut) if not r or r[0].isspace() or r[-1].isspace()}
    return [p if odd.isdisjoint(p) else _RUN.split(t) for p, t in zip(cut, texts)] if odd else cut


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a `.tiktoken` file, which every worker can read."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (left id, right id) of all pairs that merge, and the merged ids."""
    keys, ids = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                ids.append(rank)
    keys, ids = np.array(keys, np.int64), np.array(ids, np.int64)
    order = np.argsort(keys)
    return keys[order], ids[order]


class Codec:
    """Encoder and decoder of one vocabulary; remembers the ids of frequent runs of pieces."""

    def __init__(self, path: str, pattern: str):
        self.ranks = vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = max(self.ranks.values()) + 1
        names = [b""] * size
        for name, i in self.ranks.items():
            names[i] = name
        self.lengths = np.array([len(x) for x in names], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.chars = np.frombuffer(b"".join(names), np.uint8)
        self.pairs, self.merged = pair_table(self.ranks)
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tree values of pairs: (rank, place), or _NONE where the pair doesn't merge."""
        asked = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return np.where((right >= 0) & (self.pairs[at] == asked), self.merged[at] << 32 | place, _NONE)

    def _merge_all(self, pieces: list[bytes], size: int) -> list[bytes]:
        """`merge` for many pieces of at most `size` bytes, one tree a row, in step."""
        count = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, count)
        flat = self.single[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)]
        place = np.arange(size)
        # A spare last column takes the writes of rows that have no neighbour there.
        token = np.full((count, size + 1), -1, np.int64)
        token[:, :size] = np.where(place < sizes[:, None], flat.reshape(count, size), -1)
        after = np.minimum(np.tile(np.arange(1, size + 2), (count, 1)), size)
        before = np.tile(np.concatenate([np.arange(-1, size - 1), [0]]), (count, 1))
        before[:, 0] = size
        tree = np.full((count, 2 * size + 1), _NONE, np.int64)
        tree[:, size : 2 * size] = self._keys(token[:, :size], token[:, 1:], place)
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            low = tree[rows, 1]
            at = low & 0xFFFFFFFF
            gone = after[rows, at]
            follow, lead = after[rows, gone], before[rows, at]
            token[rows, at], token[rows, gone] = low >> 32, -1
            after[rows, at], before[rows, follow] = follow, at
            here = token[rows, at]
            for spot, value in (
                (gone, np.full(len(rows), _NONE)),
                (at, self._keys(here, token[rows, follow], at)),
                (lead, np.where(lead < size, self._keys(token[rows, lead], here, lead), _NONE)),
            ):
                node = np.where(spot < size, size + spot, 2 * size)
                tree[rows, node] = value
                for _ in range(size.bit_length() - 1):
                    node = np.where(node < 2 * size, node >> 1, 2 * size)
                    inner = node < size
                    child = np.where(inner, 2 * node, 2 * size)
                    tree[rows, node] = np.minimum(tree[rows, child], tree[rows, np.where(inner, child + 1, child)])
            rows = rows[tree[rows, 1] != _NONE]
        live = token[:, :size] >= 0
        ids = token[:, :size][live].astype(np.int32)
        cuts = np.concatenate([[0], np.cumsum(live.sum(axis=1))]) * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        got: dict[str, bytes] = {}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            if data in self.ranks:
                got[piece] = np.int32(self.ranks[data]).tobytes()
            elif len(data) > TOGETHER:
                got[piece] = np.array(merge(data, self.ranks), np.int32).tobytes()
            else:
                groups.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for size, members in groups.items():
            for i in range(0, len(members), ROWS_AT_ONCE):
                some = members[i : i + ROWS_AT_ONCE]
                got.update(zip([p for p, _ in some], self._merge_all([d for _, d in some], size)))
        return got

    def _learn(self, runs: set[str]) -> None:
        """Encode new runs, each with a blank before it, all together, and remember them."""
        split = {}
        for run in runs:
            if run.isalpha():
                split[run] = [" " + run]
            elif run[-1:] in _STOPS and run[:-1].isalpha():
                split[run] = [" " + run[:-1], run[-1]]
            else:
                split[run] = self.pattern.findall(" " + run)
        got = self._encode_pieces({p for parts in split.values() for p in parts})
        for run, parts in split.items():
            self.known[run] = b"".join([got[p] for p in parts])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; equal runs are encoded once."""
        cut = runs_of(texts)
        runs = set().union(*[p[1:] for p in cut])
        if len(self.known) >= REMEMBERED:
            # Runs met since the last change stay within reach, others go.
            self.known, self.older = {}, self.known
        missing = runs - self.known.keys()
        self.known.update((r, self.older[r]) for r in missing & self.older.keys())
        self._learn(missing - self.older.keys())
        first = [self.pattern.findall(p[0]) for p in cut]
        got = self._encode_pieces({x for parts in first for x in parts})
        known = self.known.__getitem__
        out = [
            np.frombuffer(b"".join([got[x] for x in f]) + b"".join(map(known, p[1:])), np.int32)
            for f, p in zip(first, cut)
        ]
        for run in runs:
            if len(run) > SHORT:
                del self.known[run]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all():
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(lengths) - lengths)
        return self.chars[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, text: str, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """Add `out`, the token ids (array of int) of the whole text; no special tokens."""

    def run(batch: pa.RecordBatch) -> list:
        c = codec(path, pattern)
        parts = c.encode_batch([t or "" for t in batch.column(0).to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return [list_array(np.concatenate(parts) if parts else np.empty(0, np.int32), offsets, pa.int32())]

    return arrow_columns(df, [text], [T.StructField(out, T.ArrayType(T.IntegerType()))], run)


def decode(df: DataFrame, ids: str, path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """Add `out`, the bytes (binary) that the ids stand for; null ids give no bytes."""

    def run(batch: pa.RecordBatch) -> list:
        c = codec(path, pattern)
        lists = batch.column(0)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return [pa.array([c.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])], pa.binary())]

    return arrow_columns(df, [ids], [T.StructField(out, T.BinaryType())], run)


def round_trip(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids and the bytes they decode to, of every document: doc_id, ids, decoded. Other columns are dropped.

    `decode` of `encode` in one pass, so that a task keeps one Python worker.
    """

    def run(batch: pa.RecordBatch) -> list:
        c = codec(path, pattern)
        parts = c.encode_batch([t or "" for t in batch.column(0).to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        ids = list_array(np.concatenate(parts) if parts else np.empty(0, np.int32), offsets, pa.int32())
        return [ids, pa.array([c.decode(p) for p in parts], pa.binary())]

    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return arrow_columns(docs, ["text"], out, run).drop("text")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a `round_trip`."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
