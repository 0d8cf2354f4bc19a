"""Periodic runs of words: a sparse dynamic program over diagonals of equal lag.

Words are the matches of [^\\x20\\x09-\\x0D]+. A run is a stretch of words with smallest period
q and at least max(6, 4q) words that no neighbouring word extends keeping that period. On
the diagonal of lag q a run is a stretch of at least max(6 - q, 3q) equal pairs (word i,
word i - q), and every diagonal that ends with so many gives a run of that lag or, with the
same bounds, of a divisor of it.

Each word's earlier occurrences start and lengthen diagonals. Taken alone, a word that
fills a text would start as many diagonals as it occurs, so an occurrence counts with the
words before it: g words, the last g up to the word. A run of period q holds g words that
occur q earlier whenever g <= max(6 - q, 3q); and if g >= 2q - 1 their latest earlier
occurrence is q words back, since one nearer by would make the period smaller (two periods
p < q of p + q - 1 words at least have their common divisor as a period). Lengths g in
steps of 1.5 serve every q, so there is one earlier occurrence to look up for a word and
each of about log(n) lengths. An active diagonal takes in the words that follow, match by
match; it is emitted as soon as it ends with enough of them.

Words and stretches of g words are compared by 64-bit hashes, mixed anew for every text, in
numpy over a block of texts; the diagonals are walked on the hashes of the words.

Null, empty and blank texts have no words and no run. Repeated rows are rows. All columns
of the input pass; columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import arrow_columns
from .words import mix

#: Words of a block of texts; a longer text makes a block of its own.
BLOCK_WORDS = 1 << 18
_MULT = np.uint64(0xD6E8FEB86659FD93)


def least_matches(lag: int) -> int:
    """Equal pairs on a diagonal that make a run."""
    return max(6 - lag, 3 * lag)


def levels(longest: int) -> list[tuple[int, int, int]]:
    """(g, least lag, greatest lag) so that every lag of a run in `longest` words has a g with
    2 * lag - 1 <= g <= least_matches(lag)."""
    out, low = [], 1
    while max(6, 4 * low) <= longest:
        g = least_matches(low)
        high = (g + 1) // 2
        out.append((g, low, min(high, longest // 4)))
        low = high + 1
    return out


def _earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs before, and the latest such place."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = max(10, int(len(keys)).bit_length() + 2)
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    # Most keys are alone in their slot of a table four times as large; only the rest is sorted.
    some = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    order = some[np.argsort(keys[some], kind="stable")]
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    return order[same + 1], order[same]


def seeds(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag): the g words up to `place` have their latest earlier occurrence `lag` back.

    `words` are the mixed hashes of a block of texts, `longest` words the longest of them."""
    places, lags = [], []
    power, width = words, 1
    for g, low, high in levels(longest):
        while 2 * width <= g:
            wider = power.copy()
            wider[width:] = mix(power[width:] * _MULT + power[:-width])
            power, width = wider, 2 * width
        # Two stretches of `width` words cover the g words; the first g - 1 places have none.
        keys = mix(power[g - 1 :] * _MULT + power[width - 1 : len(power) - (g - width)] + np.uint64(g))
        at, before = _earlier(keys)
        lag = at - before
        good = (lag >= low) & (lag <= high)
        places.append(at[good] + g - 1)
        lags.append(lag[good])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place, lag = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((lag, place))
    return place[order], lag[order]


def _until(differs: np.ndarray) -> int:
    at = int(differs.argmax())
    return at if differs[at] else len(differs)


def _ahead(words: np.ndarray, i: int, lag: int, end: int) -> int:
    """First place from i on, up to `end`, whose word is not the one `lag` before."""
    step = 32
    while i < end:
        stop = min(end, i + step)
        n = _until(words[i:stop] != words[i - lag : stop - lag])
        i += n
        if i < stop:
            break
        step *= 2
    return i


def _behind(words: np.ndarray, i: int, lag: int, start: int) -> int:
    """Least place down to `start` from which on all words up to i match."""
    step = 32
    while i > start:
        stop = max(start, i - step)
        n = _until((words[stop:i] != words[stop - lag : i - lag])[::-1])
        i -= n
        if i > stop:
            break
        step *= 2
    return i


def runs_of(words: np.ndarray, place: np.ndarray, lag: np.ndarray, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of the text words[start:end], by start, then period."""
    active: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    for i, d in zip(place.tolist(), lag.tolist()):
        if active.get(d, -1) > i:
            continue
        first = _behind(words, i, d, start + d)
        last = _ahead(words, i, d, end)
        active[d] = last
        if last - first >= least_matches(d):
            key = (first - d - start, last - first + d)
            found[key] = min(d, found.get(key, d))
    return sorted(((s, n, d) for (s, n), d in found.items()), key=lambda r: (r[0], r[2]))


def runs(blocks: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given its words' 64-bit hashes."""
    sizes = [len(b) for b in blocks]
    ends = np.cumsum(sizes)
    words = np.concatenate(blocks) if blocks else np.empty(0, np.uint64)
    # Texts get hashes of their own, so no stretch of words is found in another text.
    owner = np.repeat(np.arange(len(blocks), dtype=np.uint64), sizes)
    place, lag = seeds(mix(words ^ mix(owner * _MULT + np.uint64(1))), max(sizes, default=0))
    cuts = np.searchsorted(place, np.concatenate([[0], ends])) if len(sizes) else []
    return [
        runs_of(words, place[cuts[k] : cuts[k + 1]], lag[cuts[k] : cuts[k + 1]], int(ends[k]) - n, int(ends[k])) if cuts[k] < cuts[k + 1] else []
        for k, n in enumerate(sizes)
    ]


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: no run holds it after the run's first period."""
    drop = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return np.cumsum(drop[:n]) == 0


def best(found: list[tuple[int, int, int]]) -> tuple | None:
    """start, length, period, floor(1000 * length / period) of the run with the greatest
    exact exponent; ties go to the smallest start, then period."""
    top = None
    for s, n, p in found:
        if top is None or n * top[2] > top[1] * p:
            top = (s, n, p)
    return None if top is None else (*top, 1000 * top[1] // top[2])


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word of each place for a document that gets a periodic end, else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def split(text: str | None) -> list[bytes]:
    # Without an argument, bytes split at exactly \x20 and \x09-\x0D.
    return (text or "").encode("utf-8", "replace").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def _blocks(texts: Iterator, prepare) -> Iterator[list[tuple[list[bytes], np.ndarray]]]:
    """Words and their hashes of each text, in blocks of about BLOCK_WORDS words."""
    block, size = [], 0
    for row in texts:
        words = prepare(row)
        block.append((words, _hashes(words)))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `n_words` and `runs` (array of start, length, period, in that order)."""

    def run(batch: pa.RecordBatch) -> list:
        sizes, offsets, rows = [], [0], []
        for block in _blocks(batch.column(0).to_pylist(), split):
            for (words, _), found in zip(block, runs([h for _, h in block])):
                sizes.append(len(words))
                rows += found
                offsets.append(len(rows))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
        made = pa.StructArray.from_arrays(columns, fields=[pa.field(n, pa.int64()) for n in RUN.names])
        return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)]

    return arrow_columns(docs, [text], [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN))], run)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `collapsed`: the words that detect()'s `runs` keep, joined by one space;
    null for a null text."""

    def run(batch: pa.RecordBatch) -> list:
        out = []
        for t, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = split(t)
            keep = kept_words(len(words), [(r["start"], r["length"], r["period"]) for r in found or []])
            out.append(None if t is None else b" ".join(w for w, k in zip(words, keep) if k).decode())
        return [pa.array(out, pa.string())]

    return arrow_columns(docs, [text, "runs"], [T.StructField("collapsed", T.StringType())], run)


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent (start, length, period,
    exponent_milli; null without runs), and digests of all runs and of the collapsed text.

    With `plant`, texts first get the periodic ends that planted() names."""

    def run(batch: pa.RecordBatch) -> list:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()

        def prepare(row):
            words = split(row[1])
            source = planted(row[0], len(words)) if plant else None
            return words if source is None else [words[i] for i in source.tolist()]

        counts, tops, listed, joined = [], [], [], []
        for block in _blocks(zip(ids, texts), prepare):
            for (words, _), found in zip(block, runs([h for _, h in block])):
                counts.append(len(found))
                tops.append(best(found) or (None,) * 4)
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                listed.append(hashlib.sha256(lines.encode()).hexdigest())
                if found:
                    words = [w for w, k in zip(words, kept_words(len(words), found)) if k]
                joined.append(hashlib.sha256(b" ".join(words)).hexdigest())
        top = list(zip(*tops)) or [[]] * 4
        return [pa.array(counts, pa.int64()), *[pa.array(c, pa.int64()) for c in top], pa.array(listed, pa.string()), pa.array(joined, pa.string())]

    out = _long("n_runs", "start", "length", "period", "exponent_milli")
    out += [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]
    picked = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text"))
    return arrow_columns(picked, ["doc_id", "__text"], out, run).drop("__text")
