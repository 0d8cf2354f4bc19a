"""Language-model scores of texts by a hidden Markov model over words.

Tokens are the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one end. The model has
STATES latent states with a start distribution, transitions, and an emission for every
token. A token that makes up SHARE of the training tokens is a class of its own, so there
are at most 1 / SHARE of them; rarer ones share the class of their shape (length, digits,
other signs), in which each has its share of the unigram model; a token not seen in training
keeps its unigram probability in every state. So the probabilities of all tokens add up to
one in each state, as in the unigram base (c + 0.5) / (N + 0.5 * (V + 1)), whose counts
cover every word of the corpus.

1. Texts are read once into blocks of about BLOCK tokens: numbers of the block's own words,
   one row a block. Only a block's distinct words are shuffled: to be counted, and to fetch
   their counts and classes. From then on a text is a sequence of classes.
2. A pass of Baum-Welch runs forward and backward over segments of SEGMENT tokens of the
   training texts (a segment that continues a text has a start distribution of its own).
   Each task sums expected counts over its blocks, and Spark sums them over tasks. The
   driver receives one row a class and sends the emissions back; both are bounded by SHARE.
3. Scores are exact likelihoods of whole texts. The scaled forward recursion over a segment
   is kept as a matrix from state to state, so segments of one long text are worked on side
   by side, and a text's matrices are multiplied in order.

The first pass has no model yet. It takes as a token's state the number of the last anchor
before it in the text, or else of the class before it, modulo the states; anchors are the
words that make up ANCHOR_FROM to ANCHOR_TO of all training tokens.

Null texts count as empty and have the end token alone; empty tables give an empty result,
and without training texts every token is unknown. Rows without a doc_id are training rows.
Repeated rows are rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from .common import discard, ship, staged

STATES = 8
PASSES = 2
#: Tokens of a block; a longer text makes a block of its own.
BLOCK = 1 << 22
SEGMENT = 64
#: Segments worked on at once, which bounds memory.
TOGETHER = 4096
#: Part of the training tokens from which a word has emissions of its own.
SHARE = 4e-6
#: Weight of the unigram model in each state's emissions, in tokens.
PRIOR = 50.0
#: Weight of a uniform distribution in starts and transitions, in tokens.
SMOOTH = 1.0
ANCHOR_FROM, ANCHOR_TO = 0.002, 0.02


def _words(text: str | None) -> list[bytes]:
    # bytes.lower() changes A-Z alone, and split() cuts at exactly \x20 and \x09-\x0D.
    return (text or "").encode("utf-8", "replace").lower().split()


_LISTS = {
    "doc_ids": T.LongType(), "train": T.BooleanType(), "sizes": T.LongType(), "words": T.StringType(), "counts": T.LongType(),
    "known": T.LongType(), "base": T.DoubleType(), "tied": T.DoubleType(),
}


def _schema(*names: str) -> T.StructType:
    kinds = {"block": T.LongType(), "ids": T.BinaryType(), "seq": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds[n] if n in kinds else T.ArrayType(_LISTS[n])) for n in names])


_ARROW = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}


def _pack(ids: np.ndarray, width: int) -> bytes:
    """Numbers as `width` planes of bytes; the upper planes are nearly empty and compress."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u4").ravel().astype(np.int64)


def _one_row(schema: T.StructType, values: dict) -> list[pa.Array]:
    out = []
    for field in schema:
        v = values[field.name]
        if isinstance(field.dataType, T.ArrayType):
            flat = pa.array(v, _ARROW[field.dataType.elementType])
            out.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        else:
            out.append(pa.array([v], pa.binary() if field.dataType == T.BinaryType() else pa.int64()))
    return out


def blocks(docs: DataFrame, train: Column, size: int = BLOCK) -> DataFrame:
    """One row a block of documents: doc_ids, train, sizes (tokens of each, with the end), ids
    (the tokens' places in `words`, packed), words, counts (of each word in training texts)."""
    ship(docs.sparkSession)
    schema = _schema("block", "doc_ids", "train", "sizes", "ids", "words", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        number = count()

        def close(rows) -> pa.RecordBatch:
            table, ids, who, trained = rows
            flat = np.concatenate(ids)
            counted = np.concatenate([x for x, t in zip(ids, trained) if t] or [np.empty(0, np.int32)])
            made = _one_row(schema, {
                "block": first + next(number), "doc_ids": who, "train": trained, "sizes": [len(x) for x in ids], "ids": _pack(flat, 4),
                "words": [w.decode() for w in table], "counts": np.bincount(counted, minlength=len(table)),
            })
            return pa.RecordBatch.from_arrays(made, names=schema.names)

        def fresh():
            table = defaultdict()
            table.default_factory = table.__len__
            table[b""]  # the end token is number 0
            return table, [], [], []

        rows, held = fresh(), 0
        for batch in batches:
            for doc_id, text, trained in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(text)
                made = np.zeros(len(words) + 1, np.int32)
                made[:-1] = np.fromiter(map(rows[0].__getitem__, words), np.int32, len(words))
                rows[1].append(made), rows[2].append(doc_id), rows[3].append(trained)
                held += len(made)
                if held >= size:
                    yield close(rows)
                    rows, held = fresh(), 0
        if held:
            yield close(rows)

    return docs.select("doc_id", "text", train.alias("train")).mapInArrow(run, schema)


def _shape(word: Column) -> Column:
    """Class of rare words: length up to 12, whether there are digits, and other signs."""
    return (
        F.least(F.char_length(word), F.lit(12)) * 4 + word.rlike("[0-9]").cast("int") * 2 + word.rlike("[^0-9a-z]").cast("int")
    )


SHAPES = 13 * 4


@dataclass
class Counts:
    """Words of the training texts (word, c, class), N, V, and each class's share of the base
    (0 for the last class, that of unknown words). The first SHAPES classes are shapes."""

    words: DataFrame
    tokens: int
    distinct: int
    mass: np.ndarray
    anchors: np.ndarray

    @property
    def whole(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def count_words(made: DataFrame, share: float = SHARE) -> Counts:
    pairs = made.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).where("x.counts > 0")
    words = staged(pairs.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("c")), "counts")
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    least = max(2, math.ceil(share * tokens))
    # At most 1 / share rows, in one task.
    often = words.where(F.col("c") >= least).withColumn("class", F.row_number().over(W.orderBy("word")) + (SHAPES - 1))
    often = staged(often, "classes")
    every = staged(words.join(often.select("word", "class"), "word", "left").withColumn("class", F.coalesce("class", _shape(F.col("word")))), "words")
    discard(words)
    rare = every.where(F.col("class") < SHAPES).groupBy("class").agg((F.sum("c") + F.lit(0.5) * F.count("c")).alias("m")).collect()
    own = often.orderBy("class").select("c").toArrow().column(0).to_numpy()
    mass = np.zeros(SHAPES + len(own) + 1)
    mass[[r["class"] for r in rare]] = [r.m for r in rare]
    mass[SHAPES:-1] = own + 0.5
    part = own / max(tokens, 1)
    anchors = SHAPES + np.flatnonzero((part >= ANCHOR_FROM) & (part <= ANCHOR_TO))
    return Counts(every, tokens, distinct, mass, anchors)


def coded(made: DataFrame, counts: Counts) -> DataFrame:
    """One row a block, its texts as sequences of classes: doc_ids, train, sizes, known
    (tokens), base (log10), tied (log10 of the rare words' shares of their classes), seq."""
    schema = _schema("block", "doc_ids", "train", "sizes", "known", "base", "tied", "seq")
    whole, classes = counts.whole, len(counts.mass)
    shapes = np.log10(np.maximum(counts.mass[:SHAPES], 0.5) / whole)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        sizes = np.array(row["sizes"], np.int64)
        lid, found = right.column("lid").to_numpy(), right.column("class").to_numpy()
        c = np.zeros(row["distinct"])
        c[lid] = right.column("c").to_numpy()
        place = np.full(row["distinct"], classes - 1)
        place[lid] = found
        log = np.log10((c + 0.5) / whole)
        share = np.zeros(len(c))
        tied = lid[found < SHAPES]
        share[tied] = log[tied] - shapes[place[tied]]
        ids = _unpack(row["ids"], int(sizes.sum()))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        total = lambda x: np.bincount(owner, x[ids], len(sizes))
        values = row | {
            "known": total((c > 0).astype(float)).astype(np.int64), "base": total(log), "tied": total(share),
            "seq": _pack(place[ids], 3 if classes > 1 << 16 else 2),
        }
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(_one_row(schema, values), names=schema.names)])

    # posexplode numbers the words as the ids do; a word no training text holds has no count.
    listed = made.select(F.col("block").alias("owner"), F.posexplode("words").alias("lid", "word"))
    found = listed.join(counts.words, "word").select("owner", "lid", "c", "class")
    bodies = made.select("block", "doc_ids", "train", "sizes", "ids", F.size("words").cast("long").alias("distinct"))
    return bodies.groupBy("block").cogroup(found.groupBy("owner")).applyInArrow(run, schema)


def sequence(row: dict) -> np.ndarray:
    """The classes of a block's tokens, as one flat array."""
    return _unpack(row["seq"], int(sum(row["sizes"])))


def segments(sizes: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in the flat array, tokens, text) of the segments of texts of `sizes` tokens."""
    parts = -(-sizes // length)
    text = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = (np.cumsum(sizes) - sizes)[text] + nth * length
    return start, np.minimum(length, sizes[text] - nth * length), text


def _padded(flat: np.ndarray, start: np.ndarray, n: np.ndarray, pad: int) -> np.ndarray:
    at = start[:, None] + np.arange(int(n.max()))
    inside = np.arange(at.shape[1]) < n[:, None]
    return np.where(inside, flat[np.minimum(at, len(flat) - 1)], pad)


@dataclass
class Model:
    """Starts, transitions, and the emissions: a row a class, a column a state."""

    start: np.ndarray
    go_on: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def make_model(counts: Counts, out: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> Model:
    """The model of expected counts (class x state), (state x state), (start or continuing x state)."""
    z = out.shape[1]
    even = lambda x: (x + SMOOTH) / (x + SMOOTH).sum(-1, keepdims=True)
    unknown = 0.5 / counts.whole
    known = max(counts.whole - 0.5, 0.5)
    emit = (1 - unknown) * (out + PRIOR * (counts.mass / known)[:, None]) / (out.sum(0) + PRIOR)
    emit[-1] = unknown
    return Model(even(starts[0]), even(starts[1]), even(moves).reshape(z, z), emit)


def expected(flat: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of the texts, as make_model() takes them."""
    classes, z = model.emit.shape
    emit = np.vstack([model.emit, np.ones((1, z))])
    out, moves, starts = np.zeros((classes + 1, z)), np.zeros((z, z)), np.zeros((2, z))
    start, n, text = segments(sizes)
    fresh = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.empty(0, bool)
    for at in range(0, len(start), TOGETHER):
        part = slice(at, at + TOGETHER)
        ids = np.ascontiguousarray(_padded(flat, start[part], n[part], classes).T)
        steps = len(ids)
        seen = emit[ids]
        ahead = np.empty_like(seen)
        scale = np.empty((*ids.shape, 1))
        a = np.where(fresh[part, None], model.start, model.go_on)
        for t in range(steps):
            a = (a if t == 0 else a @ model.move) * seen[t]
            scale[t] = a.sum(1, keepdims=True)
            a /= scale[t]
            ahead[t] = a
        b = np.ones((ids.shape[1], z))
        for t in range(steps - 1, 0, -1):
            c = seen[t] * b / scale[t]
            moves += model.move * (ahead[t - 1].T @ (c * (ids[t] != classes)[:, None]))
            ahead[t] *= b
            b = c @ model.move.T
        ahead[0] *= b
        for k, who in enumerate((fresh[part], ~fresh[part])):
            starts[k] += ahead[0][who].sum(0)
        for s in range(z):
            out[:, s] += np.bincount(ids.ravel(), ahead[:, :, s].ravel(), classes + 1)
    return out[:-1], moves, starts


def guessed(flat: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, classes: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the first pass, whose states follow the last anchor or the class before."""
    first = np.cumsum(sizes) - sizes
    begin = np.repeat(first, sizes)
    at = np.arange(len(flat))
    mark = np.zeros(classes, bool)
    mark[anchors] = True
    # The last anchor up to each place; the one before a token is that of the place before.
    last = np.maximum.accumulate(np.where(mark[flat], at, -1))
    last = np.concatenate([[-1], last[:-1]])
    before = np.where(last >= begin, last, np.maximum(at - 1, begin))
    state = np.where(at > begin, flat[before] % z, 0)
    out = np.bincount(flat * z + state, minlength=classes * z).reshape(-1, z).astype(float)
    pairs = (state[:-1] * z + state[1:])[(at > begin)[1:]]
    moves = np.bincount(pairs, minlength=z * z).reshape(z, z).astype(float)
    starts = np.vstack([np.bincount(state[first], minlength=z), np.bincount(state, minlength=z)]).astype(float)
    return out, moves, starts


def likelihoods(flat: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Natural logarithms of the texts' exact probabilities."""
    z = len(model.move)
    emit = np.vstack([model.emit, np.ones((1, z))])
    start, n, text = segments(sizes)
    whole = np.empty((len(start), z, z))
    logs = np.zeros(len(start))
    eye = np.eye(z)
    for at in range(0, len(start), TOGETHER):
        part = slice(at, at + TOGETHER)
        # Longest first, so that the segments still running are the first ones.
        order = np.argsort(-n[part], kind="stable")
        size = n[part][order]
        ids = _padded(flat, start[part][order], size, len(emit) - 1)
        m = np.broadcast_to(eye, (len(order), z, z)).copy()
        log = np.zeros(len(order))
        live = np.searchsorted(-size, -np.arange(ids.shape[1]), side="left")
        for t in range(ids.shape[1]):
            k = live[t]
            # A segment's first token is met after the step into it, which its predecessor takes.
            now = m[:k] if t == 0 else (m[:k].reshape(-1, z) @ model.move).reshape(-1, z, z)
            now = now * emit[ids[:k, t]][:, None, :]
            top = now.max((1, 2))
            m[:k] = now / top[:, None, None]
            log[:k] += np.log(top)
        whole[np.arange(len(start))[part][order]] = m
        logs[np.arange(len(start))[part][order]] = log
    out = np.bincount(text, logs, len(sizes))
    parts = np.bincount(text, minlength=len(sizes))
    first = np.cumsum(parts) - parts
    order = np.argsort(-parts, kind="stable")
    a = np.broadcast_to(model.start, (len(sizes), z)).copy()
    for s in range(int(parts.max(initial=0))):
        who = order[: np.searchsorted(-parts[order], -s, side="left")]
        now = a[who] if s == 0 else a[who] @ model.move
        now = np.einsum("ni,nij->nj", now, whole[first[who] + s])
        total = now.sum(1)
        out[who] += np.log(total)
        a[who] = now / total[:, None]
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _summed(bodies: DataFrame, classes: int, z: int, count) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all blocks of `count`, a function of a block's training texts.

    Each task adds up its blocks and gives a row for every class it met, and for every
    state and start after the classes; Spark adds up the tasks."""
    names = ["key", *[f"g{s}" for s in range(z)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes + z + 2, z))
        for row in _rows(batches):
            sizes, train = np.array(row["sizes"], np.int64), np.array(row["train"], bool)
            flat = sequence(row)[np.repeat(train, sizes)]
            if len(flat):
                out, moves, starts = count(flat, sizes[train])
                total[:classes] += out
                total[classes:] += np.vstack([moves, starts])
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(c) for c in total[some].T]], names=names)

    made = bodies.select("train", "sizes", "seq").mapInArrow(run, "key long, " + ", ".join(f"{n} double" for n in names[1:]))
    got = made.groupBy("key").agg(*[F.sum(n).alias(n) for n in names[1:]]).toArrow()
    total = np.zeros((classes + z + 2, z))
    total[got.column("key").to_numpy()] = np.column_stack([got.column(n).to_numpy() for n in names[1:]])
    return total[:classes], total[classes : classes + z], total[classes + z :]


def fit(bodies: DataFrame, counts: Counts, states: int = STATES, passes: int = PASSES) -> Model:
    """The model after one guessed pass and `passes` passes of Baum-Welch over `bodies`."""
    classes, z, anchors = len(counts.mass), states, counts.anchors
    model = make_model(counts, *_summed(bodies, classes, z, lambda f, s: guessed(f, s, anchors, classes, z)))
    for _ in range(passes):
        # Bounded by SHARE: at most 1 / SHARE classes beside the shapes.
        sent = bodies.sparkSession.sparkContext.broadcast(model)
        model = make_model(counts, *_summed(bodies, classes, z, lambda f, s, sent=sent: expected(f, s, sent.value)))
    return model


_SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def score(bodies: DataFrame, model: Model) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score (log10) of every text."""
    sent = bodies.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            logs = likelihoods(sequence(row), np.array(row["sizes"], np.int64), sent.value)
            # Rounding may lift a probability of one above it.
            logs = np.minimum(logs / np.log(10) + np.array(row["tied"]), 0.0)
            columns = [row["doc_ids"], row["train"], row["sizes"], row["known"], row["base"], logs]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_SCORES.names)

    return bodies.select("doc_ids", "train", "sizes", "known", "base", "tied", "seq").mapInArrow(run, _SCORES)


def language_scores(
    docs: DataFrame, train: Column, states: int = STATES, passes: int = PASSES, share: float = SHARE, size: int = BLOCK
) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, train, n_tokens, n_known, train_tokens, base_score, score."""
    made = staged(blocks(docs, train, size), "blocks")
    counts = count_words(made, share)
    bodies = staged(coded(made, counts), "coded")
    discard(made)
    model = fit(bodies, counts, states, passes)
    return score(bodies, model).withColumn("train_tokens", F.lit(counts.tokens).cast("long"))
