"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of up to ORDER bytes, with the counts of the bytes that
followed each context in the training texts. The code length of a byte under frozen counts
is taken from the longest context seen: -log2 n / (total + distinct), and each shorter
context costs an escape of distinct / (total + distinct). Below the empty context every
byte costs 8 bits. A text's score is its exact code length, summed over all its bytes, in
every language; the shortest wins, and ties go to the smaller name.

Since the counts are frozen, a byte's code length depends on the longest known context
only. Contexts are numbered over all languages, a table leads from the last three bytes to
their longest known context, and a second one holds the code lengths.

The trees are fitted on a bounded sample of labelled rows: SAMPLE documents a language in
expectation, drawn by hash, for the LANGUAGES most frequent languages, with at most NODES
contexts. Scoring reads whole texts. Null texts and texts without a letter are "und" with
score 0; an empty training table makes every text "und".
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_columns, ship, staged

ORDER = 3
SAMPLE = 400
LANGUAGES = 64
#: Contexts kept over all languages, the most frequent first.
NODES = 16_000


def _grams(text: bytes) -> np.ndarray:
    """The bytes before and at each place as one number of four bytes."""
    b = np.frombuffer(b"\n" * ORDER + text, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def _fold(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def sample(docs: DataFrame, bound: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """Rows (text, lang) to learn from, about `bound` a language; `docs` has doc_id, text, lang."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return known.select("text", "lang")
    span = 1 << 31
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(span, bound * span // r["count"]))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(span)) < share[F.col("lang")]
    return known.where(drawn).select("text", "lang")


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram (four bytes), n over the texts of `labelled`; combined in each task first."""
    ship(labelled.sparkSession)

    def run(batches):
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(_grams(_fold(text)))
            for lang, parts in by.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"]
                )

    return labelled.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """Context trees of all languages, ready to score."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], nodes: int = NODES):
        self.languages = sorted(counts)
        grams = {k: (counts[k][0].astype(np.int64), counts[k][1].astype(np.float64)) for k in self.languages}
        # Contexts by length; the empty one is node 0.
        number = [{0: 0}]
        total = 1
        for length in range(1, ORDER + 1):
            keys, sums = [], []
            for gram, n in grams.values():
                key, at = np.unique(gram >> 8 & (1 << 8 * length) - 1, return_inverse=True)
                keys.append(key), sums.append(np.bincount(at, n))
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            seen = np.bincount(at, np.concatenate(sums))
            best = np.argsort(-seen, kind="stable")[: max(0, nodes - total)]
            number.append({int(k): total + i for i, k in enumerate(key[np.sort(best)])})
            total += len(best)
        self.table = np.zeros((256, 256, 256), np.uint16 if total < 1 << 16 else np.int32)
        for k, node in number[1].items():
            self.table[:, :, k] = node
        for k, node in number[2].items():
            self.table[:, k >> 8, k & 255] = node
        for k, node in number[3].items():
            self.table[k >> 16, k >> 8 & 255, k & 255] = node
        self.table = self.table.reshape(-1)

        self.bits = np.full((total, 256, len(self.languages)), 8.0, np.float32)
        for column, (gram, n) in enumerate(grams.values()):
            for length in range(ORDER + 1):
                key = gram & (1 << 8 * (length + 1)) - 1
                pair, at = np.unique(key, return_inverse=True)
                times = np.bincount(at, n)
                context, first = np.unique(pair >> 8, return_inverse=True)
                sums, kinds = np.bincount(first, times), np.bincount(first)
                escape = -np.log2(kinds / (sums + kinds))
                nodes_of = np.array([number[length].get(int(c), -1) for c in context])
                parent = np.array([number[length - 1].get(int(c) & (1 << 8 * (length - 1)) - 1, -1) if length else -1 for c in context])
                for c in np.flatnonzero(nodes_of >= 0):
                    below = self.bits[parent[c], :, column] if length else np.float32(8.0)
                    self.bits[nodes_of[c], :, column] = below + escape[c]
                here = nodes_of[first]
                own = -np.log2(times / (sums + kinds)[first])
                good = here >= 0
                self.bits[here[good], (pair & 255)[good], column] = own[good]
                # A context that this language hasn't seen predicts as its shorter one does.
                unseen = set(number[length].items()) - {(int(c), int(i)) for c, i in zip(context, nodes_of)} if length else set()
                for c, node in unseen:
                    self.bits[node, :, column] = self.bits[number[length - 1][c & (1 << 8 * (length - 1)) - 1], :, column]
        self.bits = self.bits.reshape(total * 256, len(self.languages))

    def lengths(self, text: str) -> np.ndarray:
        """Code length in bits of the whole text, per language; blocks bound the memory."""
        data = _fold(text)
        out = np.zeros(len(self.languages))
        for i in range(0, len(data), 1 << 16):
            back = data[max(0, i - ORDER) : i].rjust(ORDER, b"\n")
            grams = _grams(back + data[i : i + (1 << 16)])[ORDER:]
            at = self.table[grams >> 8].astype(np.int64) << 8 | (grams & 255)
            out += self.bits.take(at, axis=0).sum(axis=0, dtype=np.float64)
        return out


_trees: dict[str, Trees] = {}


def _from(model: dict) -> Trees:
    """Each worker builds the tables of a model once."""
    if model["name"] not in _trees:
        _trees.clear()
        _trees[model["name"]] = Trees(model["counts"])
    return _trees[model["name"]]


def fit(docs: DataFrame, bound: int = SAMPLE, languages: int = LANGUAGES) -> dict:
    """Counts of a bounded sample of labelled rows (doc_id, text, lang), as a small model."""
    table = gram_counts(sample(docs, bound, languages)).toArrow()
    lang = np.array(table.column("lang").to_pylist(), object)
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    counts = {}
    for k in sorted(set(lang.tolist())):
        mine = lang == k
        order = np.argsort(gram[mine])
        counts[k] = (gram[mine][order].astype(np.uint32), n[mine][order].astype(np.uint32))
    return {"name": f"{hash(tuple((k, len(v[0]), int(v[1].sum())) for k, v in counts.items()))}", "counts": counts}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add lang_pred, score (share of the winner's likelihood) and bits (a byte, of the winner)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        names, scores, bits = [], [], []
        counts = shared.value["counts"]
        for t in batch.column(0).to_pylist():
            if not t or not counts or not any(map(str.isalpha, t)):
                names.append("und"), scores.append(0.0), bits.append(None)
                continue
            trees = _from(shared.value)
            lengths = trees.lengths(t)
            best = int(lengths.argmin())
            odds = np.exp2(-np.minimum(lengths - lengths[best], 1000.0))
            names.append(trees.languages[best]), scores.append(float(1 / odds.sum()))
            bits.append(float(lengths[best] / len(_fold(t))))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]

    out = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    return arrow_columns(docs, [text], out, run)


def keep_language(docs: DataFrame, model: dict, most_bits: float = 8.0, text: str = "text") -> DataFrame:
    """`docs`, all columns, without rejected rows: those "und", and those whose best language
    needs `most_bits` a byte or more, so that no model does better than none."""
    named = predict(docs.withColumn("__text", F.col(text)).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], "__text"), model, "__text")
    good = named.where((F.col("lang_pred") != "und") & (F.col("bits") < most_bits))
    return good.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
