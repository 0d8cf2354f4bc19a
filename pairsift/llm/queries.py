"""Registered queries: the operators on the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontam, embedjoin, hmm, htmlcut, langid, lines, merkle, minhash, periodic, quality, tokenfile, turns
from .common import held_out, stage_path, staged

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY_FILE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return bpe.digests(bpe.round_trip(docs, BPE_RANKS, public_tokenizers.PATTERN))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = stage_path(spark, "tokens")
    tokenfile.write(_table(spark, folder, "documents"), path, LIBRARY_FILE, end_id=2)
    return tokenfile.checksums(spark, path)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    stats = staged(quality.add_statistics(docs).drop("text"), "statistics")
    model = quality.fit(stats.where(~held_out()).join(labels, "doc_id"))
    return quality.score(stats, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmlcut.extract(_table(spark, folder, "pages"))


def op4_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of a replica whose bytes changed: by md5 of the page_id, 3 of 256 pages each have
    their first byte replaced, lose their last two bytes, or are emptied. `start` counts from
    the first record of the first archive file."""
    first = merkle.archive(_table(spark, folder, "pages"))
    kind = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    text = F.col("record")
    harmed = (
        F.when(kind.isin("00", "01", "02"), F.concat(F.lit("X"), F.substring(text, 2, 2**31 - 1)))
        .when(kind.isin("03", "04", "05"), F.expr("substring(record, 1, char_length(record) - 2)"))
        .when(kind.isin("06", "07", "08"), F.lit(""))
        .otherwise(text)
    )
    second = first.withColumn("record", harmed)
    found = merkle.audit(first, second).where("status != 'moved'").join(merkle.file_starts(first), "file")
    return found.select("page_id", "status", (F.col("start") + F.col("base")).alias("start"), "length", "hash_a", "hash_b")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), k=2, percent=80)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    clean = lines.deduplicate(docs, removed="n_removed")
    return clean.select("doc_id", "text", "n_removed")


def op10_embedding_join(spark: SparkSession, folder: str) -> DataFrame:
    return embedjoin.range_join(_table(spark, folder, "embeddings"), 0.9)


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turns.structure(turns.damaged(_table(spark, folder, "conversations")), present="present")


def op12_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    found = hmm.language_scores(_table(spark, folder, "documents").select("doc_id", "text"), ~held)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.report(_table(spark, folder, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_byte_bpe, op2_token_files, op3_language_id, op4_warc_fixity, op5_decontamination, op6_quality, op7_html_main_text, op8_minhash,
        op9_line_dedup, op10_embedding_join, op11_conversation_repair, op12_hidden_markov, op13_periodic_runs,
    )
}
ORACLE_SQL: dict[str, str] = {
    # All pairs of line sets that share one of their rarest fifth of tokens, rare by (count, token).
    "op9_line_dedup": """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM documents),
words AS (
  SELECT DISTINCT doc_id, l, unnest(string_split_regex(lower(line), '[\\x20\\x09-\\x0D]+')) AS w FROM lines),
toks AS (SELECT * FROM words WHERE w <> ''),
sets AS (SELECT doc_id, l, list(w ORDER BY w) AS ws, count(*) AS n FROM toks GROUP BY doc_id, l),
classes AS MATERIALIZED (SELECT ws, n, min({'d': doc_id, 'l': l}) AS place FROM sets GROUP BY ws, n),
spread AS (SELECT place, n, unnest(ws) AS w FROM classes),
freq AS (SELECT w, count(*) AS c FROM spread GROUP BY w),
prefix AS MATERIALIZED (
  SELECT place, n, w FROM spread JOIN freq USING (w)
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY c, w) <= n // 5 + 1),
pairs AS (
  SELECT DISTINCT a.place AS pa, b.place AS pb FROM prefix a JOIN prefix b ON a.w = b.w AND a.place < b.place
  WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
gone AS (
  SELECT DISTINCT pb AS place FROM pairs JOIN classes a ON a.place = pa JOIN classes b ON b.place = pb
  WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
kept AS (
  SELECT lines.doc_id, lines.l, lines.line FROM lines LEFT JOIN sets s ON s.doc_id = lines.doc_id AND s.l = lines.l
  LEFT JOIN classes c ON c.ws = s.ws LEFT JOIN gone g ON g.place = c.place
  WHERE s.n IS NULL OR (g.place IS NULL AND c.place = {'d': s.doc_id, 'l': s.l})),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY l) AS text, count(*) AS m FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(j.m, 0) END AS BIGINT) AS n_removed
FROM documents d LEFT JOIN joined j ON j.doc_id = d.doc_id
""",
    "op4_warc_fixity": """
WITH made AS (
  SELECT page_id, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS kind,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
placed AS (
  SELECT *, CAST(strlen(record) AS BIGINT) AS length,
    CAST(sum(strlen(record)) OVER (ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - strlen(record) AS start,
    CASE WHEN kind IN ('00', '01', '02') THEN 'X' || substr(record, 2)
         WHEN kind IN ('03', '04', '05') THEN substr(record, 1, length(record) - 2)
         WHEN kind IN ('06', '07', '08') THEN '' ELSE record END AS other
  FROM made)
SELECT page_id, 'changed' AS status, CAST(start AS BIGINT) AS start, length, sha256(record) AS hash_a, sha256(other) AS hash_b
FROM placed WHERE record <> other
""",
}
