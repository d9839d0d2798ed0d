"""Queries of the training-data operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, line_dedup, media, packing, quality_rules, secret_scan, simhash, suffix_dedup, url_filter
from quillspark.llm.common import materialise, scratch_path


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; files are read by executors, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text, through a new ledger."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in secret_scan.BASE]))
    return found.select(
        "doc_id",
        *(secret_scan.count(spans, r.kind).alias(f"n_{r.kind}") for r in secret_scan.BASE),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"),
    )


def _spans_sql(kind: str, place: int, pattern: str, least: int, group: int = 0) -> str:
    """DuckDB: the spans of one kind, by the lengths of what lies between matches."""
    p = pattern.replace("'", "''")
    return f"""
      SELECT blob, '{kind}' AS kind, {place} AS place, f.start AS start, f.start + f.size AS stop FROM (
        SELECT blob, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
          'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0),
          'size': length(hits[i]), 'good': length(regexp_extract(hits[i], '{p}', {group})) >= {least}}})) AS f
        FROM (SELECT blob, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM blobs))
      WHERE f.good"""


OP1_SQL = f"""
WITH held AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob FROM documents),
blobs AS (SELECT blob, any_value(text) AS text FROM held GROUP BY blob),
spans AS ({" UNION ALL ".join(_spans_sql(r.kind, k, r.pattern, r.least, r.group) for k, r in enumerate(secret_scan.RULES))}),
per_blob AS (
  SELECT blob, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place) AS spans,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place) FILTER (place < 3) AS base
  FROM spans GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM held LEFT JOIN per_blob USING (blob)
"""


def secret_ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of every text, through one ledger that three runs share: English texts, then all, then all again, which scans nothing."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    ledger = scratch_path(spark, "secret-ledger")
    secret_scan.scan_new_blobs(docs.where("lang = 'en'"), ledger)
    secret_scan.scan_new_blobs(docs, ledger)
    found = secret_scan.scan(docs, ledger=ledger)
    return found.select("doc_id", secret_scan.joined(F.col("spans")).alias("spans"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a container of 8-bit frames, read back and described."""
    seen = media.describe(media.store(_table(spark, sf_dir, "documents")))
    first, last = F.col("key_frames")[0], F.element_at("key_frames", -1)
    feature = F.format_string(
        "%s|%s|ms=%d|samples=%d|keys=%d|first=%d+%d|last=%d+%d", "codec", "handler", "duration_ms", "samples",
        F.size("key_frames"), first["offset"], first["length"], last["offset"], last["length"],
    )
    return seen.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; the list is learned from ``labels``."""
    stats = materialise(quality_rules.statistics(_table(spark, sf_dir, "documents")), "stats")
    rules = quality_rules.fit(stats, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines equal or nearly equal an earlier one, links of its lines, and which lines go."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = line_dedup.removed_lines(docs).withColumnRenamed("doc_id", "of_doc")
    none = F.lit(0).cast("long")
    # Lines are counted before the join, so that it moves no text.
    counted = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    return counted.join(gone, F.col("doc_id") == F.col("of_doc"), "left").select(
        "doc_id",
        "n_lines",
        *(F.coalesce(c, none).alias(c) for c in ("n_equal", "n_near", "n_links")),
        F.coalesce(F.array_join(F.transform("removed", lambda n: n.cast("string")), ","), F.lit("")).alias("removed"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without strings of 100 bytes that start earlier in the corpus."""
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")).select(
        "page_id", "host", "path", "rule", "verdict", "mined"
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def transcripts(turns: DataFrame) -> DataFrame:
    """Turns as a raw transcript has them: two in three start with some spelling of their speaker, the others bare."""
    pick = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6))
    shown = F.when(F.col("role") == "user", F.element_at(F.array(F.lit("Human: "), F.lit("USER> ")), (pick % 2 + 1).cast("int")))
    shown = shown.when(F.col("role") == "assistant", F.element_at(F.array(F.lit("AI: "), F.lit("**Assistant:** ")), (pick % 2 + 1).cast("int")))
    shown = shown.when(F.col("role") == "system", F.lit("System: "))
    text = F.concat(F.when(pick < 4, F.coalesce(shown, F.lit(""))).otherwise(F.lit("")), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", "role", text.alias("text"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered role and canonical rendering of every turn; all turns of a known role teach the model."""
    found = chat.format_turns(transcripts(_table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", "role", F.sha2("rendered", 256).alias("rendered_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secret_scan, op2_media_columns, op3_quality_rules, op4_line_dedup, op5_packing, op6_suffix_dedup, op7_url_filter, op8_bpe, op9_chat_format, op10_simhash,
    )
    return {f.__name__: f for f in (*found, secret_ledger_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": OP1_SQL, "secret_ledger_runs": f"SELECT doc_id, spans FROM ({OP1_SQL})"}
