"""Batch counters and summaries, completion rates, queue totals and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds without activity that end a batch; completions, gaps and their limits of a rate.
IDLE_AFTER_S, RATE_ROWS, RATE_GAPS, MAX_GAP_S = 300, 21, 5, 900


def counters() -> list[Column]:
    """Filtered counts of a batch's rows: one pass, whatever their number."""
    def where(name: str, condition: str) -> Column:
        return F.count_if(F.expr(f"coalesce({condition}, false)")).alias(name)

    return [
        F.count("*").alias("rows"),
        where("uploaded", "parent_document_id IS NULL"),
        where("pages", "parent_document_id IS NOT NULL"),
        where("queued", "status IN ('VALIDATING', 'SCANNING', 'CLEAN')"),
        where("processing", "status = 'PROCESSING'"),
        where("succeeded", "status = 'SUCCEEDED'"),
        where("needs_review", "status = 'NEEDS_REVIEW'"),
        where("failed", "status IN ('FAILED', 'QUARANTINED')"),
        F.max("processed_at").alias("last_completed_at"),
        F.max("created_at").alias("last_created_at"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages_expected"),
    ]


def files_done(rows: DataFrame, batch: str, file: str, is_open: Column) -> DataFrame:
    """Per batch, its files none of whose rows is open."""
    per_file = rows.groupBy(batch, file).agg(F.bool_or(is_open).alias("open"))
    return per_file.groupBy(batch).agg(F.count_if(~F.col("open")).alias("files_done"))


def summary(counted: DataFrame, now: Column) -> DataFrame:
    """Derived columns of counted batches (``counters`` beside expected_total, created_at and splitting_counted)."""
    done = F.col("succeeded") + F.col("needs_review") + F.col("failed")
    zero = F.lit(0)
    quiet = (F.col("queued") + F.col("processing") == 0) & F.col("last_completed_at").isNotNull()
    seconds = lambda a, b: (a.cast("double") - b.cast("double"))
    idle = (F.col("uploaded") > 0) & quiet & (seconds(now, F.greatest("last_completed_at", "last_created_at")) >= IDLE_AFTER_S)
    expected = (
        F.col("rows") - F.col("splitting_counted") + F.greatest(zero, F.col("pages_expected") - F.col("pages"))
        + F.greatest(zero, F.col("expected_total") - F.col("uploaded"))
    )
    out = counted.withColumns({"completed": done, "rows_expected": expected, "finished": (F.col("uploaded") >= F.col("expected_total")) & quiet})
    ends = F.when(F.col("finished") | idle, F.col("last_completed_at")).otherwise(now)
    out = out.withColumn("duration_s", F.when(F.col("uploaded") > 0, F.greatest(F.lit(0.0), seconds(ends, F.col("created_at")))))
    rate = F.floor(F.col("completed") / (F.col("duration_s") / 60) * 100 + 0.5) / 100
    return out.withColumn("per_minute", F.when((F.col("completed") > 0) & (F.col("duration_s") > 0), rate))


def completion_rate(done: DataFrame, key: str, at: str) -> DataFrame:
    """Seconds a row per key: median gap of the last 21 completions, long gaps dropped, null for under five gaps."""
    recent = Window.partitionBy(key).orderBy(F.desc(at))
    last = done.withColumn("_k", F.row_number().over(recent)).where(F.col("_k") <= RATE_ROWS)
    gap = F.col(at).cast("double") - F.lag(at).over(Window.partitionBy(key).orderBy(at)).cast("double")
    gaps = last.withColumn("_gap", gap).where(F.col("_gap") <= MAX_GAP_S)
    typical = F.floor(F.median("_gap") * 10 + 0.5) / 10
    return gaps.groupBy(key).agg(F.when(F.count("*") >= RATE_GAPS, typical).alias("seconds_each"))


def queue_totals(batches: DataFrame, seconds_each: Column, cap_left: Column) -> DataFrame:
    """Remaining rows of batches that aren't held, and the estimates for all of them and for the open round."""
    left = F.when(F.col("held"), 0).otherwise(F.greatest(F.lit(0), F.col("rows_expected") - F.col("completed")))
    total = batches.agg(F.sum(left).alias("remaining"))
    return total.select("remaining", (F.col("remaining") * seconds_each).alias("eta_s"), (F.least("remaining", cap_left) * seconds_each).alias("round_eta_s"))


def ranked_percentile(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Values at index ``floor(n * share)`` of each key's sorted values: no interpolation."""
    w = Window.partitionBy(key)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"_k": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count("*").over(w)})
    at = lambda s: F.max(F.when(F.col("_k") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * s)), F.col(value)))
    return ranked.groupBy(key).agg(*(at(s).alias(name) for name, s in shares.items()))
