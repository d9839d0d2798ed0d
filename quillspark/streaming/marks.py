"""Structured Streaming twins of event-log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.events import export_state


def latest_marks(marks: DataFrame) -> DataFrame:
    """Export state by document of a stream of marks, in update mode: state is one row a document."""
    return marks.groupBy("document_id").agg(F.max_by("kind", "seq").alias("kind")).withColumn("export_state", export_state(F.col("kind")))


def alert_counts(events: DataFrame, at: str, width: str, slide: str, late: str, key: str) -> DataFrame:
    """Events a key in sliding windows; a wall clock without zone is taken as UTC, as watermarks need instants."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.window(at, width, slide), key).agg(F.count("*").alias("n"))


def first_results(requests: DataFrame, at: str, key: str, late: str) -> DataFrame:
    """The first request of each idempotency key; a key is forgotten once the watermark passes it."""
    return requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])
