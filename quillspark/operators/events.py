"""State from append-only event logs: latest event, export state, delivery, upserts, marks.

A key's latest event comes from one aggregation with map-side combine (``max_by``), never from a sort of the
key's whole history, so a key with a third of all events costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """``key`` and the ``columns`` of its event with the largest ``seq``."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("_e")).select(key, *(F.col(f"_e.{c}").alias(c) for c in columns))


def export_state(kind: Column) -> Column:
    return F.when(kind.isNull() | (kind == "unmarked"), "never").otherwise("exported")


def with_export_state(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``export_state`` and ``changed_after_export`` (strictly later, to the microsecond) for docs with id and updated_at."""
    last = latest(marks, "document_id", "seq", ["kind", "document_updated_at"]).select(
        F.col("document_id").alias("_doc"), F.col("kind").alias("_kind"), F.col("document_updated_at").alias("_seen")
    )
    joined = docs.join(last, F.col("id") == F.col("_doc"), "left")
    changed = F.coalesce((F.col("_kind") != "unmarked") & (F.col("updated_at") > F.col("_seen")), F.lit(False))
    return joined.withColumn("export_state", export_state(F.col("_kind"))).withColumn("changed_after_export", changed).drop("_doc", "_kind", "_seen")


def mark(docs: DataFrame, kind: str, seq_after: int = 0) -> tuple[DataFrame, DataFrame]:
    """The events that marking ``docs`` (with its export state) appends, and total, affected and skipped.

    Marking skips what is exported and unchanged; unmarking skips what isn't exported.
    """
    exported = F.col("export_state") == "exported"
    needed = exported if kind == "unmarked" else ~(exported & ~F.col("changed_after_export"))
    counts = docs.agg(F.count("*").alias("total"), F.count_if(needed).alias("affected"), F.count_if(~needed).alias("skipped"))
    events = docs.where(needed).select(F.col("id").alias("document_id"), F.lit(kind).alias("kind"), F.col("updated_at").alias("document_updated_at"))
    return events, counts


def delivery(corrections: DataFrame, outbox: DataFrame) -> DataFrame:
    """``document_id`` and ``delivery`` by the latest correction of each field: FAILED, RETRYING, PENDING, DELIVERED, else NONE."""
    sent = outbox.select(F.col("correction_id").alias("_c"), F.col("status").alias("_status"))
    joined = corrections.join(sent, F.col("id") == F.col("_c"), "left")
    per_field = joined.groupBy("document_id", "field").agg(
        F.max_by(F.struct("_status"), F.struct("verified_at", F.col("_c").isNotNull(), -F.col("id"))).alias("s")
    )
    status = F.col("s._status")
    ladder = (
        F.when(F.count(status) == 0, "NONE")
        .when(F.bool_or(status.isin("DEAD", "FAILED")), "FAILED")
        .when(F.bool_or(status == "RETRY"), "RETRYING")
        .when(F.bool_or(status.isin("PENDING", "PROCESSING")), "PENDING")
        .otherwise("DELIVERED")
    )
    return per_field.groupBy("document_id").agg(ladder.alias("delivery"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], seq: str, keep_old: bool = False) -> DataFrame:
    """``table`` with ``changes`` (same columns and ``seq``) merged by key: the last change wins, or none does over an old row."""
    columns = [c for c in table.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), seq).alias("_new")).select(*keys, *(F.col(f"_new.{c}") for c in columns))
    if keep_old:
        return table.unionByName(last.join(table.select(*keys), keys, "left_anti"))
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last)


def numbered(df: DataFrame, tenant: str, order: list[Column], base: str, name: str = "queue_seq") -> DataFrame:
    """Number rows after the largest number that their tenant has; a tenant's numbers are one sequence by definition."""
    after = df.groupBy(tenant).agg(F.coalesce(F.max(base), F.lit(0)).alias("_base"))
    fresh = df.where(F.col(base).isNull()).withColumn("_n", F.row_number().over(Window.partitionBy(tenant).orderBy(*order)))
    given = fresh.join(after, tenant).withColumn(name, F.col("_base") + F.col("_n")).drop("_n", "_base")
    return given


def aligned_lookup(wanted: DataFrame, names: str, found: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of ``found`` for each element of the array ``names``, by its place in the array."""
    first = found.groupBy(key).agg(F.min_by(F.struct(*[c for c in found.columns if c != key]), order).alias("hit"))
    return wanted.select(F.posexplode(names).alias("place", "wanted")).join(first, F.col("wanted") == F.col(key), "left").select("place", "wanted", "hit")
