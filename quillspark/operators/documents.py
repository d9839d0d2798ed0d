"""Document read models: visibility, status, filters, search, orders, paging.

Columns as in the relational rows: id, organization_id, batch_id, parent_document_id, page_number, status,
filename, needs_review, created_at, updated_at, reviewed_at, confirmed_at, deleted_at. Null never matches a
predicate; ties of an order fall to the default order, whose last key is the id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import clamp, displayed_percent, local_day_start

# Statuses by category, the rank of a category, and limits of a page and of an explicit selection.
CATEGORIES = {
    "queued": ("VALIDATING", "SCANNING", "CLEAN"),
    "processing": ("PROCESSING",),
    "review": ("NEEDS_REVIEW",),
    "failed": ("FAILED", "QUARANTINED"),
}
RANKS = ("review", "failed", "processing", "queued", "succeeded", "confirmed")
MAX_PAGE, MAX_OFFSET, MAX_IDS, MAX_SEARCH = 200, 1_000_000, 5_000, 100


def visible(status: str = "status", deleted_at: str = "deleted_at") -> Column:
    return F.col(deleted_at).isNull() & ~F.col(status).isin("DELETED", "SPLIT")


def confirmed_time(old_with_flags: Column | None = None) -> Column:
    """When a document counts as confirmed; ``old_with_flags``: an old-schema row with a flag left."""
    settled = (F.col("status") == "SUCCEEDED") & ~F.col("needs_review") & F.col("confirmed_at").isNotNull()
    if old_with_flags is not None:
        settled &= ~F.coalesce(old_with_flags, F.lit(False))
    return F.coalesce("reviewed_at", F.when(settled, F.col("confirmed_at")))


def category(status: Column, confirmed: Column) -> Column:
    """One of six buckets, ``split``, or null for deleted and unknown."""
    out = F.when(status == "SPLIT", "split").when(status == "SUCCEEDED", F.when(confirmed.isNotNull(), "confirmed").otherwise("succeeded"))
    for name, statuses in CATEGORIES.items():
        out = out.when(status.isin(*statuses), name)
    return out


def status_rank(of: Column) -> Column:
    return reduce(lambda out, k: out.when(of == RANKS[k], k + 1), range(1, len(RANKS)), F.when(of == RANKS[0], 1)).otherwise(99)


def search(text: str, columns: list[Column]) -> Column:
    """Case-insensitive substring in any column, after a trim and a cut to ``MAX_SEARCH``; ``%`` and ``_`` are themselves."""
    wanted = F.lower(F.lit(text.strip()[:MAX_SEARCH]))
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), wanted), F.lit(False)) for c in columns))


def local_days(ts: Column, first: str, last: str) -> Column:
    """From the start of local day ``first`` to before the end of ``last``."""
    until = F.date_add(F.lit(last).cast("date"), 1)
    return (ts >= local_day_start(F.lit(first).cast("date"))) & (ts < local_day_start(until))


@dataclass(frozen=True)
class DocumentSpec:
    """What one filter asks; every part that is set must hold."""

    categories: tuple[str, ...] = ()
    batch_id: object = None
    parent_id: object = None
    search: str = ""
    first_day: str = ""
    last_day: str = ""
    day_of: str = "created_at"
    export_state: str = ""
    ids: tuple = ()


def document_filter(docs: DataFrame, spec: DocumentSpec, search_columns: list[str] = ("filename",)) -> DataFrame:
    """``docs`` (with category and, where asked for, export_state) under a spec; one filter for list, preview, export and marks."""
    unknown = set(spec.categories) - set(RANKS)
    if unknown or spec.export_state not in ("", "never", "exported") or len(set(spec.ids)) > MAX_IDS:
        raise ValueError(f"not a filter: {unknown or spec.export_state or len(spec.ids)}")
    out = docs.where(visible())
    if spec.categories:
        out = out.where(F.col("category").isin(*dict.fromkeys(spec.categories)))
    if spec.batch_id is not None:
        out = out.where(F.col("batch_id") == F.lit(spec.batch_id))
    if spec.parent_id is not None:
        out = out.where(F.col("parent_document_id") == F.lit(spec.parent_id))
    if spec.search.strip():
        out = out.where(search(spec.search, [F.col(c) for c in search_columns]))
    if spec.first_day:
        out = out.where(local_days(F.col(spec.day_of), spec.first_day, spec.last_day or spec.first_day))
    if spec.export_state:
        out = out.where(F.col("export_state") == spec.export_state)
    if spec.ids:
        out = out.where(F.col("id").isin(*dict.fromkeys(spec.ids)))
    return out


def default_order() -> list[Column]:
    return [F.desc("created_at"), F.coalesce("parent_document_id", "id").desc(), F.asc_nulls_first("page_number"), F.desc("id")]


def export_order() -> list[Column]:
    return [F.asc("created_at"), F.coalesce("parent_document_id", "id").asc(), F.asc_nulls_first("page_number"), F.asc("id")]


def sorted_by(key: Column, descending: bool = False) -> list[Column]:
    """Null last either way, ties in the default order."""
    return [key.isNull().asc(), key.desc() if descending else key.asc(), *default_order()]


def thai_key(text: Column) -> Column:
    """Dictionary order of the Thai locale, whatever the case."""
    return F.collate(F.lower(text), "th")


def room_key(room: Column) -> list[Column]:
    """Rooms by their leading number, then by text."""
    return [F.regexp_extract(room, "^[0-9]{1,9}", 0).try_cast("int"), room]


def ranked_by_percent(docs: DataFrame, confidence: str, descending: bool = False) -> DataFrame:
    """In the order of the displayed percent, ties and unread rows in the default order."""
    return docs.orderBy(*sorted_by(displayed_percent(F.col(confidence)), descending))


def places(docs: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``key`` and ``place`` (from 1) of every row: a sort by ranges, whose sizes give each range its first place."""
    sorted_ids = docs.orderBy(*order).select(F.col(key).cast("long")).rdd
    return sorted_ids.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1)).toDF(f"{key} long, place long")


def page(docs: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return docs.orderBy(*order).offset(max(0, min(offset, MAX_OFFSET))).limit(max(1, min(limit, MAX_PAGE)))


def with_parent(docs: DataFrame, columns: tuple[str, ...] = ("filename",)) -> DataFrame:
    """Pages beside their parent's columns, which stay null for files."""
    parents = docs.select(F.col("id").alias("_parent"), F.col("organization_id").alias("_org"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    same = (F.col("parent_document_id") == F.col("_parent")) & (F.col("organization_id") == F.col("_org"))
    return docs.join(parents, same, "left").drop("_parent", "_org")


def clamped(value: Column, low: int, high: int) -> Column:
    return clamp(value, low, high)
