"""The fixtures as the rows that operators expect.

customer is a batch, orders its files, lineitem a file's pages, events the marks of a user's documents, region
the tenant. Each frame has its SQL beside it, so that an operator's query and its check start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.registry import Tables

STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'PROCESSING' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'FAILED' WHEN o_orderkey % 5 = 1 THEN 'NEEDS_REVIEW' WHEN o_orderkey % 11 = 2 THEN 'SPLIT' ELSE 'CLEAN' END END"

#: Files: one row an order.
FILES_SQL = f"""
files AS (SELECT o_orderkey AS id, c_nationkey AS organization_id, o_custkey AS batch_id, CAST(NULL AS BIGINT) AS parent_document_id,
  CAST(NULL AS INT) AS page_number, {STATUS_SQL} AS status, 'Scan ' || o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS filename,
  o_orderkey % 3 = 0 AS needs_review, o_orderdate AS created_at, o_orderdate + INTERVAL 90 MINUTE AS updated_at,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS reviewed_at,
  CASE WHEN o_orderkey % 6 < 3 THEN o_orderdate + INTERVAL 2 DAY END AS confirmed_at,
  CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate END AS deleted_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

#: Marks: one row an event.
MARKS_SQL = """
marks AS (SELECT event_id AS seq, user_id AS document_id, CASE event_type WHEN 'view' THEN 'downloaded' WHEN 'click' THEN 'unmarked' ELSE 'marked' END AS kind,
  ts AS document_updated_at FROM events)"""


def status() -> str:
    return STATUS_SQL


def files(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(
        "o_orderkey AS id", "c_nationkey AS organization_id", "o_custkey AS batch_id", "CAST(NULL AS BIGINT) AS parent_document_id",
        "CAST(NULL AS INT) AS page_number", f"{STATUS_SQL} AS status",
        "'Scan ' || o_orderpriority || ' ' || CAST(o_orderkey AS STRING) || '.pdf' AS filename", "o_orderkey % 3 = 0 AS needs_review",
        "o_orderdate AS created_at", "o_orderdate + INTERVAL 90 MINUTE AS updated_at",
        "CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS reviewed_at",
        "CASE WHEN o_orderkey % 6 < 3 THEN o_orderdate + INTERVAL 2 DAY END AS confirmed_at",
        "CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate END AS deleted_at",
    )


def marks(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id AS seq", "user_id AS document_id",
        "CASE event_type WHEN 'view' THEN 'downloaded' WHEN 'click' THEN 'unmarked' ELSE 'marked' END AS kind", "ts AS document_updated_at",
    )
