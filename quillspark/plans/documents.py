"""Queries of document filters, joins, orders, event state, aggregates, windows and queue rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import batches, documents, events, queue, review
from quillspark.plans.analogues import FILES_SQL, MARKS_SQL, files, marks
from quillspark.plans.registry import Tables, query

CONFIRMED_SQL = "coalesce(reviewed_at, CASE WHEN status = 'SUCCEEDED' AND NOT needs_review AND confirmed_at IS NOT NULL THEN confirmed_at END)"
CATEGORY_SQL = f"""CASE WHEN status = 'SPLIT' THEN 'split' WHEN status = 'SUCCEEDED' THEN CASE WHEN {CONFIRMED_SQL} IS NULL THEN 'succeeded' ELSE 'confirmed' END
  WHEN status IN ('VALIDATING', 'SCANNING', 'CLEAN') THEN 'queued' WHEN status = 'PROCESSING' THEN 'processing' WHEN status = 'NEEDS_REVIEW' THEN 'review'
  WHEN status IN ('FAILED', 'QUARANTINED') THEN 'failed' END"""
VISIBLE_SQL = "deleted_at IS NULL AND status NOT IN ('DELETED', 'SPLIT')"


def _with_category(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("confirmed", documents.confirmed_time())
    return docs.withColumn("category", documents.category(F.col("status"), F.col("confirmed")))


@query(f"WITH {FILES_SQL} SELECT id, status, filename FROM files WHERE organization_id = 7 AND {VISIBLE_SQL}")
def scan_tenant(t: Tables) -> DataFrame:
    """Rows 1, 19: a tenant's visible rows."""
    return files(t).where("organization_id = 7").where(documents.visible()).select("id", "status", "filename")


@query(f"WITH {FILES_SQL} SELECT id, {CATEGORY_SQL} AS category, {CONFIRMED_SQL} AS confirmed FROM files")
def status_category(t: Tables) -> DataFrame:
    """Rows 20, 21: bucket and confirmation time."""
    return _with_category(files(t)).select("id", "category", "confirmed")


@query(f"WITH {FILES_SQL} SELECT id FROM files WHERE {VISIBLE_SQL} AND {CATEGORY_SQL} IN ('review', 'failed')")
def filter_statuses(t: Tables) -> DataFrame:
    """Rows 18, 23: one of several buckets."""
    return documents.document_filter(_with_category(files(t)), documents.DocumentSpec(categories=("review", "failed", "review"))).select("id")


@query(f"WITH {FILES_SQL} SELECT id, confirmed FROM (SELECT *, {CONFIRMED_SQL} AS confirmed FROM files) WHERE {VISIBLE_SQL} AND {CATEGORY_SQL} = 'confirmed'")
def filter_confirmed(t: Tables) -> DataFrame:
    """Row 24."""
    return documents.document_filter(_with_category(files(t)), documents.DocumentSpec(categories=("confirmed",))).select("id", "confirmed")


@query(f"WITH {FILES_SQL} SELECT id, batch_id FROM files WHERE {VISIBLE_SQL} AND batch_id = 7")
def filter_batch(t: Tables) -> DataFrame:
    """Row 25."""
    return documents.document_filter(_with_category(files(t)), documents.DocumentSpec(batch_id=7)).select("id", "batch_id")


@query(f"WITH {FILES_SQL} SELECT id, filename FROM files WHERE {VISIBLE_SQL} AND contains(lower(filename), 'urgent 1')")
def search_documents(t: Tables) -> DataFrame:
    """Row 26: case-insensitive substring, trimmed, wild cards taken as they are."""
    return documents.document_filter(_with_category(files(t)), documents.DocumentSpec(search="  URGENT 1 ")).select("id", "filename")


@query(f"""WITH {FILES_SQL} SELECT id, created_at FROM files WHERE {VISIBLE_SQL}
  AND created_at >= TIMESTAMP '1995-01-01' - INTERVAL 7 HOUR AND created_at < TIMESTAMP '1995-02-01' - INTERVAL 7 HOUR""")
def filter_local_days(t: Tables) -> DataFrame:
    """Row 27: local days, half-open."""
    return documents.document_filter(_with_category(files(t)), documents.DocumentSpec(first_day="1995-01-01", last_day="1995-01-31")).select("id", "created_at")


@query(f"""WITH {FILES_SQL}, {MARKS_SQL}, last AS (SELECT document_id, arg_max(kind, seq) AS kind, arg_max(document_updated_at, seq) AS seen FROM marks GROUP BY 1)
  SELECT id, CASE WHEN kind IS NULL OR kind = 'unmarked' THEN 'never' ELSE 'exported' END AS export_state,
    coalesce(kind <> 'unmarked' AND updated_at > seen, false) AS changed_after_export
  FROM files LEFT JOIN last ON id = document_id""")
def export_states(t: Tables) -> DataFrame:
    """Rows 28, 41, 48, 49, 82: state from the latest mark, strictly later changes."""
    return events.with_export_state(files(t), marks(t)).select("id", "export_state", "changed_after_export")


@query(f"WITH {FILES_SQL} SELECT id FROM files WHERE {VISIBLE_SQL} AND id IN (1, 2, 3, 5, 7, 32, 33, 34)")
def filter_ids(t: Tables) -> DataFrame:
    """Row 29."""
    return documents.document_filter(_with_category(files(t)), documents.DocumentSpec(ids=(1, 2, 3, 3, 5, 7, 32, 33, 34))).select("id")


@query(f"WITH {FILES_SQL} SELECT count(*) AS selected, count(*) FILTER ({CATEGORY_SQL} = 'review') AS open, count(*) = 100 AS as_expected FROM files WHERE {VISIBLE_SQL}")
def selection_guard(t: Tables) -> DataFrame:
    """Row 30: counts that a selection is refused by."""
    docs = _with_category(files(t)).where(documents.visible())
    return docs.agg(F.count("*").alias("selected"), F.count_if(F.col("category") == "review").alias("open"), (F.count("*") == 100).alias("as_expected"))


@query("SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS k, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number, coalesce(json_extract_string(props, '$.z'), json_extract_string(props, '$.k'), event_type) AS label FROM events")
def json_paths(t: Tables) -> DataFrame:
    """Rows 31, 32, 33: blank to null, first of several paths, guarded numbers."""
    path = lambda p: F.get_json_object("props", p)
    return t.events.select(
        "event_id", F.nullif(F.trim(path("$.k")), F.lit("")).alias("k"), path("$.k").try_cast("double").alias("number"), F.coalesce(path("$.z"), path("$.k"), "event_type").alias("label")
    )


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE (nullif(l_returnflag, 'N'), l_linenumber) IS DISTINCT FROM (CASE WHEN p_size > 25 THEN 'R' END, CAST(p_size AS INT))""")
def tuples_differ(t: Tables) -> DataFrame:
    """Row 34: null-safe comparison of pairs."""
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    a = F.struct(F.nullif("l_returnflag", F.lit("N")).alias("x"), F.col("l_linenumber").alias("y"))
    b = F.struct(F.when(F.col("p_size") > 25, "R").alias("x"), F.col("p_size").alias("y"))
    return joined.where(~a.eqNullSafe(b)).select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1997-01-01' AND c_acctbal >= 0 AND o_orderdate + INTERVAL 8 DAY > TIMESTAMP '1998-01-01'""")
def valid_sessions(t: Tables) -> DataFrame:
    """Row 35: not revoked, not expired, not idle, user enabled."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    valid = "o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP_NTZ'1997-01-01' AND c_acctbal >= 0 AND o_orderdate + INTERVAL 8 DAY > TIMESTAMP_NTZ'1998-01-01'"
    return joined.where(valid).select("o_orderkey", "c_name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS kept_k, false AS has_secret FROM events")
def audit_details(t: Tables) -> DataFrame:
    """Rows 36, 183: allowed keys stay, secret-named ones go."""
    details = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("api_token"), F.lit("x"), F.lit("other"), F.lit("y")))
    kept = review.allowed_details(details, ("k", "api_token"))
    return t.events.select("event_id", F.try_element_at(kept, F.lit("k")).alias("kept_k"), F.map_contains_key(kept, "api_token").alias("has_secret"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS page_id, l_linenumber AS page_number, 'o' || CAST(l_orderkey AS VARCHAR) AS parent_filename FROM lineitem
  UNION ALL SELECT -o_orderkey, NULL, NULL FROM orders""")
def pages_with_parents(t: Tables) -> DataFrame:
    """Rows 37, 159: left self-join of pages to their file."""
    pages = t.lineitem.selectExpr("l_orderkey * 10 + l_linenumber AS id", "1 AS organization_id", "-l_orderkey AS parent_document_id", "l_linenumber AS page_number", "'p' AS filename")
    parents = t.orders.selectExpr("-o_orderkey AS id", "1 AS organization_id", "CAST(NULL AS BIGINT) AS parent_document_id", "CAST(NULL AS INT) AS page_number", "'o' || CAST(o_orderkey AS STRING) AS filename")
    return documents.with_parent(pages.unionByName(parents)).select(F.col("id").alias("page_id"), "page_number", "parent_filename")


@query("SELECT o_orderkey, c_name AS batch_label, coalesce(n_name, 'unknown') AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON upper(c_mktsegment) = n_name")
def labels_by_name(t: Tables) -> DataFrame:
    """Rows 38, 39: batch label, and a name looked up by its text."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.upper("c_mktsegment") == F.col("n_name"), "left")
    return joined.select("o_orderkey", F.col("c_name").alias("batch_label"), F.coalesce("n_name", F.lit("unknown")).alias("name"))


@query("SELECT o_orderkey, c_name AS batch_label, coalesce(n_name, 'unknown') AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON upper('nation_' || (c_custkey % 40)) = n_name")
def labels_by_known_name(t: Tables) -> DataFrame:
    """Rows 38, 39: as ``labels_by_name``, by texts of which some name a nation."""
    text = F.upper(F.concat(F.lit("nation_"), F.col("c_custkey") % 40))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, text == F.col("n_name"), "left")
    return joined.select("o_orderkey", F.col("c_name").alias("batch_label"), F.coalesce("n_name", F.lit("unknown")).alias("name"))


@query("""SELECT c_custkey, o_orderkey AS last_order, o_orderpriority AS actor FROM customer LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) ON c_custkey = o_custkey AND k = 1""")
def latest_actor(t: Tables) -> DataFrame:
    """Row 40: the latest correction's actor."""
    last = t.orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("l"))
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("l.o_orderkey").alias("last_order"), F.col("l.o_orderpriority").alias("actor"))


@query(f"""WITH {FILES_SQL}, pages AS (SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS done FROM lineitem GROUP BY 1)
  SELECT batch_id, count(*) AS rows, count(*) FILTER (status IN ('VALIDATING', 'SCANNING', 'CLEAN')) AS queued, count(*) FILTER (status = 'PROCESSING') AS processing,
    count(*) FILTER (status = 'SUCCEEDED') AS succeeded, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (status IN ('FAILED', 'QUARANTINED')) AS failed,
    max(done) AS last_completed_at, max(created_at) AS last_created_at, CAST(coalesce(sum(n), 0) AS BIGINT) AS pages_expected
  FROM files LEFT JOIN pages ON id = l_orderkey GROUP BY batch_id""")
def batch_counters(t: Tables) -> DataFrame:
    """Rows 42, 54, 55, 56: filtered aggregates of a batch in one pass."""
    pages = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("page_count"), F.max("l_shipdate").alias("processed_at"))
    rows = files(t).join(pages, F.col("id") == F.col("l_orderkey"), "left")
    return rows.groupBy("batch_id").agg(*batches.counters()).drop("uploaded", "pages")


@query("""SELECT o_custkey, count(*) FILTER (NOT open) AS files_done FROM
  (SELECT o_custkey, o_orderkey, bool_or(l_linestatus = 'O') AS open FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1""")
def files_done(t: Tables) -> DataFrame:
    """Row 43: files without an open page."""
    return batches.files_done(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", "o_orderkey", F.col("l_linestatus") == "O")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def open_batches(t: Tables) -> DataFrame:
    """Rows 44, 86: batches with an open document."""
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""WITH wanted AS (SELECT unnest(['FRANCE', 'nowhere', 'CHINA', 'FRANCE']) AS wanted, unnest([0, 1, 2, 3]) AS place)
  SELECT CAST(place AS INT) AS place, wanted, arg_min(c_custkey, c_custkey) AS first_customer FROM wanted LEFT JOIN nation ON n_name = wanted LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def ordered_array_lookup(t: Tables) -> DataFrame:
    """Row 45: results aligned to the array that asked."""
    wanted = t.spark.range(1).select(F.array(*map(F.lit, ("FRANCE", "nowhere", "CHINA", "FRANCE"))).alias("names"))
    found = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey")
    return events.aligned_lookup(wanted, "names", found, "n_name", F.col("c_custkey")).select("place", "wanted", F.col("hit.c_custkey").alias("first_customer"))


@query("""WITH wanted AS (SELECT unnest(['NATION_6', 'nowhere', 'NATION_18', 'NATION_6']) AS wanted, unnest([0, 1, 2, 3]) AS place)
  SELECT CAST(place AS INT) AS place, wanted, arg_min(c_custkey, c_custkey) AS first_customer FROM wanted LEFT JOIN nation ON n_name = wanted LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def known_names_lookup(t: Tables) -> DataFrame:
    """Row 45: as ``ordered_array_lookup``, with names that nations have."""
    wanted = t.spark.range(1).select(F.array(*map(F.lit, ("NATION_6", "nowhere", "NATION_18", "NATION_6"))).alias("names"))
    found = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey")
    return events.aligned_lookup(wanted, "names", found, "n_name", F.col("c_custkey")).select("place", "wanted", F.col("hit.c_custkey").alias("first_customer"))


@query("""SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name LIKE 'A%' WHERE l_linenumber = 1""")
def job_chain(t: Tables) -> DataFrame:
    """Row 46: job, run, document, batch, tenant."""
    joined = t.lineitem.where("l_linenumber = 1").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name LIKE 'A%'"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name", "n_name", "r_name")


_CORRECTIONS = "corrections AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS document_id, min(l_returnflag) AS field, min(l_shipdate) AS verified_at FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_OUTBOX = "outbox AS (SELECT l_orderkey * 10 + l_linenumber AS correction_id, CASE min(l_quantity) % 6 WHEN 0 THEN 'DEAD' WHEN 1 THEN 'RETRY' WHEN 2 THEN 'PENDING' ELSE 'DELIVERED' END AS status FROM lineitem WHERE l_linenumber <> 2 GROUP BY l_orderkey, l_linenumber)"


@query(f"""WITH {_CORRECTIONS}, {_OUTBOX}, x AS (SELECT document_id, status, row_number() OVER (PARTITION BY document_id, field ORDER BY verified_at DESC, correction_id IS NOT NULL DESC, id) AS k
    FROM corrections LEFT JOIN outbox ON correction_id = id)
  SELECT document_id, CASE WHEN count(status) = 0 THEN 'NONE' WHEN bool_or(status IN ('DEAD', 'FAILED')) THEN 'FAILED' WHEN bool_or(status = 'RETRY') THEN 'RETRYING'
    WHEN bool_or(status IN ('PENDING', 'PROCESSING')) THEN 'PENDING' ELSE 'DELIVERED' END AS delivery FROM x WHERE k = 1 GROUP BY 1""")
def delivery_status(t: Tables) -> DataFrame:
    """Rows 47, 51, 57: the latest correction of each field, then a ladder."""
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_shipdate").alias("l_shipdate"), F.min("l_quantity").alias("l_quantity"))
    corrections = rows.selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_orderkey AS document_id", "l_returnflag AS field", "l_shipdate AS verified_at")
    outbox = rows.where("l_linenumber <> 2").selectExpr("l_orderkey * 10 + l_linenumber AS correction_id", "CASE l_quantity % 6 WHEN 0 THEN 'DEAD' WHEN 1 THEN 'RETRY' WHEN 2 THEN 'PENDING' ELSE 'DELIVERED' END AS status")
    return events.delivery(corrections, outbox)


@query("""SELECT o_orderkey, len(pages) AS n, CASE WHEN len(pages) = CAST(substr(o_orderpriority, 1, 1) AS INT) THEN array_to_string(list_transform(pages, lambda p, i: CAST(i AS VARCHAR) || '=' || p), ',') END AS zipped
  FROM orders JOIN (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS pages FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def positional_zip(t: Tables) -> DataFrame:
    """Row 47a: lists are zipped only when their lengths agree."""
    pages = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("pages"))
    joined = t.orders.join(pages, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("n", F.size("pages").cast("long"))
    labels = F.transform(F.sequence(F.lit(1), F.substring("o_orderpriority", 1, 1).cast("int")), lambda i: i.cast("string"))
    zipped = F.array_join(F.transform(F.arrays_zip(labels.alias("a"), F.col("pages").alias("b")), lambda x: F.concat(x["a"], F.lit("="), x["b"])), ",")
    return joined.select("o_orderkey", "n", F.when(F.col("n") == F.size(labels), zipped).alias("zipped"))


@query(f"""WITH {FILES_SQL}, {MARKS_SQL}, last AS (SELECT document_id, arg_max(kind, seq) AS kind, arg_max(document_updated_at, seq) AS seen FROM marks GROUP BY 1)
  SELECT count(*) AS total, count(*) FILTER (needed) AS affected, count(*) FILTER (NOT needed) AS skipped FROM
    (SELECT NOT (coalesce(kind <> 'unmarked', false) AND NOT coalesce(updated_at > seen, false)) AS needed FROM files LEFT JOIN last ON id = document_id WHERE {VISIBLE_SQL})""")
def mark_where_needed(t: Tables) -> DataFrame:
    """Rows 14, 50: marking skips what is exported and unchanged."""
    return events.mark(events.with_export_state(files(t).where(documents.visible()), marks(t)), "marked")[1]


@query("""SELECT n_nationkey AS k, CASE WHEN v IS NULL THEN n_name ELSE v END AS name FROM nation LEFT JOIN (SELECT user_id % 40 AS key, arg_max(event_type, event_id) AS v FROM events GROUP BY 1) ON key = n_nationkey
  UNION ALL SELECT key, v FROM (SELECT user_id % 40 AS key, arg_max(event_type, event_id) AS v FROM events GROUP BY 1) WHERE key NOT IN (SELECT n_nationkey FROM nation)""")
def upsert_rows(t: Tables) -> DataFrame:
    """Row 52: the last change of a key wins; new keys are inserted."""
    table = t.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS k", "n_name AS name")
    return events.upsert(table, t.events.selectExpr("user_id % 40 AS k", "event_type AS name", "event_id"), ["k"], "event_id")


@query("SELECT c_custkey, c_nationkey, coalesce(max_seq, 0) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS queue_seq FROM customer JOIN (SELECT c_nationkey AS n, max(CASE WHEN c_custkey % 3 = 0 THEN c_custkey END) AS max_seq FROM customer GROUP BY 1) ON n = c_nationkey WHERE c_custkey % 3 <> 0")
def number_rows(t: Tables) -> DataFrame:
    """Rows 53, 69, 70, 72: numbering after a tenant's largest number."""
    rows = t.customer.withColumn("seq", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")))
    return events.numbered(rows, "c_nationkey", [F.col("c_acctbal"), F.col("c_custkey")], "seq").select("c_custkey", "c_nationkey", "queue_seq")


@query(f"""WITH {FILES_SQL}, {MARKS_SQL}, last AS (SELECT document_id, arg_max(kind, seq) AS kind FROM marks GROUP BY 1),
  base AS (SELECT *, CASE WHEN kind IS NULL OR kind = 'unmarked' THEN 'never' ELSE 'exported' END AS s, {CONFIRMED_SQL} AS c FROM files LEFT JOIN last ON id = document_id WHERE {VISIBLE_SQL})
  SELECT count(*) AS n_all, count(*) FILTER (s = 'never') AS n_never, count(*) FILTER (s = 'exported') AS n_exported, count(*) FILTER (s = 'never' AND c IS NULL) AS never_unconfirmed, count(DISTINCT batch_id) AS n_batches FROM base""")
def tab_counts(t: Tables) -> DataFrame:
    """Rows 58, 59: every tab's count in one pass."""
    docs = events.with_export_state(_with_category(files(t)).where(documents.visible()), marks(t))
    never = F.col("export_state") == "never"
    return docs.agg(
        F.count("*").alias("n_all"), F.count_if(never).alias("n_never"), F.count_if(~never).alias("n_exported"),
        F.count_if(never & F.col("confirmed").isNull()).alias("never_unconfirmed"), F.countDistinct("batch_id").alias("n_batches"),
    )


@query("""WITH c AS (SELECT o_custkey, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'P') AS processing, max(o_orderdate) AS last_c, min(o_orderdate) AS created_at FROM orders GROUP BY 1)
  SELECT o_custkey, succeeded AS completed, rows + greatest(0, 12 - rows) AS rows_expected, rows >= 12 AND processing = 0 AS finished,
    CASE WHEN succeeded > 0 AND date_diff('second', created_at, last_c) > 0 AND processing = 0 THEN floor(succeeded / (date_diff('second', created_at, last_c) / 60) * 100 + 0.5) / 100
      WHEN succeeded > 0 AND processing > 0 THEN floor(succeeded / (date_diff('second', created_at, TIMESTAMP '2030-01-01') / 60) * 100 + 0.5) / 100 END AS per_minute FROM c""")
def batch_summary(t: Tables) -> DataFrame:
    """Row 60: derived columns of a batch."""
    counted = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("succeeded"), F.count_if(F.col("o_orderstatus") == "P").alias("processing"),
        F.max("o_orderdate").cast("timestamp").alias("last_completed_at"), F.min("o_orderdate").cast("timestamp").alias("created_at"),
    )
    zero = {c: F.lit(0) for c in ("needs_review", "failed", "queued", "splitting_counted", "pages", "pages_expected")}
    counted = counted.withColumns(zero | {"uploaded": F.col("rows"), "expected_total": F.lit(12), "last_created_at": F.col("last_completed_at")})
    return batches.summary(counted, F.lit("2030-01-01").cast("timestamp")).select("o_custkey", "completed", "rows_expected", "finished", "per_minute")


@query("SELECT event_type, median(value) AS typical FROM events GROUP BY 1")
def medians(t: Tables) -> DataFrame:
    """Row 61: mean of the middle two."""
    return t.events.groupBy("event_type").agg(F.median("value").alias("typical"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events),
  g AS (SELECT event_type, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS gap FROM l WHERE k <= 21)
  SELECT event_type, CASE WHEN count(*) >= 5 THEN floor(median(gap) * 10 + 0.5) / 10 END AS seconds_each FROM g WHERE gap <= 900 GROUP BY 1""")
def completion_rates(t: Tables) -> DataFrame:
    """Rows 62, 71: median gap of the last completions."""
    return batches.completion_rate(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts")


@query("""SELECT CAST(sum(CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE greatest(0, 20 - n) END) AS BIGINT) AS remaining, sum(CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE greatest(0, 20 - n) END) * 2.5 AS eta_s,
  least(sum(CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE greatest(0, 20 - n) END), 100) * 2.5 AS round_eta_s FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)""")
def queue_estimates(t: Tables) -> DataFrame:
    """Row 63: what remains, and how long it takes."""
    counted = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("completed"))
    rows = counted.withColumns({"held": F.col("c_custkey") % 9 == 0, "rows_expected": F.lit(20)})
    return batches.queue_totals(rows, F.lit(2.5).cast("double"), F.lit(100)).withColumns({c: F.col(c).cast("double") for c in ("eta_s", "round_eta_s")})


@query("""SELECT event_type, max(CASE WHEN k = least(n - 1, floor(n * 0.9)) THEN value END) AS p90, max(CASE WHEN k = least(n - 1, floor(n * 0.95)) THEN value END) AS p95
  FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def index_percentiles(t: Tables) -> DataFrame:
    """Row 68: percentiles by index, without interpolation."""
    return batches.ranked_percentile(t.events, "event_type", "value", {"p90": 0.9, "p95": 0.95})


@query("SELECT o_orderkey, row_number() OVER (ORDER BY (p IS NULL), p DESC, o_orderdate DESC, o_orderkey DESC) AS place FROM (SELECT *, floor(CASE WHEN x <= 1 THEN x * 100 ELSE x END + 0.5) AS p FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 100.0 END AS x FROM orders WHERE o_orderdate < TIMESTAMP '1993-06-01')) QUALIFY place <= 500")
def confidence_ranking(t: Tables) -> DataFrame:
    """Rows 73, 76, 80, 127: by displayed percent, unread last, ties in the default order; the top 500."""
    rows = t.orders.where("o_orderdate < TIMESTAMP_NTZ'1993-06-01'").selectExpr("o_orderkey AS id", "o_orderdate AS created_at", "CAST(NULL AS BIGINT) AS parent_document_id", "CAST(NULL AS INT) AS page_number", "CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 100D END AS conf")
    top = documents.ranked_by_percent(rows, "conf", descending=True).limit(500)
    order = documents.sorted_by(F.floor(F.when(F.col("conf") <= 1, F.col("conf") * 100).otherwise(F.col("conf")) + 0.5), True)
    return top.select(F.col("id").alias("o_orderkey"), F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY (p IS NULL), p DESC, o_orderdate DESC, o_orderkey DESC) AS place FROM (SELECT *, floor(CASE WHEN x <= 1 THEN x * 100 ELSE x END + 0.5) AS p FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 100.0 END AS x FROM orders))")
def confidence_places(t: Tables) -> DataFrame:
    """Rows 73, 76, 80, 127: the place of every order by displayed percent, unread last, ties in the default order."""
    rows = t.orders.selectExpr("o_orderkey", "o_orderkey AS id", "o_orderdate AS created_at", "CAST(NULL AS BIGINT) AS parent_document_id", "CAST(NULL AS INT) AS page_number", "CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 100D END AS conf")
    percent = F.floor(F.when(F.col("conf") <= 1, F.col("conf") * 100).otherwise(F.col("conf")) + 0.5)
    return documents.places(rows, "o_orderkey", documents.sorted_by(percent, True))


@query(f"WITH {FILES_SQL} SELECT id FROM files WHERE {VISIBLE_SQL} ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 400")
def document_page(t: Tables) -> DataFrame:
    """Rows 74, 81, 83, 84: the default order, clamped paging."""
    return documents.page(files(t).where(documents.visible()), documents.default_order(), 5000, 400).select("id")


@query(f"WITH {FILES_SQL} SELECT id, CAST(CASE {CATEGORY_SQL} WHEN 'review' THEN 1 WHEN 'failed' THEN 2 WHEN 'processing' THEN 3 WHEN 'queued' THEN 4 WHEN 'succeeded' THEN 5 WHEN 'confirmed' THEN 6 ELSE 99 END AS INT) AS rank FROM files")
def status_ranks(t: Tables) -> DataFrame:
    """Row 79."""
    return _with_category(files(t)).select("id", documents.status_rank(F.col("category")).alias("rank"))


@query("""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(room, '^[0-9]{1,9}'), '') AS INT) AS number, room FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'A' || p_size ELSE '0' || p_size || 'B' END AS room FROM part)""")
def room_keys(t: Tables) -> DataFrame:
    """Row 78: leading numbers of rooms."""
    room = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("A"), "p_size")).otherwise(F.concat(F.lit("0"), "p_size", F.lit("B")))
    number, text = documents.room_key(room)
    return t.part.select("p_partkey", number.alias("number"), text.alias("room"))


@query("SELECT p_partkey FROM part ORDER BY lower(p_name) COLLATE th, p_partkey LIMIT 100")
def thai_order(t: Tables) -> DataFrame:
    """Row 77: dictionary order."""
    return t.part.orderBy(documents.thai_key(F.col("p_name")), "p_partkey").limit(100).select("p_partkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name) COLLATE th, p_partkey) AS place FROM part")
def thai_places(t: Tables) -> DataFrame:
    """Row 77: the place of every part in dictionary order."""
    return documents.places(t.part, "p_partkey", [documents.thai_key(F.col("p_name")), F.col("p_partkey")])


@query("SELECT o_orderkey AS id, 'RUNNING' AS status, CAST(o_orderkey % 3 + 1 AS BIGINT) AS attempts, TIMESTAMP '1996-01-01 00:02:00' AS lease_expires_at FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT) DESC, o_orderdate, o_orderkey LIMIT 25")
def queue_claim(t: Tables) -> DataFrame:
    """Rows 85, Q1: due jobs in claim order."""
    return queue.claim(_jobs(t), F.lit("1996-01-01").cast("timestamp_ntz"), 25).select("id", "status", "attempts", "lease_expires_at")


def _jobs(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS id", "CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status", "INT(substr(o_orderpriority, 1, 1)) AS priority",
        "o_orderdate AS available_at", "o_orderkey % 3 AS attempts", "2 AS max_attempts", "o_orderdate + INTERVAL 120 SECOND AS lease_expires_at", "o_orderkey % 2 = 0 AS ok",
    )


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'SUCCEEDED' WHEN o_orderkey % 3 < 2 THEN 'PENDING' ELSE 'DEAD' END AS status,
  CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 < 2 THEN TIMESTAMP '1997-01-01 00:00:05' ELSE o_orderdate END AS available_at FROM orders""")
def queue_finish(t: Tables) -> DataFrame:
    """Rows Q2, Q3: again while attempts are left, else dead."""
    return _jobs(t).withColumns(queue.finished(F.col("ok"), F.lit("1997-01-01").cast("timestamp_ntz"))).select("id", "status", "available_at")


@query("SELECT CASE WHEN o_orderstatus = 'O' OR o_orderstatus = 'P' AND o_orderdate + INTERVAL 120 SECOND <= TIMESTAMP '1996-06-01' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status, count(*) AS n FROM orders GROUP BY 1")
def queue_recover(t: Tables) -> DataFrame:
    """Row Q4: expired leases are taken back."""
    return _jobs(t).groupBy(queue.recovered(F.lit("1996-06-01").cast("timestamp_ntz")).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'DELIVERED' WHEN event_id % 13 >= 11 THEN 'DEAD' ELSE 'RETRY' END AS status,
  CAST(CASE WHEN event_id % 4 = 0 OR event_id % 13 >= 11 THEN 0 ELSE least(3600, pow(2, least(event_id % 13, 10))) END AS BIGINT) AS wait_s FROM events""")
def outbox_step(t: Tables) -> DataFrame:
    """Rows 128, Q5: failures wait twice as long each time."""
    now = F.lit("2020-01-01").cast("timestamp_ntz")
    rows = t.events.select("event_id", (F.col("event_id") % 13).alias("attempts"), F.lit(11).alias("max_attempts"), now.alias("next_attempt_at"))
    done = rows.withColumns(queue.outbox_finished(F.col("event_id") % 4 == 0, now))
    return done.select("event_id", "status", F.timestamp_diff("SECOND", now, F.col("next_attempt_at")).alias("wait_s"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'stopped' WHEN n + 2 >= 12 THEN 'round_full' ELSE 'reading' END AS state FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def round_states(t: Tables) -> DataFrame:
    """Rows Q6, Q7: stopped wins over a full round."""
    counted = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    stopped = F.when(F.col("c_custkey") % 10 == 0, F.lit("1999-01-01"))
    return counted.select("c_custkey", queue.round_state(stopped, F.lit(12), F.col("n"), F.lit(2)).alias("state"))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  f AS (SELECT user_id, ts, k, ts AS opened, 1 AS n FROM e WHERE k = 1 UNION ALL
    SELECT e.user_id, e.ts, e.k, CASE WHEN epoch(e.ts) - epoch(opened) >= 86400 THEN e.ts ELSE opened END, CASE WHEN epoch(e.ts) - epoch(opened) >= 86400 THEN 1 ELSE n + 1 END
    FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
  SELECT user_id, count(*) FILTER (n <= 2) AS admitted, count(*) FILTER (n > 2) AS refused FROM f GROUP BY 1""")
def rate_limit(t: Tables) -> DataFrame:
    """Row Q8: windows anchored at a key's first event."""
    return queue.limited(t.events, "user_id", "ts", 86_400, 2).groupBy("user_id").agg(F.count_if("allowed").alias("admitted"), F.count_if(~F.col("allowed")).alias("refused"))


@query("SELECT props AS key, min(event_id) AS first_id, count(*) - 1 AS replays FROM events GROUP BY 1")
def idempotent_replay(t: Tables) -> DataFrame:
    """Rows Q10, Q11, 171: the first request of a key wins."""
    return t.events.groupBy(F.col("props").alias("key")).agg(F.min("event_id").alias("first_id"), (F.count("*") - 1).alias("replays"))


@query("""SELECT o_orderkey, CAST(p AS INT) AS page_number, substr(sha256('page:' || o_orderkey || ':' || p), 1, 32) AS child_id, o_orderdate + to_microseconds(p) AS available_at
  FROM (SELECT *, unnest(range(1, CAST(substr(o_orderpriority, 1, 1) AS INT) + 1)) AS p FROM orders)""")
def page_fan_out(t: Tables) -> DataFrame:
    """Rows Q12, 176: pages with deterministic ids."""
    parents = t.orders.select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("page_count"), F.col("o_orderdate").alias("created_at"))
    return queue.fan_out(parents).select(F.col("id").alias("o_orderkey"), "page_number", "child_id", "available_at")


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def alert_windows(t: Tables) -> DataFrame:
    """Row Q13: counts in time windows."""
    w = F.window(F.col("ts").cast("timestamp"), "15 minutes")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT o_custkey, count(*) AS uploaded, count(*) > 10 AS over FROM orders GROUP BY 1")
def batch_capacity(t: Tables) -> DataFrame:
    """Row 172: uploaded files against the promised total."""
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("uploaded"), (F.count("*") > 10).alias("over"))


@query("SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE n >= CAST(substr(o_orderpriority, 1, 1) AS INT)")
def split_complete(t: Tables) -> DataFrame:
    """Row 173: parents with all their pages."""
    children = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return t.orders.join(children, F.col("o_orderkey") == F.col("l_orderkey")).where(F.col("n") >= F.substring("o_orderpriority", 1, 1).cast("int")).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders o WHERE o_orderkey % 5 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P')""")
def reopened_rounds(t: Tables) -> DataFrame:
    """Rows 174, 175: retryable rows of batches with no open row."""
    retryable = t.orders.where("o_orderkey % 5 = 0").join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    busy = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("busy"))
    return retryable.join(busy, F.col("o_custkey") == F.col("busy"), "left_anti").select("o_orderkey")


@query("SELECT user_id, CAST(count(*) % 5 AS INT) AS failures, count(*) >= 5 AS was_locked FROM events WHERE event_type = 'error' GROUP BY 1")
def lockouts(t: Tables) -> DataFrame:
    """Row 179: failures wrap to 0 at the limit."""
    return t.events.where("event_type = 'error'").groupBy("user_id").agg((F.count("*") % 5).cast("int").alias("failures"), (F.count("*") >= 5).alias("was_locked"))


@query("SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS admins, count(*) FILTER (c_mktsegment = 'BUILDING') <= 1 AS refused FROM customer GROUP BY 1")
def last_admin(t: Tables) -> DataFrame:
    """Row 180: refuse when the only admin would go."""
    admins = F.count_if(F.col("c_mktsegment") == "BUILDING")
    return t.customer.groupBy("c_nationkey").agg(admins.alias("admins"), (admins <= 1).alias("refused"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 'disabled' WHEN c_acctbal < 0 THEN 'locked' WHEN c_custkey % 3 = 0 THEN 'invited' ELSE 'active' END AS state FROM customer")
def account_states(t: Tables) -> DataFrame:
    """Row 182: a ladder."""
    state = F.when(F.col("c_acctbal") < -500, "disabled").when(F.col("c_acctbal") < 0, "locked").when(F.col("c_custkey") % 3 == 0, "invited").otherwise("active")
    return t.customer.select("c_custkey", state.alias("state"))


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def retention(t: Tables) -> DataFrame:
    """Row 17: rows that haven't expired."""
    last = t.events.agg(F.max("ts").alias("last"))
    return t.events.join(F.broadcast(last)).where("ts > last - INTERVAL 3 DAY").select("event_id", "ts")  # one row


@query("""SELECT o_custkey AS batch, count(*) AS open_files, CAST(sum(n) AS BIGINT) AS pages, max(ts) AS last_mark, arg_max(kind, ts) AS state FROM
    (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1, 2)
    LEFT JOIN (SELECT user_id, max(event_id) AS ts, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1) ON user_id = o_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def open_items_per_batch(t: Tables) -> DataFrame:
    """The flagship: open files and pages of a batch, with its latest event; the top 50."""
    pages = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    open_files = t.orders.where("o_orderstatus <> 'F'").join(pages, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("open_files"), F.sum("n").alias("pages"))
    last = t.events.groupBy("user_id").agg(F.max("event_id").alias("last_mark"), F.max_by("event_type", "event_id").alias("state"))
    joined = open_files.join(last, F.col("user_id") == F.col("o_custkey"), "left").orderBy(F.desc("open_files"), "o_custkey").limit(50)
    return joined.select(F.col("o_custkey").alias("batch"), "open_files", "pages", "last_mark", "state")
