"""Queries of text, date, duration, JSON, export and evaluation functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dates, durations, text
from quillspark.operators import quality, review
from quillspark.plans.registry import Tables, query
from quillspark.sources import tables

# Vectors: raw texts and what they mean, used where the fixtures hold no such text.
DURATIONS = (
    ("90 นาที", 90), ("1.5 ชม.", 90), ("1 ชม. 30 นาที", 90), ("1 ชม. 30", 90), ("1h30", 90), ("1:30", 90), ("1 ชั่วโมงครึ่ง", 90), ("๙๐", 90), ("1.5", 90), ("90", 90),
    ("2", 120), ("60 mins", 60), ("1 hour", 60), ("2 hrs.", 120), ("45 m", 45), ("0,5 h", 30), ("90 นาที + 1 ชม.", None), ("abc", None), ("", None), ("1 ชม. 5 นาที", 65),
)
DATES = (
    ("16/08/26", "2026-08-16"), ("16 Aug 2026", "2026-08-16"), ("16.8.69", "2026-08-16"), ("Aug 16 2026", "2026-08-16"), ("2026-08-16", "2026-08-16"), ("08/16/2026", "2026-08-16"),
    ("๑๖ ส.ค. ๒๕๖๙", "2026-08-16"), ("31/02/2026", None), ("16/08", None), ("no date", None), ("1/1/1999", None), ("29 กุมภาพันธ์ 2567", "2024-02-29"),
)
TIMES = (("14:30", "14:30"), ("14.30 น.", "14:30"), ("2.30 pm", "14:30"), ("1430", "14:30"), ("2pm", "14:00"), ("12 am", "00:00"), ("25:00", None), ("9:75", None), ("soon", None))
NAMES = ("เเผนไทย  A.pdf", " a B .PDF", "x​y\u0007.pdf", "\u0007", "é.pdf", "é.pdf", "ＡＢ　ｃ.pdf")


def _vectors(t: Tables, rows: tuple, schema: str) -> DataFrame:
    return t.spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def _sql_values(rows: tuple, names: str) -> str:
    def one(x: object) -> str:
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") v({names})"


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_labels(t: Tables) -> DataFrame:
    """Row 2: rows without a label."""
    return tables.unlabelled(t.documents.select("doc_id"), t.labels, "doc_id")


@query("SELECT user_id, CAST(arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS BIGINT) AS k FROM events WHERE event_type <> 'error' GROUP BY 1")
def tolerant_json_lines(t: Tables) -> DataFrame:
    """Row 3: blank and broken lines are skipped, the last line of a key wins."""
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken"), "props")).otherwise(F.concat(F.lit('{"user_id": '), "user_id", F.lit(", "), F.substring("props", 2, 1_000)))
    return tables.json_lines(t.events.select("event_id", line.alias("line")), "line", "event_id", "user_id long, k long", ["user_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'application/pdf' WHEN doc_id % 4 = 1 THEN 'image/png' WHEN doc_id % 4 = 2 THEN 'image/jpeg' END AS kind FROM documents")
def content_sniffing(t: Tables) -> DataFrame:
    """Row 8: bytes override names."""
    heads = F.element_at(F.array(*map(F.lit, ("255044462D312E37", "89504E470D0A1A0A00", "FFD8FFE0", "68656C6C6F"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", tables.sniffed(F.unhex(heads), F.lit("x.pdf")).alias("kind"))


@query("""SELECT doc_id, 'org/00000000-0000-0000-0000-0000000000ab/original/' || substr(md5(text), 1, 2) || '/' || md5(text) AS key, md5(text) AS name FROM documents""")
def object_keys(t: Tables) -> DataFrame:
    """Row 9: keys are minted and parsed back."""
    key = tables.object_key(F.lit("00000000-0000-0000-0000-0000000000AB"), F.md5("text"))
    return t.documents.select("doc_id", key.alias("key")).withColumn("name", tables.parsed_key(F.col("key"))["name"])


@query("""SELECT doc_id FROM documents WHERE n_chars BETWEEN 1 AND 5000 AND lang IN ('en', 'de') AND length(source) <= 120""")
def upload_checks(t: Tables) -> DataFrame:
    """Row 10: size cap, accepted types, length of names."""
    return t.documents.where(F.col("n_chars").between(1, 5000) & F.col("lang").isin("en", "de") & (F.length("source") <= 120)).select("doc_id")


_CELL = """CASE WHEN regexp_matches(x, '[",\\r\\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END"""


@query(f"""SELECT doc_id, {_CELL} AS cell FROM (SELECT doc_id, CASE WHEN regexp_matches(y, '^[=+\\-@\\t\\r]') THEN '''' || y ELSE y END AS x
  FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' ELSE '' END || substr(text, 1, 60) || CASE doc_id % 2 WHEN 0 THEN '"q"' ELSE '' END AS y FROM documents))""")
def csv_cells(t: Tables) -> DataFrame:
    """Rows 11, 112, 113: formula guard and quoting."""
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, "=").otherwise(""), F.substring("text", 1, 60), F.when(F.col("doc_id") % 2 == 0, '"q"').otherwise(""))
    return t.documents.select("doc_id", text.csv_cell(raw).alias("cell"))


@query(f"""SELECT doc_id, {_CELL} AS cell FROM (SELECT doc_id, CASE WHEN regexp_matches(y, '^[=+\\-@\\t\\r]') THEN '''' || y ELSE y END AS x
  FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' ELSE '' END || text || CASE doc_id % 2 WHEN 0 THEN '"q"' ELSE '' END AS y FROM documents))""")
def whole_csv_cells(t: Tables) -> DataFrame:
    """Rows 11, 112, 113: as ``csv_cells``, over whole texts."""
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, "=").otherwise(""), "text", F.when(F.col("doc_id") % 2 == 0, '"q"').otherwise(""))
    return t.documents.select("doc_id", text.csv_cell(raw).alias("cell"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def json_line_rows(t: Tables) -> DataFrame:
    """Rows 12, 13, 144: one object a line."""
    return t.nation.select(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("line"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[\\s.\\-_,:;/()]+', '', 'g') AS key FROM part")
def match_keys(t: Tables) -> DataFrame:
    """Rows 87, 88: match keys."""
    return t.part.select("p_partkey", text.skeleton(F.col("p_name")).alias("key"))


@query("SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || p_brand, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS key FROM part")
def filename_keys(t: Tables) -> DataFrame:
    """Rows 91, 92: names are compared by this key."""
    return t.part.select("p_partkey", text.filename_key(F.concat(F.lit("  "), "p_name", F.lit("\t"), "p_brand")).alias("key"))


@query()
def filename_vectors(t: Tables) -> DataFrame:
    """Rows 89, 91: NFC, controls and wide spaces, on vectors that SQL engines fold differently."""
    rows = _vectors(t, NAMES, "name string")
    return rows.select("name", text.filename_key(F.col("name")).alias("key"), text.score_key(F.col("name")).alias("score_key"))


@query("SELECT c_custkey, nullif(array_to_string(list_filter([nullif(c_mktsegment, 'BUILDING'), c_name], lambda x: x IS NOT NULL), '; '), '') AS joined FROM customer")
def joined_lists(t: Tables) -> DataFrame:
    """Row 111: nulls are dropped, nothing gives null."""
    return t.customer.select("c_custkey", text.join_list(F.array(F.nullif("c_mktsegment", F.lit("BUILDING")), "c_name")).alias("joined"))


@query("SELECT o_orderkey, array_to_string(list_filter(string_split(o_orderpriority, '-'), lambda x: lower(trim(x)) NOT IN ('', 'none', '-')), '|') AS kept FROM orders")
def placeholders(t: Tables) -> DataFrame:
    """Row 98: words that stand for nothing go."""
    return t.orders.select("o_orderkey", F.array_join(text.drop_placeholders(F.split("o_orderpriority", "-")), "|").alias("kept"))


@query("SELECT page_id, length(html) > 0 AS has_text, NOT contains(html, 'zzzz') AS is_clean FROM pages")
def markup_text(t: Tables) -> DataFrame:
    """Row 93: an answer's text without tags; checks that no tag is left."""
    plain = text.strip_markup(F.col("html"))
    return t.pages.select("page_id", (F.length(plain) > 0).alias("has_text"), (~plain.rlike(r"<(?:div|p|script|style|li|nav)\b")).alias("is_clean"))


@query()
def fuzzy_names(t: Tables) -> DataFrame:
    """Rows 90, 108, 109: the best master entry of misspelt names; the ratio has no SQL."""
    masters = t.nation.select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"), F.array(F.substring("n_name", 1, 3)).alias("aliases"))
    asked = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.lower("n_name")).when(F.col("s_suppkey") % 3 == 1, F.substring("n_name", 2, 20)).otherwise(F.substring("n_name", 1, 3))
    return text.best_match(asked.select(raw.alias("raw")), "raw", masters).drop("ordinal")


@query(f"SELECT raw, minutes FROM {_sql_values(DURATIONS, 'raw, minutes')}")
def reviewer_durations(t: Tables) -> DataFrame:
    """Row 121: whole durations."""
    return _vectors(t, DURATIONS, "raw string, want int").select("raw", durations.reviewer_minutes(F.col("raw")).alias("minutes"))


@query("SELECT * FROM (VALUES ('Thai 90 นาที', 90), ('Oil 2 ช', 120), ('1 ชม.2', 60), ('no', NULL), ('22.5 min', 22), ('23.5 min', 24), ('x 1:30 y', 90), ('11:305', NULL)) v(raw, minutes)")
def first_durations(t: Tables) -> DataFrame:
    """Row 120: the first duration inside a line, halves to even."""
    raws = ("Thai 90 นาที", "Oil 2 ช", "1 ชม.2", "no", "22.5 min", "23.5 min", "x 1:30 y", "11:305")
    return _vectors(t, raws, "raw string").select("raw", durations.first_duration_minutes(F.col("raw")).alias("minutes"))


@query(f"SELECT raw, CAST(day AS DATE) AS day FROM {_sql_values(DATES, 'raw, day')}")
def parsed_dates(t: Tables) -> DataFrame:
    """Rows 115, 116."""
    return _vectors(t, DATES, "raw string, want string").select("raw", dates.parse_date(F.col("raw")).alias("day"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE year(o_orderdate) BETWEEN 2000 AND 2049 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE year(o_orderdate) NOT BETWEEN 2000 AND 2049")
def dates_of_orders(t: Tables) -> DataFrame:
    """Rows 115, 116 over the fixture: written day first, in the Buddhist era for odd keys."""
    buddhist = F.year("o_orderdate") + F.when(F.col("o_orderkey") % 2 == 1, 543).otherwise(0)
    raw = F.concat(F.date_format("o_orderdate", "d/M/"), buddhist.cast("string"))
    return t.orders.select("o_orderkey", F.when(F.year("o_orderdate").between(2000, 2049), dates.parse_date(raw)).alias("day"))


@query(f"SELECT raw, clock FROM {_sql_values(TIMES, 'raw, clock')}")
def parsed_times(t: Tables) -> DataFrame:
    """Row 117."""
    return _vectors(t, TIMES, "raw string, want string").select("raw", dates.parse_time(F.col("raw")).alias("clock"))


@query("SELECT * FROM (VALUES ('1:30', true), ('14:30', false), ('2.30 pm', false), ('1h30', true), ('9:15', false)) v(raw, doubtful)")
def doubtful_times(t: Tables) -> DataFrame:
    """Rows 118, 119."""
    rows = _vectors(t, ("1:30", "14:30", "2.30 pm", "1h30", "9:15"), "raw string")
    parsed = F.coalesce(dates.parse_time(F.col("raw")), F.lit("01:30"))
    return rows.select("raw", dates.looks_like_duration(F.col("raw"), parsed).alias("doubtful"))


@query("""SELECT l_orderkey, l_linenumber, q, CAST(CASE WHEN q BETWEEN 30 AND 240 OR q < 30 AND q % 5 = 0 THEN q WHEN CAST(substr(CAST(q AS VARCHAR), 1, 1) AS INT) BETWEEN 1 AND 4 THEN 60 * CAST(substr(CAST(q AS VARCHAR), 1, 1) AS INT) ELSE q END AS INT) AS minutes
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q FROM lineitem)""")
def total_repair(t: Tables) -> DataFrame:
    """Row 123."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    return rows.withColumn("minutes", dates.total_as_hours(F.col("q"), F.lit(False)))


@query("SELECT * FROM (VALUES ('2', '120'), ('90', '90'), ('6 ช', '360'), ('x', 'unparsed'), (NULL, NULL)) v(raw, minutes)")
def written_totals(t: Tables) -> DataFrame:
    """Row 124."""
    return _vectors(t, ("2", "90", "6 ช", "x", (None,)), "raw string").select("raw", dates.written_total(F.col("raw")).alias("minutes"))


@query("SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS version FROM events")
def local_times(t: Tables) -> DataFrame:
    """Rows 125, 126: local wall clock, exact microseconds."""
    return t.events.select("event_id", dates.local_text(F.col("ts").cast("timestamp")).alias("local"), dates.row_version(F.col("ts")).alias("version"))


@query("SELECT event_id, CAST(greatest(1, least(200, event_id)) AS BIGINT) AS page_size, CAST(least(3600, pow(2, least(event_id % 20, 10))) AS BIGINT) AS wait_s, CAST(floor(CASE WHEN value <= 1 THEN value * 100 ELSE value END + 0.5) AS BIGINT) AS percent FROM events")
def number_rules(t: Tables) -> DataFrame:
    """Rows 127, 128, 129."""
    return t.events.select(
        "event_id", dates.clamp(F.col("event_id"), 1, 200).alias("page_size"), dates.backoff_seconds(F.col("event_id") % 20).alias("wait_s"), dates.displayed_percent(F.col("value")).alias("percent")
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN d <> '' AND regexp_matches(d, '^[0-9]+$') THEN d END AS room FROM (SELECT l_orderkey, l_linenumber, trim(l_returnflag || ' ' || l_linenumber, ' .:-N') AS d FROM lineitem)")
def rooms(t: Tables) -> DataFrame:
    """Row 105: digits only."""
    clean = F.btrim(text.ascii_digits(F.concat("l_returnflag", F.lit(" "), "l_linenumber")), F.lit(" .:-N"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(clean.rlike("^[0-9]+$"), clean).alias("room"))


@query("SELECT doc_id, regexp_matches(t, '[A-Za-zÀ-ÿ]') AS has_value, CASE WHEN NOT regexp_matches(t, '[A-Za-zÀ-ÿ]') THEN 0.3 WHEN length(t) > 80 THEN 0.5 ELSE 0.8 END AS confidence FROM (SELECT doc_id, substr(text, 1, CAST(doc_id % 120 AS INT)) AS t FROM documents)")
def free_text_fields(t: Tables) -> DataFrame:
    """Rows 99, 104: an answer without a letter is a mark, not a value."""
    part = F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 120).cast("int"))
    letter = part.rlike(r"(?U)\p{L}")
    return t.documents.select("doc_id", letter.alias("has_value"), F.when(~letter, 0.3).when(F.length(part) > 80, 0.5).otherwise(0.8).alias("confidence"))


@query(r"SELECT doc_id, regexp_matches(text, '\p{L}') AS has_value, CASE WHEN NOT regexp_matches(text, '\p{L}') THEN 0.3 WHEN length(text) > 80 THEN 0.5 ELSE 0.8 END AS confidence FROM documents")
def whole_text_fields(t: Tables) -> DataFrame:
    """Rows 99, 104: as ``free_text_fields``, over whole texts."""
    letter = F.col("text").rlike(r"(?U)\p{L}")
    return t.documents.select("doc_id", letter.alias("has_value"), F.when(~letter, 0.3).when(F.length("text") > 80, 0.5).otherwise(0.8).alias("confidence"))


@query("SELECT doc_id, instr(text, '.') AS at, CASE WHEN instr(text, '.') > 0 THEN substr(text, 1, instr(text, '.') - 1) ELSE text END AS head FROM documents")
def split_answers(t: Tables) -> DataFrame:
    """Row 94: an answer is cut at its marker."""
    at = F.regexp_instr("text", F.lit(r"\."))
    return t.documents.select("doc_id", at.cast("long").alias("at"), F.when(at > 0, F.substring_index("text", ".", 1)).otherwise(F.col("text")).alias("head"))


@query("SELECT doc_id, substr(text, 1, 1000) AS cell FROM documents")
def truncated_cells(t: Tables) -> DataFrame:
    """Row 110: UTF-16 units; these texts have one a character."""
    return t.documents.select("doc_id", text.truncate_units(F.col("text"), 1000).alias("cell"))


# Nested documents


def _documents(t: Tables) -> DataFrame:
    """JSON documents of orders: a name, a room that may be flagged, and one treatment a line."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")))
    items = t.lineitem.groupBy("l_orderkey").agg(lines.alias("items"))
    def field(raw, value, conf, flag, source="ocr"):
        return F.struct(raw.alias("raw"), value.alias("value"), conf.alias("confidence"), (F.lit(source) if isinstance(source, str) else source).alias("source"), flag.alias("needsReview"))

    rows = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    name = field(F.col("o_orderpriority"), F.col("o_orderpriority"), F.lit(0.9), F.lit(False), F.when(F.col("o_orderkey") % 5 == 0, "human").otherwise("ocr"))
    room = field(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey").cast("string")), F.lit(0.5), F.col("o_orderkey") % 3 == 0)
    treat = F.transform("items", lambda x: field(x["l_partkey"].cast("string"), x["l_partkey"].cast("string"), x["l_quantity"] / 100, x["l_returnflag"] == "R"))
    doc = F.struct(
        F.lit(3).alias("schemaVersion"), F.struct(name.alias("name")).alias("customerInformation"), F.struct(room.alias("roomNo"), treat.alias("treatments")).alias("staffOnly")
    )
    return rows.select("o_orderkey", F.to_json(doc).alias("json"))


_ITEMS = "items AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS parts, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS flags, min(l_quantity) AS least, count(*) FILTER (l_returnflag = 'R') AS n_flag FROM lineitem GROUP BY 1)"


@query(f"""WITH {_ITEMS} SELECT o_orderkey, len(parts) + 2 AS n_leaves, n_flag + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_flagged, n_flag > 0 OR o_orderkey % 3 = 0 AS any_flag, n_flag > 0 AS any_but_room,
  array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'staffOnly.roomNo' END] || list_transform(flags, lambda f, i: CASE WHEN f = 'R' THEN 'staffOnly.treatments[' || (i - 1) || ']' END), lambda x: x IS NOT NULL), ',') AS paths
  FROM orders JOIN items ON o_orderkey = l_orderkey""")
def flagged_leaves(t: Tables) -> DataFrame:
    """Rows 22, 130, 131, 132, 135, 136, 168: leaves of canonical documents, and their flags."""
    rows = _documents(t).select("o_orderkey", review.leaves(review.canonical(F.col("json"))).alias("found"))
    paths = review.flagged_paths(F.col("found"))
    return rows.select(
        "o_orderkey", F.size("found").cast("long").alias("n_leaves"), F.size(paths).cast("long").alias("n_flagged"), review.any_flag(F.col("found")).alias("any_flag"),
        review.any_flag(F.col("found"), "staffOnly.roomNo").alias("any_but_room"), F.array_join(paths, ",").alias("paths"),
    )


@query(f"""WITH {_ITEMS} SELECT o_orderkey, least(CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.9 END, CASE WHEN o_orderkey % 3 > 0 THEN 0.5 ELSE 1.0 END, least / 100) AS confidence FROM orders JOIN items ON o_orderkey = l_orderkey""")
def least_confidences(t: Tables) -> DataFrame:
    """Rows 64, 139: a person's edit counts 1, unread leaves are skipped."""
    found = review.leaves(review.canonical(F.col("json")))
    return _documents(t).select("o_orderkey", review.least_confidence(found).alias("confidence"))


@query(f"""WITH {_ITEMS} SELECT o_orderkey, o_orderpriority AS name, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS room, CAST(parts[1] AS VARCHAR) AS treatment_1, CAST(parts[4] AS VARCHAR) AS treatment_4,
  nullif(array_to_string(parts[5:], '; '), '') AS more FROM orders JOIN items ON o_orderkey = l_orderkey""")
def flat_export(t: Tables) -> DataFrame:
    """Rows 137, 138: fixed columns of nested documents; the first treatments have their own."""
    rows = _documents(t).select("o_orderkey", *review.flat_columns(review.canonical(F.col("json")), detail=True))
    return rows.select(
        "o_orderkey", F.col("customerInformation_name").alias("name"), F.col("staffOnly_roomNo").alias("room"), "treatment_1", "treatment_4", F.col("staffOnly_treatments").alias("more")
    )


@query("""SELECT o_orderkey, 'customerInformation.name' AS field, o_orderpriority AS old_raw, upper(o_orderpriority) || '!' AS verified_value, true AS confirms FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT o_orderkey, 'staffOnly.roomNo.removed', CAST(o_orderkey AS VARCHAR), NULL, false FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def review_changes(t: Tables) -> DataFrame:
    """Rows 140, 141, 143, 166, 170: an edit and a removal as change rows, and cleared flags."""
    doc = review.canonical(F.col("json"))
    rows = _documents(t).select("o_orderkey", doc.alias("doc")).withColumn("old", review.leaves(F.col("doc")))
    name = F.col("doc.customerInformation.name")
    value = F.concat(F.upper(name["value"]), F.lit("!"))
    new = F.transform(
        F.filter("old", lambda x: x["path"] != "staffOnly.roomNo"),
        lambda x: F.struct(x["path"].alias("path"), F.when(x["path"] == "customerInformation.name", review.edited(x["field"], value)).otherwise(review.cleared(x["field"])).alias("field")),
    )
    return rows.select("o_orderkey", F.inline(review.diff(F.col("old"), new)))


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def canonical_fields(t: Tables) -> DataFrame:
    """Row 131: a field from an object, a primitive or null."""
    k = F.get_json_object("props", "$.k")
    shape = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"value": "'), k, F.lit('", "raw": "r"}'))).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    return t.events.select("event_id", review.canonical_field(shape)["value"].alias("value"))


@query("SELECT l_orderkey, CASE WHEN count(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) > 0 THEN sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) ELSE 75.0 END AS minutes FROM lineitem GROUP BY 1")
def treatment_sums(t: Tables) -> DataFrame:
    """Row 169: numeric minutes, else the written total."""
    items = F.collect_list(F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("string")).otherwise("unread"))
    return t.lineitem.groupBy("l_orderkey").agg(items.alias("items")).select("l_orderkey", review.treatment_minutes(F.col("items"), F.lit("75")).alias("minutes"))


@query("""SELECT event_id, least(0.9, CASE WHEN event_type = 'view' THEN m ELSE exp(-m) END) AS confidence, event_id % 50 = 0 OR CASE WHEN event_type = 'view' THEN m ELSE exp(-m) END < CASE event_type WHEN 'view' THEN 0.9 WHEN 'click' THEN 0.6 END OR m < 0.5 AS needs_review
  FROM (SELECT *, (event_id % 97) / 100.0 AS m FROM events WHERE event_type IN ('view', 'click'))""")
def confidence_gate(t: Tables) -> DataFrame:
    """Row 146: the model lowers a field's confidence; digits take the weakest token."""
    m = (F.col("event_id") % 97) / 100
    rows = t.events.where("event_type IN ('view', 'click')").select(
        "event_id", F.when(F.col("event_type") == "view", "date").otherwise("name").alias("kind"), F.lit(0.9).alias("confidence"), (F.col("event_id") % 50 == 0).alias("needs_review"), (-m).alias("mean_logprob"), m.alias("min_prob")
    )
    return review.apply_confidence(rows, {"date": 0.9, "name": 0.6}).select("event_id", "confidence", "needs_review")


# Evaluation


def _scores(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.col("lang").alias("field"), (F.col("quality") == 1).alias("is_right"), (F.col("toxic") == 1).alias("flagged"))


_SCORES = "scores AS (SELECT doc_id, lang AS field, quality = 1 AS is_right, toxic = 1 AS flagged FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_SCORES} SELECT field, count(*) AS n, count(*) FILTER (is_right) AS n_right, count(*) FILTER (is_right AND flagged) AS right_flagged, count(*) FILTER (NOT is_right AND flagged) AS wrong_flagged, count(*) FILTER (NOT is_right AND NOT flagged) AS wrong_unflagged FROM scores GROUP BY 1")
def quality_totals(t: Tables) -> DataFrame:
    """Rows 66, 157."""
    return quality.totals(_scores(t))


@query(f"WITH {_SCORES} SELECT CAST(count(*) FILTER (NOT is_right AND NOT flagged) AS BIGINT) AS silent FROM scores WHERE field NOT IN ('fr', 'es') AND doc_id % 10 <> 3")
def cross_field_total(t: Tables) -> DataFrame:
    """Row 67: a total with exclusions."""
    kept = quality.totals(_scores(t).where("field NOT IN ('fr', 'es') AND doc_id % 10 <> 3"))
    return kept.agg(F.coalesce(F.sum("wrong_unflagged"), F.lit(0).cast("long")).alias("silent"))


_GATE_TOTALS = "SELECT field, count(*) FILTER (r) AS n_right, count(*) FILTER (r AND f) AS rf, count(*) FILTER (NOT r AND f) AS wf, count(*) FILTER (NOT r AND NOT f) AS wu FROM"


@query(f"""WITH {_SCORES}, now AS ({_GATE_TOTALS} (SELECT field, is_right AND doc_id % 13 <> 0 AS r, flagged AS f FROM scores) GROUP BY 1), base AS ({_GATE_TOTALS} (SELECT field, is_right AS r, flagged AS f FROM scores) GROUP BY 1),
  fresh AS (SELECT field, count(*) AS n FROM scores WHERE is_right AND doc_id % 13 = 0 AND NOT flagged GROUP BY 1)
  SELECT field, coalesce(n, 0) AS newly_silent, now.wu <= base.wu AS g1, coalesce(n, 0) = 0 AS g1b, now.n_right >= base.n_right AS g2, now.rf + now.wf - base.rf - base.wf <= 5 AS g3 FROM now JOIN base USING (field) LEFT JOIN fresh USING (field)""")
def quality_gates(t: Tables) -> DataFrame:
    """Row 158: a worse run against its baseline."""
    base = _scores(t)
    now = base.withColumn("is_right", F.col("is_right") & (F.col("doc_id") % 13 != 0))
    silent = lambda rows: rows.where(~F.col("is_right") & ~F.col("flagged")).select("field", F.col("doc_id").alias("page"))
    return quality.gates(quality.totals(now), quality.totals(base), silent(now), silent(base))


@query("""WITH w AS (SELECT l_orderkey, list_sort(list(l_returnflag)) AS want, list_sort(list(l_linestatus)) AS got FROM lineitem GROUP BY 1)
  SELECT l_orderkey, want = got AS is_right, CAST(len(list_distinct(list_filter(want, lambda x: list_contains(got, x)))) AS BIGINT) AS hit, CAST(len(list_distinct(list_filter(want, lambda x: NOT list_contains(got, x)))) AS BIGINT) AS missed,
    CAST(len(list_distinct(list_filter(got, lambda x: NOT list_contains(want, x)))) AS BIGINT) AS extra FROM w""")
def list_scores(t: Tables) -> DataFrame:
    """Row 156 and the set operations: multiset equality, hits on sets."""
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("want"), F.collect_list("l_linestatus").alias("got"))
    return lists.select("l_orderkey", *(c.alias(k) for k, c in quality.list_score(F.col("want"), F.col("got")).items()))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority = '5-LOW' ELSE o_orderstatus = 'F' END AS is_right FROM orders")
def scalar_scores(t: Tables) -> DataFrame:
    """Row 156: an empty label asks for an empty reading."""
    want = F.when(F.col("o_orderstatus") == "O", " ").otherwise("F")
    got = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"), "").otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", quality.scalar_right(want, got).alias("is_right"))


@query("""SELECT event_id, 'raw' AS part FROM events WHERE value > 50 UNION ALL SELECT event_id, 'value' FROM events WHERE event_type = 'error'""")
def fidelity(t: Tables) -> DataFrame:
    """Row 155: null-equal attributes of a replay, as long rows of differences."""
    stored = t.events.select("event_id", F.col("value").alias("raw"), F.nullif("event_type", F.lit("error")).alias("value"))
    replayed = t.events.select(F.col("event_id").alias("id"), F.when(F.col("value") > 50, 0.0).otherwise(F.col("value")).alias("raw2"), F.col("event_type").alias("value2"))
    both = stored.join(replayed, F.col("event_id") == F.col("id"))
    parts = F.array(F.when(~F.col("raw").eqNullSafe(F.col("raw2")), "raw"), F.when(~F.col("value").eqNullSafe(F.col("value2")), "value"))
    return both.select("event_id", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("part"))


def _rows(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS page", "o_orderpriority AS kind", "(o_orderkey % 101) / 101D AS conf", "0.4D + (o_orderkey % 7) / 10D AS token_min", "o_orderkey % 19 = 0 AS rule", "o_custkey % 6 <> 0 AS is_right"
    )


_GRID = "grid AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97]::DOUBLE[]) AS t)"
_ROWS = "r AS (SELECT o_orderkey AS page, o_orderpriority AS kind, (o_orderkey % 101) / 101::DOUBLE AS conf, 0.4::DOUBLE + (o_orderkey % 7) / 10::DOUBLE AS token_min, o_orderkey % 19 = 0 AS rule, o_custkey % 6 <> 0 AS is_right FROM orders)"
_SWEPT = f"{_GRID}, {_ROWS}, swept AS (SELECT kind, t, count(*) FILTER (NOT is_right AND NOT (rule OR conf < t OR token_min < 0.5)) AS unflagged, count(*) FILTER (is_right AND (rule OR conf < t OR token_min < 0.5)) AS right_flagged FROM r, grid GROUP BY 1, 2)"


@query(f"WITH {_SWEPT} SELECT * FROM swept")
def threshold_sweep(t: Tables) -> DataFrame:
    """Row 159."""
    return quality.sweep(_rows(t))


@query(f"WITH {_SWEPT} SELECT kind, t AS threshold FROM swept QUALIFY row_number() OVER (PARTITION BY kind ORDER BY unflagged, right_flagged, t DESC) = 1")
def threshold_fit(t: Tables) -> DataFrame:
    """Row 160: ties go to the highest threshold."""
    return quality.fitted(quality.sweep(_rows(t)))


@query(f"""WITH {_SWEPT}, own AS (SELECT r.*, t, unflagged - CASE WHEN NOT is_right AND NOT (rule OR conf < t OR token_min < 0.5) THEN 1 ELSE 0 END AS u, right_flagged - CASE WHEN is_right AND (rule OR conf < t OR token_min < 0.5) THEN 1 ELSE 0 END AS f FROM r JOIN swept USING (kind))
  SELECT page, kind, t AS threshold, rule OR conf < t OR token_min < 0.5 AS flagged FROM own QUALIFY row_number() OVER (PARTITION BY page ORDER BY u, f, t DESC) = 1""")
def leave_one_out(t: Tables) -> DataFrame:
    """Row 161: every row judged at the threshold fitted without it."""
    return quality.leave_one_out(_rows(t)).select("page", "kind", "threshold", "flagged")


@query(f"""WITH {_ROWS}, {_GRID}, s AS (SELECT kind, page % 2 AS half, t, count(*) FILTER (NOT is_right AND NOT (rule OR conf < t OR token_min < 0.5)) AS u, count(*) FILTER (is_right AND (rule OR conf < t OR token_min < 0.5)) AS f FROM r, grid GROUP BY 1, 2, 3)
  SELECT kind, half, t AS threshold FROM s QUALIFY row_number() OVER (PARTITION BY kind, half ORDER BY u, f, t DESC) = 1""")
def two_folds(t: Tables) -> DataFrame:
    """Row 162: fits of even and odd pages."""
    rows = _rows(t).withColumn("both", F.struct("kind", (F.col("page") % 2).alias("half")))
    return quality.fitted(quality.sweep(rows, "both"), "both").select("both.kind", "both.half", "threshold")


@query(f"WITH {_SWEPT} SELECT kind, surest_wrong, silent_at FROM (SELECT kind, max(conf) AS surest_wrong FROM r WHERE NOT is_right GROUP BY 1) LEFT JOIN (SELECT kind, max(t) AS silent_at FROM swept WHERE unflagged > 0 GROUP BY 1) USING (kind)")
def threshold_margin(t: Tables) -> DataFrame:
    """Row 163."""
    rows = _rows(t)
    return quality.margin(rows, quality.sweep(rows))


def _readings(t: Tables) -> DataFrame:
    words = t.conversations.select(F.col("conv_id").alias("loop"), F.col("turn").alias("page"), F.col("role").alias("raw"), F.lit("?").alias("value"), F.substring("text", 1, 8).alias("truth"))
    return words


@query("""SELECT c.conv_id AS loop, c.turn AS page, c.role AS raw, coalesce((SELECT arg_max(substr(p.text, 1, 8), p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.role = c.role AND p.turn < c.turn), '?') AS value FROM conversations c""")
def learning_loop(t: Tables) -> DataFrame:
    """Row 164: what a page confirms changes readings of later pages only."""
    return quality.loop_replay(_readings(t)).select("loop", "page", "raw", "value")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM conversations")
def loop_invariant(t: Tables) -> DataFrame:
    """Row 165: without learning, the loop equals the stateless reading."""
    rows = _readings(t)
    loop = quality.loop_replay(rows, learn=False).select("loop", "page", "raw", "value")
    plain = rows.select("loop", "page", "raw", "value")
    differing = loop.exceptAll(plain).union(plain.exceptAll(loop)).agg(F.count("*").alias("differing"))
    return rows.agg(F.count("*").alias("n")).join(differing)  # one row each


def _whole_readings(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("loop"), F.col("turn").alias("page"), F.col("role").alias("raw"), F.lit("?").alias("value"), F.col("text").alias("truth"))


@query("""SELECT c.conv_id AS loop, c.turn AS page, c.role AS raw, coalesce((SELECT arg_max(p.text, p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.role = c.role AND p.turn < c.turn AND p.text <> ''), '?') AS value FROM conversations c""")
def whole_learning_loop(t: Tables) -> DataFrame:
    """Row 164: as ``learning_loop``, with whole texts confirmed."""
    return quality.loop_replay(_whole_readings(t)).select("loop", "page", "raw", "value")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM conversations")
def whole_loop_invariant(t: Tables) -> DataFrame:
    """Row 165: as ``loop_invariant``, with whole texts."""
    rows = _whole_readings(t)
    loop = quality.loop_replay(rows, learn=False).select("loop", "page", "raw", "value")
    plain = rows.select("loop", "page", "raw", "value")
    differing = loop.exceptAll(plain).union(plain.exceptAll(loop)).agg(F.count("*").alias("differing"))
    return rows.agg(F.count("*").alias("n")).join(differing)  # one row each
