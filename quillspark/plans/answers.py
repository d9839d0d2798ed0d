"""Queries of answer parsing, token confidence, reading summaries and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import answers
from quillspark.operators import images, review
from quillspark.plans.registry import Tables, query
from quillspark.plans.text import _documents

@query("SELECT p_partkey, p_name AS name, CAST(30 + p_size AS INT) AS minutes, CAST(30 + p_size AS INT) AS total FROM part")
def treatment_lines(t: Tables) -> DataFrame:
    """Rows 102, 122: names, durations and totals of treatment lines of one segment; branch noise and visual aliases aren't built."""
    line = F.concat("p_name", F.lit(" "), (30 + F.col("p_size")).cast("string"), F.lit(" min"))
    parsed = t.part.select("p_partkey", answers.parse_treatments(line).alias("t"))
    return parsed.select("p_partkey", F.col("t.items")[0]["nameRaw"].alias("name"), F.col("t.items")[0]["durationMinutes"].alias("minutes"), F.col("t.totalMinutes").alias("total"))


@query("SELECT c_custkey, c_name AS name, n_name AS nationality, c_mktsegment AS hotel FROM customer JOIN nation ON c_nationkey = n_nationkey")
def customer_answers(t: Tables) -> DataFrame:
    """Rows 95, 96, 97: values behind printed labels, on one line or the next."""
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    answer = F.concat(F.lit("Name: "), "c_name", F.lit("\nNationality\n"), "n_name", F.lit("\n| Hotel Name | "), "c_mktsegment")
    found = joined.select("c_custkey", answers.section_values(answer, "customer").alias("v"))
    return found.select("c_custkey", F.col("v")["name"].alias("name"), F.col("v")["nationality"].alias("nationality"), F.col("v")["hotelName"].alias("hotel"))


@query("SELECT c_custkey, exp(-(c_custkey % 7) / 10.0) AS least, CAST(1 AS INT) AS tokens FROM customer")
def token_confidences(t: Tables) -> DataFrame:
    """Row 145: the tokens that spell a value, by byte ranges."""
    token = lambda text, lp: F.struct(F.encode(text, "UTF-8").alias("bytes"), lp.cast("double").alias("logprob"))
    tokens = F.array(token(F.lit("ชื่อ "), F.lit(-0.1)), token(F.col("c_name"), -(F.col("c_custkey") % 7) / 10), token(F.lit("."), F.lit(-3.0)))
    stats = answers.token_confidence(F.concat(F.lit("ชื่อ "), "c_name", F.lit(".")), tokens, F.col("c_name"))
    return t.customer.select("c_custkey", stats.alias("s")).select("c_custkey", F.col("s.min").alias("least"), F.col("s.tokens").alias("tokens"))


@query("""WITH i AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
  SELECT o_orderkey, CAST(n + 2 AS BIGINT) AS with_writing, CAST(n + CASE WHEN o_orderkey % 3 > 0 THEN 2 ELSE 1 END AS BIGINT) AS n_read,
    CAST(floor((90 + CASE WHEN o_orderkey % 3 > 0 THEN 50 ELSE 0 END + q) / (n + 2) + 0.5) AS BIGINT) AS percent FROM orders JOIN i ON o_orderkey = l_orderkey""")
def reading_summary(t: Tables) -> DataFrame:
    """Row 65: the mean percent of slots with writing; what wasn't read counts 0."""
    return _documents(t).select("o_orderkey", review.reading_summary(review.canonical(F.col("json"))).alias("s")).select("o_orderkey", "s.*")


@query("SELECT CAST(12 AS INT) AS pages, true AS encrypted, 1000.0 AS largest_side")
def pdf_reports(t: Tables) -> DataFrame:
    """Row 177."""
    report = "Pages:   12\nEncrypted: yes\nPage 1 size:  595.3 x 841.9 pts\nPage 2 size: 1000 x 20 pts\n"
    return t.spark.range(1).select(answers.pdf_info(F.lit(report)).alias("p")).select("p.*")


@query("SELECT v.share, v.state FROM (VALUES (0.0::DOUBLE, 'unchecked'), (0.06::DOUBLE, 'ambiguous'), (0.5::DOUBLE, 'checked')) v(share, state)")
def box_states(t: Tables) -> DataFrame:
    """Rows 150, 151, 153: the state of a tick box from its share of ink."""
    rows = t.spark.createDataFrame([(0.0,), (0.06,), (0.5,)], "share double")
    return rows.select("share", images.checkbox_state(F.col("share"), F.lit(False), F.lit(True)).alias("state"))


@query("SELECT CAST(id AS BIGINT) AS id, CAST(1 AS BIGINT) AS n, CAST(8 * (id + 1) AS INT) AS pixels FROM range(1, 5) r(id)")
def page_marks(t: Tables) -> DataFrame:
    """Rows 147, 149, 152: connected ink on pages; here bars of eight rows."""
    row = F.concat(F.repeat(F.lit("14"), F.col("id").cast("int") + 1), F.repeat(F.lit("FA"), 63 - F.col("id").cast("int")))
    blank = F.repeat(F.lit("FA"), 64)
    grey = F.unhex(F.concat(F.repeat(blank, 16), F.repeat(row, 8), F.repeat(blank, 40)))
    found = t.spark.range(1, 5).select("id", images.marks(F.lit(64), F.lit(64), grey, F.lit(6)).alias("m"))
    return found.select("id", F.size("m").cast("long").alias("n"), F.col("m")[0]["pixels"].alias("pixels"))
