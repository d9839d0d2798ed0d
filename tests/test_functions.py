"""Functions on nulls, blanks, ties and boundaries, and those that SQL can't express."""

from __future__ import annotations

import difflib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, durations, text
from quillspark.operators import batches, documents, events, quality, queue, review
from quillspark.plans.text import DATES, DURATIONS, TIMES
from quillspark.sources import tables
from quillspark.streaming import marks as streams


def one(spark, value, expr, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), DURATIONS)
def test_reviewer_durations(spark, raw, want):
    assert one(spark, raw, durations.reviewer_minutes(F.col("x"))) == want


@pytest.mark.parametrize(("raw", "want"), [*DATES, (None, None), ("", None)])
def test_dates(spark, raw, want):
    got = one(spark, raw, dates.parse_date(F.col("x")))
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize(("raw", "want"), [*TIMES, (None, None)])
def test_times(spark, raw, want):
    assert one(spark, raw, dates.parse_time(F.col("x"))) == want


@pytest.mark.parametrize(("raw", "want"), [("=1", "'=1"), ("a,b", '"a,b"'), ('-"x"', '"\'-""x"""'), (None, ""), ("", ""), ("a\r\nb", '"a\r\nb"')])
def test_csv_cells(spark, raw, want):
    assert one(spark, raw, text.csv_cell(F.col("x"))) == want


def test_truncation_never_halves_a_character(spark):
    assert one(spark, "a\U0001f600b", text.truncate_units(F.col("x"), 2)) == "a"
    assert one(spark, "a\U0001f600b", text.truncate_units(F.col("x"), 3)) == "a\U0001f600"
    assert one(spark, None, text.truncate_units(F.col("x"), 3)) is None


def test_similarity_is_the_matcher_ratio(spark):
    rows = [("พิพี", "พีพี"), (" China ", "china"), ("", ""), ("ab", "ba"), (None, "x")]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(text.similarity("a", "b").alias("s")).collect()]
    assert got == [None if a is None else difflib.SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio() for a, b in rows]


def test_best_match_takes_the_first_of_ties(spark):
    masters = spark.createDataFrame([(0, "Aroma Oil", ["AO"]), (1, "Thai", None), (2, "thai", []), (3, "Foot", ["feet"])], "ordinal int, name string, aliases array<string>")
    asked = spark.createDataFrame([("thai",), ("FEET",), ("aroma oyl",), (None,), ("--",), ("thai",)], "raw string")
    got = {r.raw: (r.name, round(r.score, 3), r.is_alias) for r in text.best_match(asked, "raw", masters).collect()}
    assert got["thai"] == ("Thai", 1.0, False) and got["FEET"] == ("Foot", 1.0, True) and got["aroma oyl"][0] == "Aroma Oil" and got["--"] == (None, 0.0, False)
    with pytest.raises(ValueError, match="at most 2"):
        text.best_match(asked, "raw", masters, most_masters=2)


def test_filters_refuse_what_they_don_t_know(spark):
    for spec in (documents.DocumentSpec(categories=("odd",)), documents.DocumentSpec(export_state="maybe"), documents.DocumentSpec(ids=tuple(range(5001)))):
        with pytest.raises(ValueError, match="not a filter"):
            documents.document_filter(spark.range(1), spec)


def test_search_takes_wild_cards_as_they_are(spark):
    rows = spark.createDataFrame([("50%_off",), ("50 off",), (None,)], "filename string")
    assert [r.filename for r in rows.where(documents.search(" %_OFF ", [F.col("filename")])).collect()] == ["50%_off"]


def test_changed_after_export_is_strict_to_the_microsecond(spark):
    docs = spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00.000001' AS updated_at FROM VALUES (1), (2), (3), (4) AS v(id)")
    marks = spark.sql("SELECT * FROM VALUES (1, 1, 'marked', timestamp_ntz'2024-01-01 00:00:00.000001'), (2, 2, 'marked', timestamp_ntz'2024-01-01'), (3, 3, 'marked', timestamp_ntz'2024-01-01'), (4, 3, 'unmarked', timestamp_ntz'2023-01-01') AS v(seq, document_id, kind, document_updated_at)")
    got = {r.id: (r.export_state, r.changed_after_export) for r in events.with_export_state(docs, marks).collect()}
    assert got == {1: ("exported", False), 2: ("exported", True), 3: ("never", False), 4: ("never", False)}


def test_rates_need_five_gaps(spark):
    rows = [("a", 10 * k) for k in range(6)] + [("b", 10 * k) for k in range(5)] + [("c", 0), ("c", 1000), ("c", 1010)]
    done = spark.createDataFrame(rows, "k string, s long").withColumn("at", F.timestamp_seconds("s"))
    assert {r.k: r.seconds_each for r in batches.completion_rate(done, "k", "at").collect()} == {"a": 10.0, "b": None, "c": None}


def test_limiter_windows_start_at_the_first_event(spark):
    rows = spark.createDataFrame([("k", s) for s in (0, 59, 60, 61, 119, 121)], "k string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = [r.allowed for r in queue.limited(rows.select("k", "at"), "k", "at", 60, 2).orderBy("at").collect()]
    assert got == [True, True, True, True, False, True]


def test_malformed_documents_become_nulls(spark):
    rows = spark.createDataFrame([('{"staffOnly": {"treatments": [{"value": "a", "needsReview": true}, null]}}',), ("{oops",), (None,), ('{"header": 7}',)], "json string")
    got = [r.p for r in rows.select(review.flagged_paths(review.leaves(review.canonical(F.col("json")))).alias("p")).collect()]
    assert got[0] == ["staffOnly.treatments[0]"] and all(not p for p in got[1:])


def test_lists_are_equal_as_multisets(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", None, "a"]), (["a", "a"], ["a"]), (None, []), ([], ["x"])], "w array<string>, g array<string>")
    got = rows.select(*(c.alias(k) for k, c in quality.list_score(F.col("w"), F.col("g")).items())).collect()
    assert [tuple(r) for r in got] == [(True, 2, 0, 0), (False, 1, 0, 0), (True, 0, 0, 0), (False, 0, 0, 1)]


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=a,b"), (2, None)], "id long, name string")
    tables.write_csv(df, f"file://{tmp_path}/csv", {"name"})
    tables.write_json_lines(df.withColumn("at", F.lit("2024-01-02").cast("timestamp")), f"file://{tmp_path}/json", ("at",))
    assert sorted(r.value for r in spark.read.option("lineSep", "\r\n").text(f"file://{tmp_path}/csv").collect()) == ['1,"\'=a,b"', "2,"]
    assert {r.at_utc for r in spark.read.json(f"file://{tmp_path}/json").collect()} == {"2024-01-02T00:00:00.000000Z"}
    assert tables.csv_header(["a", "b,c"]) == tables.BOM + 'a,"b,c"'


def test_streamed_marks_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 5, ("marked", "unmarked", "downloaded")[k % 3]) for k in range(60)], "seq long, document_id long, kind string")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = streams.latest_marks(stream).writeStream.outputMode("complete").format("memory").queryName("streamed_marks").start()
    run.processAllAvailable()
    run.stop()
    want = events.latest(rows, "document_id", "seq", ["kind"]).withColumn("s", events.export_state(F.col("kind")))
    assert {(r.document_id, r.export_state) for r in spark.table("streamed_marks").collect()} == {(r.document_id, r.s) for r in want.collect()}


def test_streamed_alerts_and_idempotency(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{k % 7}", 60 * k) for k in range(40)], "key string, s long").select("key", F.timestamp_seconds("s").alias("at"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    alerts = streams.alert_counts(read(), "at", "10 minutes", "5 minutes", "1 hour", "key").writeStream.outputMode("complete").format("memory").queryName("alerts").start()
    firsts = streams.first_results(read(), "at", "key", "1 day").writeStream.outputMode("append").format("memory").queryName("firsts").start()
    for run in (alerts, firsts):
        run.processAllAvailable()
        run.stop()
    assert spark.table("alerts").agg(F.sum("n")).first()[0] == 80 and spark.table("firsts").count() == 7
