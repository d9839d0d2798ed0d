"""The pipeline's stages on the smallest fixture and on odd tables, and the registered queries."""

from __future__ import annotations

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from quillspark.llm import queries  # noqa: E402

SF = str(TESTDATA / "sf0.001")


def test_stages_over_the_fixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {x.doc_id for x in pieces.select("doc_id").distinct().collect()} == {x.doc_id for x in docs.select("doc_id").collect()}


def test_effects_of_the_stages(spark):
    clean = [f"word{i} " + " ".join(f"w{i}x{k}" for k in range(80)) for i in range(6)]
    shared = "this very line stands in many of the documents"
    rows = [(i, f"{t}\n{shared}\nkey{i} token = abcdef0123456789{i}") for i, t in enumerate(clean)]
    rows += [(10, "too short"), (11, "again and again " * 60), (12, rows[0][1]), (13, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    got = {x.doc_id: x.text for x in docs.collect()}
    assert set(range(6)) <= set(got) and not {10, 11, 13} & set(got)
    assert shared in got[0] and all(shared not in got[i] for i in range(1, 6))
    assert all("[secret]" in got[i] and "abcdef" not in got[i] and got[i].startswith(clean[i]) for i in range(1, 6))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage(spark, docs, SF).count() == 0


def test_pipeline_is_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in queries.queries()} >= {f"op{k}" for k in range(1, 11)}
    out = corpus_pipeline.run(spark, SF)
    ends = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(x.n == x.end <= 4096 for x in ends)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.sql(queries.oracle_sql()[name])
    rows = queries.queries()[name](spark, SF).select(*sql.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(sql.fetchall())
