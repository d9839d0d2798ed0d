"""Queries do the whole job: rows, matches and texts as they stand in the fixture."""

from __future__ import annotations

import duckdb
import pytest
from conftest import TESTDATA

from quillspark.plans import ORACLES, QUERIES

SF = TESTDATA / "sf0.001"
#: Its date filter leaves no order of any fixture; ``confidence_places`` ranks all orders.
VACUOUS = {"confidence_ranking"}


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for file in sorted(SF.glob("*.parquet")):
        found.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return found


@pytest.mark.parametrize("name", sorted(set(ORACLES) - VACUOUS))
def test_sql_gives_rows(con, name):
    assert con.sql(ORACLES[name]).fetchall()


def test_every_order_has_a_place(spark, con):
    n = con.sql("SELECT count(*) FROM orders").fetchall()[0][0]
    assert n > 0 and sorted(x.place for x in QUERIES["confidence_places"](spark, str(SF)).collect()) == list(range(1, n + 1))


def test_names_are_found(spark):
    names = [x.name for x in QUERIES["labels_by_known_name"](spark, str(SF)).collect()]
    assert "unknown" in names and len(set(names)) > 2
    hits = {x.wanted: x.first_customer for x in QUERIES["known_names_lookup"](spark, str(SF)).collect()}
    assert hits["nowhere"] is None and None not in (hits["NATION_6"], hits["NATION_18"])


def test_texts_are_whole(spark, con):
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    cells = {x.doc_id: x.cell for x in QUERIES["whole_csv_cells"](spark, str(SF)).collect()}
    assert len(cells) == len(texts) and all(len(cells[i]) >= len(t) for i, t in texts.items() if t)
    fields = {x.doc_id: x.confidence for x in QUERIES["whole_text_fields"](spark, str(SF)).collect()}
    assert any(c == 0.5 for c in fields.values()) and all(fields[i] != 0.8 for i, t in texts.items() if t and len(t) > 80)
    said = {x[0] for x in con.sql("SELECT text FROM conversations").fetchall()}
    learned = {x.value for x in QUERIES["whole_learning_loop"](spark, str(SF)).collect()} - {"?"}
    assert learned <= said and max(map(len, learned)) > 8


def test_every_part_has_a_place(spark, con):
    n = con.sql("SELECT count(*) FROM part").fetchall()[0][0]
    assert n > 100 and sorted(x.place for x in QUERIES["thai_places"](spark, str(SF)).collect()) == list(range(1, n + 1))
