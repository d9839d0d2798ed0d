"""Answer parsing, token alignment, masters and marks, on small made-up answers."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import answers
from quillspark.operators import images, quality
from quillspark.sources import masters


def test_sections(spark):
    rows = spark.createDataFrame([("Treatment: Thai 60 min\nTherapist Name\nAnn\nRoom No. ☐ 11",), ("Room No. ☐1 ☐2 ☒3",), ("Treatment\nRoom No. 5",), (None,), ("",)], "a string")
    got = [r.v for r in rows.select(answers.section_values(F.col("a"), "staff").alias("v")).collect()]
    assert got[0] == {"treatment": "Thai 60 min", "therapist": "Ann", "room": "11"}
    assert got[1]["room"] is None and got[2] == {"treatment": None, "therapist": None, "room": "5"} and got[3] is None
    assert answers.labelled("Name: Kaname\nHotel Nikko stays\nNationality | Thai", answers.LABELS["customer"])["nationality"] == "Thai"


@pytest.mark.parametrize(("line", "names", "minutes", "total"), [
    ("Thai 60 min + Oil 1h30", ["Thai", "Oil"], [60, 90], 150), ("2 คน ออย 90 นาที", ["ออย"], [90], 90), ("Foot, 45 m", ["Foot"], [45], 45),
    ("Thai = 90", ["Thai"], [90], 90), ("Aroma 1 ชั่วโมงครึ่ง = 2", ["Aroma"], [90], 120), ("", [], [], None), ("Scrub", ["Scrub"], [None], None),
])
def test_treatment_lines(line, names, minutes, total):
    got = answers.treatment_line(line)
    assert [i["nameRaw"] for i in got["items"]] == names and [i["durationMinutes"] for i in got["items"]] == minutes and got["totalMinutes"] == total


def test_treatment_flags(spark):
    wrong = answers.treatment_line("Thai 60 min + Oil 30 min = 120")
    assert wrong["warnings"] == ["written total 120 is not 90"] and all(i["needsReview"] for i in wrong["items"])
    rows = spark.createDataFrame([("2 pax Thai 1:30",), (None,)], "x string").select(answers.parse_treatments("x").alias("t")).collect()
    assert rows[0].t["items"][0].guests == 2 and rows[0].t.totalMinutes == 90 and rows[1].t["items"] == []


def test_restatements():
    assert answers.without_restatement("นวดไทย (นวดไทย)") == ("นวดไทย", "นวดไทย")
    assert answers.without_restatement("นวดไทย (สครับผิว)")[1] is None and answers.without_restatement("ไทย (5)")[1] is None


def test_token_spans(spark):
    text = "ไทย 90 min"
    raw = text.encode()
    whole = [(raw[:4], -0.1), (raw[4:9], -0.2), (raw[9:], -0.5)]
    assert [b[:2] for b in answers.token_bounds(raw, whole)] == [(0, 4), (4, 9), (9, len(raw))]
    damaged = [(b"", -0.3), ("�".encode(), -0.4), (raw[3:], -0.1)]
    assert answers.token_bounds(raw, damaged)[-1][:2] == (3, len(raw)) and answers.token_bounds(raw, [(b"zzz", 0.0)]) is None
    got = answers.value_stats("Room 33 / 3", [(b"Room ", -1.0), (b"33", -0.7), (b" / ", -0.1), (b"3", -0.2)], "3")
    assert got == {"mean": math.exp(-0.2), "min": math.exp(-0.2), "tokens": 1}
    rows = spark.createDataFrame([("ab", [(bytearray(b"ab"), -0.5)], "ab"), (None, None, "x")], "a string, t array<struct<bytes: binary, logprob: double>>, v string")
    out = [r.s for r in rows.select(answers.token_confidence("a", "t", "v").alias("s")).collect()]
    assert out[0].tokens == 1 and out[1].tokens is None


def test_pdf_report(spark):
    report = "Title: x\nPages:   12\nEncrypted: yes (print)\nPage 1 size:  595.3 x 841.9 pts\nPage 2 size: 1000 x 20 pts\n"
    got = spark.createDataFrame([(report,), ("",)], "x string").select(answers.pdf_info(F.col("x")).alias("p")).collect()
    assert tuple(got[0].p) == (12, True, 1000.0) and tuple(got[1].p) == (None, False, None)


def test_masters_and_calibrations(spark, tmp_path):
    path = tmp_path / "m.json"
    with pytest.raises(OSError):
        masters.load_masters(str(path))
    path.write_text(json.dumps({"branches": [{"name": "A", "aliases": ["a"]}]}))
    good = masters.load_masters(str(path))
    path.write_text('{"branches": [{"name": ""}]}')
    assert masters.load_masters(str(path)) == good and masters.master_frame(spark, good["branches"]).count() == 1
    move = lambda **x: json.dumps({"thresholds": {"date": {"acceptedBecause": "held out", "reviewBelow": 0.88, "movedFrom": 0.9} | x}})
    assert masters.load_calibration(move(), {"date": 0.9}) == {"date": 0.88}
    for bad in ({"reviewBelow": 0.5}, {"movedFrom": 0.8}, {"acceptedBecause": " "}, {"reviewBelow": None}):
        with pytest.raises(ValueError):
            masters.load_calibration(move(**bad), {"date": 0.9})


def test_baseline_round_trip(spark, tmp_path):
    rows = quality.totals(spark.createDataFrame([("f", True, False), ("f", False, True), ("g", True, True)], "field string, is_right boolean, flagged boolean"))
    masters.write_baseline(rows, str(tmp_path / "b"))
    assert sorted(map(tuple, masters.read_baseline(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, rows.collect()))


def test_marks_on_a_page(spark):
    page = np.full((96, 160), 250, np.uint8)
    y, x = np.mgrid[:96, :160]
    page[np.abs(np.hypot(y - 40, x - 40) - 20) < 2] = 20
    for d in range(-18, 19):
        page[50 + d, 110 + d : 113 + d] = page[50 + d, 110 - d : 113 - d] = 20
    page[90, 5] = 10
    rows = spark.createDataFrame([(96, 160, bytearray(page.tobytes())), (None, None, None), (9, 9, bytearray(b"x"))], "h int, w int, g binary")
    got = [r.m for r in rows.select(images.marks("h", "w", "g", F.lit(6)).alias("m")).collect()]
    assert sorted(m.kind for m in got[0]) == ["circle", "cross"] and got[1] == got[2] == []


def test_box_states(spark):
    rows = spark.createDataFrame([(0.0, False, True, 10), (0.06, False, True, 40), (0.3, False, True, 60), (0.3, True, True, 25), (0.3, False, False, 26)], "s double, k boolean, r boolean, n int")
    state = images.checkbox_state(F.col("s"), F.col("k"), F.col("r"))
    got = rows.select(state.alias("a"), images.text_state(F.col("n")).alias("b"), images.checkbox_field(state, F.lit("L"), F.col("s")).alias("f")).collect()
    assert [r.a for r in got] == ["unchecked", "ambiguous", "checked", "struck", "unreadable"]
    assert [r.b for r in got] == ["empty", "uncertain", "present", "empty", "uncertain"]
    assert [r.f.needsReview for r in got] == [False, True, False, True, True] and got[2].f.value == "L"
