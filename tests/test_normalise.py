"""Answers matched to master lists: odd rows, clashing names, empty lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import normalise

MASTERS = "ordinal int, name string, aliases array<string>, scope string, seed boolean"


def test_branches(spark):
    branches = [{"name": "SUKHUMVIT 3", "aliases": ["Suk. 3"]}, {"name": "SUKHUMVIT 33"}]
    texts = ["Sukhumvit๓๓", "at suk.  3", "SUKHUMVIT 333", "sukhumvit 33 or sukhumvit 3", "", None]
    got = [r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalise.branch(F.col("t"), branches).alias("b")).collect()]
    assert [(b.value, b.confidence) for b in got] == [("SUKHUMVIT 33", 1.0), ("SUKHUMVIT 3", 0.95), (None, 0.0), ("SUKHUMVIT 3", 1.0), (None, 0.0), (None, 0.0)]
    assert not any(b.needsReview for b in got)
    plain = spark.createDataFrame([("ไทย 1 ชม. Ploenchit (仅限员工) Suk. 3",), (None,)], "t string").select(normalise.without_print(F.col("t"), branches).alias("p")).collect()
    assert plain[0].p.split() == ["ไทย", "1", "ชม."] and plain[1].p is None


def test_odd_answers_and_clashing_names(spark):
    masters = spark.createDataFrame([(0, "Thai", ["TH"], None, False), (1, "Chinese", ["China", "中國"], None, False)], MASTERS)
    rows = spark.createDataFrame([(1, "thia", "x"), (2, "中國 China", "x"), (3, "Thai or Chinese or so", "x"), (4, None, "x"), (5, "", "x"), (6, "TH", "x"), (6, "TH", "x")], "_raw int, raw string, name string")
    out = normalise.nationality(rows, "raw", masters, "field")
    assert out.columns == ["_raw", "raw", "name", "field"]
    got = sorted((r._raw, r.field.value, r.field.confidence, r.field.needsReview) for r in out.collect())
    assert got[1:] == [(2, "Chinese", 0.8, True), (3, "Thai or Chinese or so", 0.5, True), (4, None, 0.0, True), (5, "", 0.5, True), (6, "Thai", 1.0, False), (6, "Thai", 1.0, False)]
    assert got[0] == (1, "thia", 0.5, True)


def test_therapists(spark):
    masters = spark.createDataFrame([(0, "Inn", [], "A", True), (1, "Inn", [], "B", False), (2, "Pop", ["Pope"], "", False)], MASTERS)
    rows = spark.createDataFrame([(1, "inn / pop", "A"), (2, "inn", "B"), (3, "Pope & zzz", "B"), (4, " . ", "A"), (5, None, "A"), (6, "pop.", None), (7, "", None), (8, "pop", ""), (9, "inn", None)], "k int, raw string, branch string")
    got = {r.k: (r.f.value, r.f.confidence, r.f.needsReview) for r in normalise.therapist(rows, "raw", "branch", masters, "f").collect()}
    assert got[1] == ("Inn / Pop", 0.8, True) and got[2] == ("Inn", 1.0, False) and got[3] == ("Pop / zzz", 0.0, True)
    assert got[4][0] is None and got[5] == got[7] == (None, 0.0, True) and got[6] == got[8] == ("Pop", 1.0, False)
    assert got[9] == ("Inn", 0.8, True)
    empty = normalise.therapist(rows, "raw", "branch", masters.limit(0), "f").collect()
    assert len(empty) == 9 and all(r.f.needsReview for r in empty)


def test_treatments(spark):
    masters = spark.createDataFrame([(0, "Thai massage", ["ไทย"], None, False), (1, "Oil", [], None, False)], MASTERS)
    rows = spark.createDataFrame([("ไทย",), ("OIL",), ("Thai masage",), ("zz",), (None,), ("",)], "raw string")
    got = {r.raw: (r.f.value, r.f.source, r.f.needsReview) for r in normalise.treatment(rows, "raw", masters, "f").collect()}
    assert got["ไทย"] == ("Thai massage", "rule", False) and got["OIL"] == ("Oil", "master-fuzzy", False) and got["Thai masage"] == ("Thai massage", "master-fuzzy", False)
    assert got["zz"] == (None, "master-fuzzy", True) and got[None] == (None, "none", True) and got[""][0] is None
