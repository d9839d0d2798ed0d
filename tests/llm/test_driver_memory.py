"""Tables that grow with the input never pass through the driver as broadcasts, and plans stay small there."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("xxhash")
from quillspark.llm import components, near_copies, simhash  # noqa: E402
from quillspark.llm.common import materialise, probable  # noqa: E402


def test_joins_of_simhash_are_not_broadcast(spark, tmp_path):
    prints = spark.range(40).select((F.col("id") % 8).alias("fp"), F.col("id").alias("rep"))
    edges = spark.range(40).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("same text "), F.col("id") % 3).alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    made = {
        "links": simhash.links(prints),
        "stars": simhash.stars(prints),
        "large star": components._large_star(edges),
        "small star": components._small_star(edges),
        "near duplicates": simhash.near_duplicates(docs),
        "one of copies": simhash.keep_one(docs),
    }
    for name, table in made.items():
        table.collect()
        # Each plan is small enough for a broadcast, and is the one that ran.
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString(), name


def test_plans_read_a_bitmap_and_do_not_hold_how_it_was_filled(spark):
    held = spark.range(50).select(F.xxhash64("id").alias("h"))
    found = spark.range(5000).where(probable(held, "h")(F.xxhash64("id")))
    ids = {r["id"] for r in found.collect()}
    assert set(range(50)) <= ids and len(ids) < 1000
    plan = found._jdf.queryExecution().toString()
    assert "scalar-subquery" in plan and "Exchange" not in plan and "Aggregate" not in plan


def test_counts_reach_the_driver_in_few_jobs(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of six words "), "id").alias("text"))
    seen = materialise(near_copies._sets(docs.repartition(3)), "sets")
    frame = type(seen)
    dealt = frame.repartition
    want = near_copies._sketch(seen)
    monkeypatch.setattr(frame, "repartition", lambda self, n, *columns: dealt(self, max(n, 60), *columns))
    spark.sparkContext.setJobGroup("sketch", "sketch")
    try:
        got = near_copies._sketch(seen)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (got == want).all() and got.sum() == 80
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sketch")) <= 2 * near_copies._SLOTS


def test_few_edges_take_few_plans(spark, monkeypatch):
    far = 1 << 40
    rows = [(k, k + 1) for k in range(60)] + [(far + (7 * k) % 61, far + (7 * k + 7) % 61) for k in range(60)] + [(-5, -5), (None, 3), (-9, -7), (-7, -9)]
    edges = spark.createDataFrame(rows, "u long, v long")
    want = sorted([(k, 0) for k in range(1, 61)] + [(far + k, far) for k in range(1, 61)] + [(-7, -9)])
    kept, plans = components.checkpointed, []
    monkeypatch.setattr(components, "checkpointed", lambda df: plans.append(df) or kept(df))
    assert sorted(map(tuple, components.connected_components(edges).collect())) == want
    assert len(plans) == 2
    # More edges than one task takes go through rounds of stars, until few are left or nothing changes.
    monkeypatch.setattr(components, "LOCAL_EDGES", 10)
    assert sorted(map(tuple, components.connected_components(edges).collect())) == want
    assert len(plans) > 5
    assert components.connected_components(edges.where("u > v + 100")).count() == 0
