"""Quality evaluation: score rows, totals, gates, threshold sweeps, cross-validation and the learning-loop replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the grid of thresholds.
GRID = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97)


def list_score(want: Column, got: Column) -> dict[str, Column]:
    """Lists are right if equal as multisets once nulls are dropped; hits are counted on sets."""
    clean = lambda a: F.sort_array(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    w, g = clean(want), clean(got)
    return {
        "is_right": w == g,
        "hit": F.size(F.array_intersect(w, g)).cast("long"),
        "missed": F.size(F.array_except(w, g)).cast("long"),
        "extra": F.size(F.array_except(g, w)).cast("long"),
    }


def scalar_right(want: Column, got: Column) -> Column:
    """An empty label asks for an empty reading."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(want), blank(got)).otherwise(F.coalesce(want == got, F.lit(False)))


def totals(rows: DataFrame, by: str = "field") -> DataFrame:
    """Buckets of (right, flagged): ``right`` holds ``right_flagged``, so n is right and both wrong ones."""
    right, flag = F.col("is_right"), F.col("flagged")
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(right).alias("n_right"),
        F.count_if(right & flag).alias("right_flagged"),
        F.count_if(~right & flag).alias("wrong_flagged"),
        F.count_if(~right & ~flag).alias("wrong_unflagged"),
    )


def gates(now: DataFrame, base: DataFrame, pages_now: DataFrame, pages_base: DataFrame, by: str = "field", review_budget: int = 5) -> DataFrame:
    """Per field, regressions against a baseline: silent errors, newly silent pages, flags over budget. ``pages_*``: field, page."""
    fresh = pages_now.join(pages_base, [by, "page"], "left_anti").groupBy(by).agg(F.count("*").alias("newly_silent"))
    old = base.select(by, *(F.col(c).alias(f"base_{c}") for c in ("n_right", "right_flagged", "wrong_flagged", "wrong_unflagged")))
    joined = now.join(old, by).join(fresh, by, "left").withColumn("newly_silent", F.coalesce("newly_silent", F.lit(0).cast("long")))
    reviews = F.col("right_flagged") + F.col("wrong_flagged") - F.col("base_right_flagged") - F.col("base_wrong_flagged")
    return joined.select(
        by, "newly_silent",
        (F.col("wrong_unflagged") <= F.col("base_wrong_unflagged")).alias("g1"),
        (F.col("newly_silent") == 0).alias("g1b"),
        (F.col("n_right") >= F.col("base_n_right")).alias("g2"),
        (reviews <= review_budget).alias("g3"),
    )


def sweep(rows: DataFrame, kind: str = "kind", grid: tuple[float, ...] = GRID, token_floor: float = 0.5) -> DataFrame:
    """Per kind and threshold, silent errors and flagged right rows: each row meets the fixed grid, and sums combine before they move."""
    at = rows.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    flag = F.col("rule") | (F.col("conf") < F.col("t")) | (F.col("token_min") < token_floor)
    return at.groupBy(kind, "t").agg(F.count_if(~F.col("is_right") & ~flag).alias("unflagged"), F.count_if(F.col("is_right") & flag).alias("right_flagged"))


def fitted(swept: DataFrame, kind: str = "kind") -> DataFrame:
    """The best threshold: fewest silent errors, then fewest needless flags, of ties the highest."""
    return swept.groupBy(kind).agg(F.min_by("t", F.struct("unflagged", "right_flagged", -F.col("t"))).alias("threshold"))


def leave_one_out(rows: DataFrame, kind: str = "kind", grid: tuple[float, ...] = GRID, token_floor: float = 0.5) -> DataFrame:
    """Each row judged at the threshold fitted without it: grid totals are sums, so a row's own share is taken off, with no n-fold loop."""
    swept = sweep(rows, kind, grid, token_floor)
    curve = swept.groupBy(kind).agg(F.sort_array(F.collect_list(F.struct("t", "unflagged", "right_flagged"))).alias("curve"))
    judged = rows.join(F.broadcast(curve), kind)  # one row a kind

    def flag_at(t: Column) -> Column:
        return F.col("rule") | (F.col("conf") < t) | (F.col("token_min") < token_floor)

    def cost(p: Column) -> Column:
        silent = (~F.col("is_right") & ~flag_at(p["t"])).cast("long")
        needless = (F.col("is_right") & flag_at(p["t"])).cast("long")
        return F.struct((p["unflagged"] - silent).alias("u"), (p["right_flagged"] - needless).alias("r"), (-p["t"]).alias("m"))

    best = F.array_min(F.transform("curve", cost))
    out = judged.withColumn("threshold", -best["m"])
    return out.withColumn("flagged", flag_at(F.col("threshold"))).drop("curve")


def margin(rows: DataFrame, swept: DataFrame, kind: str = "kind") -> DataFrame:
    """Per kind, the most confident wrong row, and the highest grid point at which some error goes silent."""
    surest = rows.where(~F.col("is_right")).groupBy(kind).agg(F.max("conf").alias("surest_wrong"))
    silent = swept.where("unflagged > 0").groupBy(kind).agg(F.max("t").alias("silent_at"))
    return surest.join(silent, kind, "left")


def loop_replay(rows: DataFrame, learn: bool = True) -> DataFrame:
    """``loop, page, raw, value`` with the value each reading gets when confirmations teach later pages of its loop.

    What page p confirms changes readings of later pages only, so pages of a loop are folded in order; loops run
    in parallel, rows stream through, and the memory is the loop's distinct confirmed readings. Without ``learn``
    nothing is taught, and the result equals the stateless reading.
    """
    schema = "loop long, page long, raw string, value string, from_memory boolean"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loop, page = object(), None
        known: dict[str, str] = {}
        pending: dict[str, str] = {}
        for frame in frames:
            out = []
            for at, p, raw, value, truth in frame[["loop", "page", "raw", "value", "truth"]].itertuples(index=False, name=None):
                if at != loop:
                    loop, page, known, pending = at, p, {}, {}
                if p != page:
                    known.update(pending)
                    page, pending = p, {}
                learned = known.get(raw)
                out.append((at, p, raw, value if learned is None else learned, learned is not None))
                if learn and raw and truth:
                    pending[raw] = truth
            yield pd.DataFrame(out, columns=["loop", "page", "raw", "value", "from_memory"])

    dealt = rows.select("loop", "page", "raw", "value", "truth").repartition("loop").sortWithinPartitions("loop", "page", "raw", "value", "truth")
    return dealt.mapInPandas(fold, schema)
