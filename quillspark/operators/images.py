"""Marks on scanned pages: ink masks, connected components, shapes and states, on raw grey arrays.

Pages arrive as height, width and bytes of grey samples (no image decoder is installed here). Each page is
one row of a pandas UDF, so pages run in parallel and memory is bounded by an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

# Ink counts of empty and of written boxes, and shares of marked ones.
EMPTY_MOST, WRITTEN_LEAST = 25, 60
UNCHECKED_MOST, CHECKED_LEAST = 0.04, 0.10
REACH = 2

MARK = StructType([StructField(k, t) for k, t in (("x0", IntegerType()), ("y0", IntegerType()), ("x1", IntegerType()), ("y1", IntegerType()), ("pixels", IntegerType()), ("kind", StringType()), ("confidence", DoubleType()))])


def ink_mask(grey: np.ndarray, contrast: int = 40) -> np.ndarray:
    """Samples darker than the paper around them: the paper is the brightest tenth of each row band."""
    bands = [grey[k : k + 32] for k in range(0, len(grey), 32)]
    return np.concatenate([b < max(0, np.percentile(b, 90) - contrast) for b in bands]) if bands else grey < 0


def components(mask: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Labels of connected ink, gaps under ``reach`` bridged: runs of each row are united with those of rows before."""
    labels, parent = np.zeros(mask.shape, np.int64), [0]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for y in range(len(mask)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        last_end, last = -reach - 1, 0
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            near = labels[max(0, y - reach) : y, max(0, lo - reach) : hi + reach]
            touched = {root(int(k)) for k in np.unique(near) if k}
            if lo - last_end < reach:
                touched.add(root(last))
            k = min(touched) if touched else len(parent)
            if not touched:
                parent.append(k)
            for other in touched:
                parent[other] = k
            labels[y, lo:hi], last_end, last = k, hi, k
    return np.array([root(k) for k in range(len(parent))])[labels]


def shape_of(ys: np.ndarray, xs: np.ndarray) -> tuple[str, float]:
    """Circle or cross: a ring has ink all round and none inside, a cross lies on its box's diagonals."""
    if np.ptp(ys) < 5 or np.ptp(xs) < 5:
        return "mark", 0.3
    v = (ys - (ys.min() + ys.max()) / 2) / (np.ptp(ys) / 2)
    u = (xs - (xs.min() + xs.max()) / 2) / (np.ptp(xs) / 2)
    far = np.hypot(u, v)
    around = len(np.unique((np.arctan2(v, u)[far > 0.6] + np.pi) // (np.pi / 6) % 12)) / 12
    ring = around * (1 - min(1.0, 4 * float((far < 0.4).mean())))
    on_diagonal = float((np.abs(np.abs(u) - np.abs(v)) < 0.3).mean())
    arms = len({(a, b) for a, b in zip(u[far > 0.6] > 0, v[far > 0.6] > 0, strict=True)}) / 4
    cross = max(0.0, min(1.0, (on_diagonal - 0.35) / 0.35)) * arms
    sure = min(0.98, 0.5 + abs(ring - cross) / 2)
    return ("circle" if ring >= cross else "cross"), round(sure if len(xs) >= 40 else min(sure, 0.6), 3)


@pandas_udf(ArrayType(MARK))
def marks(height: pd.Series, width: pd.Series, grey: pd.Series, least: pd.Series) -> pd.Series:
    """Every connected mark of at least ``least`` pixels; a null or short page has none."""
    def page(h: int, w: int, data: bytes | None, n: int) -> list[dict]:
        if not data or not h or len(data) < h * w:
            return []
        found = components(ink_mask(np.frombuffer(data, np.uint8, h * w).reshape(h, w)))
        out = []
        for k in np.unique(found[found > 0]):
            ys, xs = np.nonzero(found == k)
            if len(ys) >= n:
                kind, confidence = shape_of(ys, xs)
                out.append({"x0": int(xs.min()), "y0": int(ys.min()), "x1": int(xs.max()), "y1": int(ys.max()), "pixels": len(ys), "kind": kind, "confidence": confidence})
        return out

    return pd.Series([page(*row) for row in zip(height, width, grey, least, strict=True)])


def text_state(pixels: Column) -> Column:
    return F.when(pixels <= EMPTY_MOST, "empty").when(pixels >= WRITTEN_LEAST, "present").otherwise("uncertain")


def checkbox_state(share: Column, struck: Column, readable: Column) -> Column:
    """A box's state from its share of ink; a struck one was marked and taken back."""
    filled = F.when(share < UNCHECKED_MOST, "unchecked").when(share >= CHECKED_LEAST, "checked").otherwise("ambiguous")
    return F.when(~readable, "unreadable").when(struck, "struck").otherwise(filled)


def checkbox_field(state: Column, label: Column, confidence: Column) -> Column:
    """The field of a box: only a clear state needs no review."""
    return F.struct(
        label.alias("raw"), F.when(state == "checked", label).alias("value"), confidence.alias("confidence"), F.lit("checkbox").alias("source"),
        (~state.isin("checked", "unchecked")).alias("needsReview"), (state == "checked").alias("checked"),
    )
