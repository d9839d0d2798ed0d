"""Small driver-side files: master data, calibrations and frozen baselines; a file that breaks a rule is refused whole."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A calibration moves a threshold at most so far from the one in force.
MAX_MOVE = 0.05
_LAST_GOOD: dict[str, dict[str, list[dict]]] = {}


def _valid(data: object) -> dict[str, list[dict]]:
    if not isinstance(data, dict):
        raise ValueError("master data is an object of lists")
    for kind, entries in data.items():
        if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
            raise ValueError(f"{kind} is a list of objects")
        for e in entries:
            name = e.get("name", e.get("value"))
            if not isinstance(name, str) or not name.strip() or not all(isinstance(a, str) for a in e.get("aliases", [])):
                raise ValueError(f"an entry of {kind} has a name and texts as aliases")
    return data


def load_masters(path: str) -> dict[str, list[dict]]:
    """Master lists by kind; a broken file leaves the last good one in force, and raises when there is none."""
    try:
        _LAST_GOOD[path] = _valid(json.loads(Path(path).read_text(encoding="utf-8")))
    except (OSError, ValueError):
        if path not in _LAST_GOOD:
            raise
    return _LAST_GOOD[path]


def master_frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """``ordinal, name, aliases`` as ``best_match`` takes them."""
    rows = [(k, e.get("name", e.get("value")), e.get("aliases", [])) for k, e in enumerate(entries)]
    return spark.createDataFrame(rows, "ordinal int, name string, aliases array<string>")


def load_calibration(text: str, in_force: dict[str, float]) -> dict[str, float]:
    """New thresholds by kind: known kinds, recorded evidence, the value in force named, a small move."""
    out = {}
    for kind, entry in json.loads(text).get("thresholds", {}).items():
        if kind not in in_force or not str(entry.get("acceptedBecause") or "").strip():
            raise ValueError(f"{kind} is no kind, or lacks evidence")
        new, old = entry.get("reviewBelow"), entry.get("movedFrom")
        if not all(isinstance(x, (int, float)) and 0 <= x <= 1 for x in (new, old)):
            raise ValueError(f"{kind} has no thresholds")
        if abs(old - in_force[kind]) > 1e-9 or abs(new - old) > MAX_MOVE + 1e-9:
            raise ValueError(f"{kind} moves from another value, or too far")
        out[kind] = float(new)
    return out


def write_baseline(totals: DataFrame, path: str) -> None:
    """Counts by field as one small file; there are as many rows as fields."""
    rows = sorted((r.asDict() for r in totals.collect()), key=lambda r: r["field"])
    Path(path).write_text("[fields]\n" + "".join(json.dumps(r, sort_keys=True) + "\n" for r in rows), encoding="utf-8")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    lines = Path(path).read_text(encoding="utf-8").splitlines()
    if not lines or lines[0] != "[fields]":
        raise ValueError("not a baseline")
    names = ("n", "n_right", "right_flagged", "wrong_flagged", "wrong_unflagged")
    rows = [json.loads(x) for x in lines[1:] if x.strip()]
    return spark.createDataFrame([(r["field"], *(r[k] for k in names)) for r in rows], "field string, " + ", ".join(f"{k} long" for k in names))
