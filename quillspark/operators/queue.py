"""Queue transitions as functions of a table of jobs: there are no row locks, so each is one batch step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import backoff_seconds

# Seconds of a lease, of a retry's delay and of an outbox row's recovery.
LEASE_S, RETRY_S, RECOVER_S = 120, 5, 120


def after(ts: Column, seconds: Column | int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds) if isinstance(seconds, int) else seconds, ts)


def claimable(now: Column) -> Column:
    return (F.col("status") == "PENDING") & (F.col("available_at") <= now)


def claim(jobs: DataFrame, now: Column, count: int = 1) -> DataFrame:
    """The next jobs: by priority, time and id, with a lease and one attempt more."""
    first = jobs.where(claimable(now)).orderBy(F.desc("priority"), "available_at", "id").limit(count)
    return first.withColumns({"status": F.lit("RUNNING"), "attempts": F.col("attempts") + 1, "lease_expires_at": after(now, LEASE_S)})


def finished(ok: Column, now: Column) -> dict[str, Column]:
    """Status and time after a run: done, again in five seconds while attempts are left, else dead."""
    again = F.col("attempts") < F.col("max_attempts")
    return {
        "status": F.when(ok, "SUCCEEDED").when(again, "PENDING").otherwise("DEAD"),
        "available_at": F.when(~ok & again, after(now, RETRY_S)).otherwise(F.col("available_at")),
    }


def recovered(now: Column) -> Column:
    """Status after expired leases are taken back."""
    lost = (F.col("status") == "RUNNING") & (F.col("lease_expires_at") <= now)
    return F.when(lost, "PENDING").otherwise(F.col("status"))


def outbox_finished(ok: Column, now: Column) -> dict[str, Column]:
    """Outbox rows after a delivery: attempts were counted at the claim, failures wait twice as long each time."""
    dead = F.col("attempts") >= F.col("max_attempts")
    return {
        "status": F.when(ok, "DELIVERED").when(dead, "DEAD").otherwise("RETRY"),
        "next_attempt_at": F.when(ok | dead, F.col("next_attempt_at")).otherwise(after(now, backoff_seconds(F.col("attempts")))),
    }


def round_state(stopped: Column, cap: Column, done: Column, in_flight: Column) -> Column:
    """Stopped wins; then a round is full when what is done and in flight reaches its cap."""
    return F.when(stopped.isNotNull(), "stopped").when(cap.isNotNull() & (done + in_flight >= cap), "round_full").otherwise("reading")


def fan_out(parents: DataFrame, parent: str = "id", pages: str = "page_count", at: str = "created_at") -> DataFrame:
    """One row a page, with its deterministic id and a time that orders pages by microseconds."""
    rows = parents.where(F.col(pages) > 0).withColumn("page_number", F.explode(F.sequence(F.lit(1), F.col(pages))))
    child = F.substring(F.sha2(F.concat_ws(":", F.lit("page"), F.col(parent).cast("string"), F.col("page_number").cast("string")), 256), 1, 32)
    return rows.withColumns({"child_id": child, "available_at": F.timestamp_add("MICROSECOND", F.col("page_number"), F.col(at))})


def limited(events: DataFrame, key: str, at: str, window_s: int, most: int) -> DataFrame:
    """Which events a limiter admits: windows are anchored at a key's first event after the last window, not at clock times.

    A key's windows depend on each other, so its events are folded in order; the state is two numbers, and rows
    stream through, so a key of any size needs no memory.
    """
    schema = events.select(key, at).withColumn("allowed", F.lit(True)).schema

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, opened, count = object(), None, 0
        for frame in frames:
            flags = []
            for k, ts in zip(frame[key], frame[at], strict=True):
                if k != last or (ts - opened).total_seconds() >= window_s:
                    last, opened, count = k, ts, 0
                count += 1
                flags.append(count <= most)
            yield frame.assign(allowed=flags)

    return events.select(key, at).repartition(key).sortWithinPartitions(key, at).mapInPandas(fold, schema)
