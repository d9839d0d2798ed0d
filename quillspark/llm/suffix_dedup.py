"""Suffix-array dedup: repeated strings of 100 bytes by sparse enhanced suffix arrays and their LCP-interval trees.

1. Every window of ``WINDOW`` bytes has one anchor: its ``GRAM``-byte gram with the least hash, the leftmost
   of equals. Neighbouring windows share anchors, so a document is about one anchor for 35 bytes, and equal
   windows have equal anchors at equal offsets.
2. Anchors whose gram occurs once in the corpus can't start repeats; the rest are found by an aggregation and
   a join on the gram's hash.
3. The text around each repeated anchor (its windows) is grouped by anchor. Equal contexts meet in one row
   with their first place, combined before the shuffle.
4. For each group, the suffixes at anchors are sorted and their common-prefix lengths stack-scanned. In each
   interval of the tree, occurrences are told apart by what extends them to the left: those of one window
   are a maximal repeat group, and only its first place survives. A group of a gram with over ``HOT``
   occurrences would not fit a task: its contexts are dealt over many, and an aggregation keeps the first
   place of each of their windows.
5. A document loses the windows of its repeated anchors that didn't survive.

Rows and edge cases
-------------------
* null text: the empty text; texts under ``WINDOW`` bytes lose nothing; very long ones are taken in blocks
* null ``doc_id``: kept whole, its text is no source for others
* rows that repeat a doc_id must repeat its text: they are one document, and get equal rows
* ties don't exist: places (doc_id, start) order all windows; empty table: empty result; other columns are ignored
* a gram that fills a third of the corpus: equal contexts are combined before they move, and no task holds
  more than ``HOT`` contexts of it beside the ``HELD`` it may wait for
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows, materialise, probable

WINDOW, GRAM = 100, 32
#: Gram starts in a window.
GRAMS = WINDOW - GRAM + 1
#: Occurrences of a gram beyond which its contexts are dealt over ``SALTS`` tasks, and contexts sorted at once.
HOT, SALTS, HELD = 2_000, 256, 20_000
#: Bytes of windows whose equal contexts a task combines before the exchange.
COMBINED = 4 << 20
#: Places are doc_id * 2**PLACE_BITS + start.
PLACE_BITS = 40
_BLOCK_BITS = 20
_STEP = 1 << (_BLOCK_BITS - 1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of the rolling hash's base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(pow(_BASE, -1, 1 << 64), size, 1 << 64))])


_POWERS = _Powers()


def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every gram of ``raw``."""
    n = len(raw)
    _POWERS.reach(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * _POWERS.up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _POWERS.down[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash of the anchor's gram, first window, number of windows and the anchor's distance from the first, in blocks."""
    low = np.uint64((1 << _BLOCK_BITS) - 1)
    for base in range(0, max(0, len(raw) - WINDOW + 1), _STEP):
        part = raw[base : base + _STEP + WINDOW - 1]
        h = gram_hashes(part)
        windows = len(part) - WINDOW + 1
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= GRAMS:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:windows], least[GRAMS - size : GRAMS - size + windows])
        at = (least & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        count = np.diff(np.concatenate([first, [windows]]))
        yield h[at[first]].view(np.int64), first + base, count, at[first] - first


def anchor_rows(docs: DataFrame) -> DataFrame:
    """``gram, doc_id, at``: ``at`` packs first window, number of windows and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, ids, ats, held = [], [], [], 0
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for h, first, count, distance in anchors(text.encode()):
                        grams.append(h)
                        ids.append(np.full(len(h), doc_id, np.int64))
                        ats.append(first << 16 | count << 8 | distance)
                        held += len(h)
                if held > 100_000 or (grams and lo + 64 >= batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, ids, ats)], ["gram", "doc_id", "at"])
                    grams, ids, ats, held = [], [], [], 0

    return docs.mapInArrow(run, "gram long, doc_id long, at long")


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spots``: the repeated anchors of each document with any (gram, at, and whether it is hot)."""
    found = anchor_rows(docs)
    repeated = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gram").alias("of"), (F.col("n") > HOT).alias("hot"))
    # Written, so that both sides of the join are dealt anew and a hot gram can be split over tasks.
    repeated = materialise(repeated, "grams")
    spots = found.where(probable(repeated, "of")(F.col("gram"))).join(repeated, F.col("gram") == F.col("of"))
    return materialise(spots.groupBy("doc_id").agg(F.collect_set(F.struct("at", "gram", "hot")).alias("spots")), "anchors")


def contexts(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """``part`` (the gram), whether it is ``hot``, ``context`` bytes, ``windows``, ``distance`` and ``place`` of the first window, a row a repeated anchor."""

    names = ["part", "hot", "context", "windows", "distance", "doc_id", "start"]
    types = [pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def packed(least: dict[tuple, tuple]) -> pa.RecordBatch:
        columns = zip(*((*key, *place) for key, place in least.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal contexts are combined here, so that the one exchange is dealt by the gram.
        least: dict[tuple, tuple] = {}
        held = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for doc_id, text, found in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                    raw = text.encode()
                    for spot in found:
                        at = spot["at"]
                        first, count, distance = at >> 16, at >> 8 & 255, at & 255
                        key = spot["gram"], spot["hot"], raw[first : first + count - 1 + WINDOW], count, distance
                        here = doc_id, first
                        other = least.get(key)
                        if other is None or here < other:
                            held += WINDOW if other is None else 0
                            least[key] = here
                    if held > COMBINED:
                        yield packed(least)
                        least, held = {}, 0
        if least:
            yield packed(least)

    joined = docs.join(spots.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of")).select("doc_id", "text", "spots")
    rows = joined.mapInArrow(run, "part long, hot boolean, context binary, windows int, distance int, doc_id long, start long")
    place = F.expr(f"cast(doc_id AS decimal(20, 0)) * {1 << PLACE_BITS} + start").cast("decimal(38,0)")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("context"), F.lit(SALTS))).otherwise(0).alias("salt")
    dealt = rows.select("part", salt, "hot", "context", "windows", "distance", place.alias("place")).repartition("part", "salt")
    return dealt.groupBy("part", "salt", "hot", "context", "windows", "distance").agg(F.min("place").alias("place"))


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
    """The LCP-interval tree, children first: ``left, right`` (inclusive), own and parent's prefix length, at least ``least``.

    ``lcp[i]`` is that of suffixes i - 1 and i. Suffixes that share less than ``least`` have no interval.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        now = now if now >= least else 0
        left = i - 1
        while stack and stack[-1][0] > now:
            own, left = stack.pop()
            yield left, i - 1, own, max(now, stack[-1][0] if stack else 0)
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def dead_windows(entries: list[tuple[int, bytes, int, int, int]]) -> list[int]:
    """For contexts ``part, context, windows, distance, place``, sorted by part: a bit mask of windows that occur at an earlier place."""
    dead = [0] * len(entries)
    order = sorted(range(len(entries)), key=lambda i: (entries[i][0], entries[i][1][entries[i][3] :][:WINDOW]))
    rights = [entries[i][1][entries[i][3] :][:WINDOW] for i in order]
    table = np.frombuffer(b"".join(r.ljust(WINDOW, b"\0") for r in rights), np.uint8).reshape(-1, WINDOW)
    sizes = np.array([len(r) for r in rights])
    parts = np.array([entries[i][0] for i in order], np.int64)
    differ = table[1:] != table[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)
    lcp = np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))
    lcp[parts[1:] != parts[:-1]] = 0
    for left, right, own, parent in intervals([0, *lcp.tolist()], GRAM):
        members = [(i, *entries[i][1:]) for i in order[left : right + 1]]
        for extent in range(max(parent, GRAM - 1) + 1, own + 1):
            before = WINDOW - extent
            # Occurrences with one right extension; the left one tells windows apart.
            first: dict[bytes, tuple[int, int, int]] = {}
            for i, context, windows, distance, place in members:
                w = distance - before
                if 0 <= w < windows:
                    key = context[w:distance]
                    here = (place + w, i, w)
                    other = first.get(key)
                    if other is None:
                        first[key] = here
                    elif here < other:
                        dead[other[1]] |= 1 << other[2]
                        first[key] = here
                    else:
                        dead[i] |= 1 << w
    return dead


def survivors(found: DataFrame) -> DataFrame:
    """``doc_id, start, windows``: runs of windows of repeated anchors that occur at no earlier place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for lo in range(0, len(rows), 1024):
                hot = [(context[w : w + WINDOW], int(place) + w) for _, is_hot, context, windows, _, place in rows[lo : lo + 1024] if is_hot for w in range(windows)]
                if hot:
                    yield _runs([p for _, p in hot], [1] * len(hot), [key for key, _ in hot])
            held += [(part, *rest) for part, is_hot, *rest in rows if not is_hot]
            if len(held) >= HELD and held[0][0] != held[-1][0]:
                cut = len(held) - 1
                while held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                yield _survive(held[:cut])
                held = held[cut:]
        if held:
            yield _survive(held)

    rows = found.select("part", "hot", "context", "windows", "distance", "place")
    made = rows.sortWithinPartitions("part").mapInArrow(run, "doc_id long, start long, windows int, key binary")
    made = materialise(made, "survivors")
    first = made.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("at"))
    return made.where("key IS NULL").drop("key").union(first.select("at.doc_id", "at.start", F.lit(1).alias("windows")))


def _runs(places: list[int], windows: list[int], keys: list[bytes | None]) -> pa.RecordBatch:
    low = (1 << PLACE_BITS) - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p >> PLACE_BITS for p in places], pa.int64()), pa.array([p & low for p in places], pa.int64()),
            pa.array(windows, pa.int32()), pa.array(keys, pa.binary()),
        ],
        ["doc_id", "start", "windows", "key"],
    )


def _survive(rows: list[tuple]) -> pa.RecordBatch:
    entries = [(part, context, windows, distance, int(place)) for part, context, windows, distance, place in rows]
    places, counts = [], []
    for (_, _, windows, _, place), dead in zip(entries, dead_windows(entries), strict=True):
        w = 0
        while w < windows:
            if dead >> w & 1:
                w += 1
                continue
            end = w + 1
            while end < windows and not dead >> end & 1:
                end += 1
            places.append(place + w)
            counts.append(end - w)
            w = end
    return _runs(places, counts, [None] * len(places))


def removal(n: int, spots: list[tuple[int, int]], kept: list[tuple[int, int]]) -> np.ndarray:
    """A mask of the ``n`` bytes that go, from runs (start, windows) of repeated anchors and of survivors."""
    windows = np.zeros(n, bool)
    for start, count in spots:
        windows[start : start + count] = True
    for start, count in kept:
        windows[start : start + count] = False
    starts = np.flatnonzero(windows)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(change[:n]) > 0


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document; with ``with_text`` also ``kept``, the bytes left."""
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    owned = texts.where("doc_id IS NOT NULL")
    spots = repeated_anchors(owned)
    live = survivors(contexts(owned, spots)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("live"))
    marks = spots.select(F.col("doc_id").alias("of"), F.transform("spots", lambda s: s["at"]).alias("ats")).join(
        live.withColumnRenamed("doc_id", "of_live"), F.col("of") == F.col("of_live"), "left"
    )
    joined = owned.join(marks, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "ats", "live")
    none = texts.where("doc_id IS NULL").select("doc_id", "text", *(F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in ("ats", "live")))

    def make() -> Callable[[tuple], Iterable[tuple]]:
        def row(values: tuple) -> Iterable[tuple]:
            doc_id, text, ats, kept = values
            raw = text.encode()
            left, removed, spans = raw, 0, 0
            if ats:
                gone = removal(len(raw), [(a >> 16, a >> 8 & 255) for a in ats], [(k["start"], k["windows"]) for k in kept or ()])
                removed = int(gone.sum())
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            yield (doc_id, len(raw), removed, spans, sha256(left).hexdigest(), *([left] if with_text else []))

        return row

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return map_rows(joined.union(none), make, schema, batch_rows=1024)
