"""Packing: cutting-stock column generation over the length histogram, patterns dealt to ranked documents.

1. Every document is tokenised once; it is cut into whole sequences and a rest. Only piece lengths and
   checksums leave the Python worker.
2. Lengths are rounded up to ``UNIT`` tokens, which bounds the histogram at ``capacity / UNIT`` classes.
3. The driver solves the cutting-stock linear program over that histogram: a master simplex with an explicit
   basis, whose columns are priced by an unbounded-knapsack dynamic program. Patterns are rounded down; what
   remains (fewer pieces than classes times pieces a pattern) is packed first-fit by decreasing length.
4. Pieces are ranked within their class, by hashed block and id, and each pattern takes an interval of ranks.

Rows and edge cases
-------------------
* null text: the empty text, one token (the end id); null ``doc_id``: packed like any other
* documents longer than a sequence are cut at multiples of it; a very long text is tokenised in words
* repeated rows: each row is packed (ranked by a running number within its block); empty table: empty result
* other input columns are ignored
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import id_and_text, map_rows, materialise

CAPACITY, UNIT, END_ID = 4096, 16, 2
CACHE_WORDS = 800_000
#: Rows that go to a worker at once: texts are long, and the executor and its worker both hold a batch.
BATCH_ROWS = 500
#: Pieces of one class and block are ranked in one task; blocks grow in number with the table.
ROWS_A_BLOCK = 20_000
#: Column generation ends when the basis is proven this close to the optimum of the linear program.
GAP = 2e-3
_TOLERANCE = 1e-9


#: UTF-8 of Latin-1 letters, whose lower case and composed form are one letter each, then ASCII marks.
_LETTERS_THEN_MARKS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+([!-/:-@\[-`{-~]*)").fullmatch


class _Words:
    """Ids, as little-endian bytes, by white-space-delimited word; a missing word is encoded and kept.

    Words not met since the last ``most / 2`` that were kept wait in ``before``, and go when ``now`` is full again.
    """

    def __init__(self, path: str):
        self.most = CACHE_WORDS
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a run of letters or marks, or is a digit.
        self.last = np.zeros(1 + max(vocabulary.values()), bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def keep(self, word: bytes, ids: bytes) -> bytes:
        if len(word) <= 64:
            if 2 * len(self.now) >= self.most:
                self.now, self.before = {}, self.now
            self.now[word] = ids
        return ids

    def ids(self, words: list[bytes]) -> bytes:
        found = list(map(self.now.get, words))
        missing = {word for word, ids in zip(words, found, strict=True) if ids is None}
        if missing:
            fresh = self.learn(missing)
            found = [fresh[word] if ids is None else ids for word, ids in zip(words, found, strict=True)]
        return b"".join(found)

    def learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """The ids of each of ``missing``.

        The vocabulary cuts marks from letters, and the last id of each run says so. Words of letters with or without marks behind
        are one or two runs: many are encoded in one call and cut there. All other words are encoded one by one.
        """
        out: dict[bytes, bytes] = {}
        joined, runs = [], []
        for word in missing:
            ids = self.before.get(word)
            if ids is not None:
                out[word] = self.keep(word, ids)
            elif len(word) <= 64 and (m := _LETTERS_THEN_MARKS(word)):
                joined.append(word)
                runs.append(2 if m[1] else 1)
            else:
                out[word] = self.keep(word, self.encode(word.decode()).tobytes())
        for lo in range(0, len(joined), 1024):
            words, last = joined[lo : lo + 1024], np.cumsum(runs[lo : lo + 1024]) - 1
            ids = self.encode(b" ".join(words).decode())
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == last[-1] + 1:
                whole, stops = ids.tobytes(), (4 * (ends[last] + 1)).tolist()
                each = [whole[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            else:
                each = [self.encode(word.decode()).tobytes() for word in words]
            for word, ids in zip(words, each, strict=True):
                out[word] = self.keep(word, ids)
        return out


_LOADED: dict[str, _Words] = {}


def words_of(path: str) -> _Words:
    """The worker's cache of a vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = _Words(path)
    return _LOADED[path]


def document_ids(text: str, path: str) -> bytes:
    """Ids, with the end id, as little-endian unsigned 32-bit integers.

    The vocabulary drops white space and no token spans it, so words are encoded one by one, or many at once and cut.
    """
    return words_of(path).ids(text.encode().split()) + END_ID.to_bytes(4, "little")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS) -> DataFrame:
    """The pieces of every document: ``doc_id, start, length, ids_crc32, doc_tokens``. A worker keeps the ids of ``cache_words`` words at most."""

    def make() -> Callable[[tuple], Iterable[tuple]]:
        # A worker may still hold what an earlier stage freed.
        pa.default_memory_pool().release_unused()
        words_of(path).most = cache_words

        def row(values: tuple) -> Iterable[tuple]:
            ids = document_ids(values[1], path)
            n = len(ids) // 4
            for start in range(0, n, capacity):
                part = ids[4 * start : 4 * (start + capacity)]
                yield values[0], start, len(part) // 4, zlib.crc32(part), n

        return row

    return map_rows(id_and_text(docs), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value and how often each item is taken."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        n = int(np.searchsorted(sizes, c, "right"))
        if n:
            with_item = best[c - sizes[:n]] + values[:n]
            k = int(np.argmax(with_item))
            if with_item[k] > best[c] + _TOLERANCE:
                best[c], take[c] = with_item[k], k
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= int(sizes[take[c]])
    return float(best[room]), counts


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots: plain array operations, whose time doesn't depend on a BLAS's threads."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        rows = np.flatnonzero(factors)
        both[rows] -= factors[rows, None] * both[k]
    return both[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, most_rounds: int = 4000) -> list[tuple[float, np.ndarray]]:
    """Patterns and their use in an optimal basis of ``min sum x, sum pattern * x = demand``.

    ``most_rounds`` bounds the driver's time only: any basis on the way is a whole solution.
    """
    n = len(sizes)
    basis = np.diag(np.maximum(1, room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    use = _times(inverse, demand)
    for step in range(1, most_rounds + 1):
        prices = inverse.sum(axis=0)  # every column costs one sequence
        value, column = price(np.maximum(prices, 0), sizes, room)
        if value <= 1 + GAP:  # Farley's bound: the basis costs at most this share over the optimum
            break
        direction = _times(inverse, column)
        able = direction > 1e-9
        if not able.any():
            break
        ratios = np.where(able, use / np.where(able, direction, 1), np.inf)
        leave = int(np.argmin(ratios))
        basis[:, leave] = column
        if step % 64 == 0:
            inverse = _inverse(basis)
            use = np.maximum(_times(inverse, demand), 0)
            continue
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        length = ratios[leave]
        use = np.maximum(use - length * direction, 0)
        use[leave] = length
    return [(float(use[j]), basis[:, j].round().astype(np.int64)) for j in range(n)]


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """How many sequences take which pieces: ``(times, {size: pieces})``, meeting the histogram exactly."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    out: list[tuple[int, dict[int, int]]] = []
    for use, column in column_generation(sizes, left, room) if len(sizes) else []:
        taken = column > 0
        times = min(int(use + 1e-6), int((left[taken] // column[taken]).min())) if taken.any() else 0
        if times > 0:
            left -= times * column
            out.append((times, {int(sizes[k]): int(column[k]) for k in np.flatnonzero(taken)}))
    rests: list[list] = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            size = int(sizes[k])
            for bin_ in rests:
                if bin_[0] >= size:
                    break
            else:
                rests.append(bin_ := [room, {}])
            bin_[0] -= size
            bin_[1][size] = bin_[1].get(size, 0) + 1
    return out + [(1, items) for _, items in rests]


def pack(parts: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (``doc_id, start, length`` and others), which is read twice."""
    spark = parts.sparkSession
    sized = parts.withColumn("_size", F.expr(f"int((length + {unit - 1}) div {unit})"))
    counted = sized.groupBy("_size").count().collect()  # at most capacity / unit rows
    total = sum(r["count"] for r in counted)
    blocks = max(1, -(-total // ROWS_A_BLOCK))
    rows, slot_rows, base = [], {}, 0
    for times, items in plan({r["_size"]: r["count"] for r in counted}, capacity // unit):
        slot = 0
        for size in sorted(items, reverse=True):
            first = slot_rows.get(size, 0)
            rows.append((size, first, first + times * items[size], items[size], base, slot))
            slot_rows[size] = first + times * items[size]
            slot += items[size]
        base += times
    # At most (classes + 1) patterns and the few rest sequences, each with at most capacity / unit sizes.
    intervals = spark.createDataFrame(rows, "_size int, _first long, _end long, _each int, _base long, _slot int")
    blocked = sized.withColumn("_block", F.expr(f"int(pmod(xxhash64(doc_id, start, ids_crc32), {blocks}))"))
    per_block = blocked.groupBy("_size", "_block").agg(F.count("*").alias("_n"))
    before = per_block.select(
        "_size", "_block", (F.sum("_n").over(Window.partitionBy("_size").orderBy("_block")) - F.col("_n")).alias("_before")
    )
    in_block = Window.partitionBy("_size", "_block").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        blocked.withColumn("_in", F.row_number().over(in_block) - 1)
        .join(before, ["_size", "_block"])
        .withColumn("_rank", F.col("_in") + F.col("_before"))
    )
    dealt = ranked.alias("p").join(
        F.broadcast(intervals).alias("i"),
        (F.col("p._size") == F.col("i._size")) & F.expr("p._rank >= i._first AND p._rank < i._end"),
    )
    placed = dealt.select(
        *(F.col(f"p.{c}") for c in parts.columns),
        F.expr("_base + (_rank - _first) div _each").alias("sequence_id"),
        F.expr("_slot + (_rank - _first) % _each").alias("_place"),
    )
    # A sequence holds at most capacity / unit pieces.
    order = Window.partitionBy("sequence_id").orderBy("_place")
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length")).drop("_place")


def packed(docs: DataFrame, path: str, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Tokenise, cut and pack a table of documents."""
    return pack(materialise(pieces(docs, path, cache_words=cache_words), "pieces", BATCH_ROWS))
