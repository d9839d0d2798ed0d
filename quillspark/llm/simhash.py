"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through Golay-code fuzzy hashing.

The perfect binary Golay code (23, 12) gives every 23-bit word one codeword within three bits. Two words at
most two bits apart share a codeword index among those of the words within one bit of each: one to six keys.
A fingerprint has segments A, B, C of 22, 21 and 21 bits. By pigeonhole three differing bits fall as follows,
and each case has a key family; joined pairs are verified by counting bits.

====================================  ==========================================================
bits that differ in A, B, C           key
====================================  ==========================================================
none in A, at most 2 in B             A, and Golay indices of B
none in B, at most 2 in A             B, and Golay indices of A
none in C, at most 2 in A             C, and Golay indices of A
3 in B, or 3 in A                     the two segments that agree
1 in each                             Golay indices of A and B, segment parities (all flip)
====================================  ==========================================================

Rows and edge cases
-------------------
* null or wordless text: fingerprint zero, linked like any other; fewer words than a shingle: one shingle
* null ``doc_id``: kept, takes no part in links, ``component_id`` null
* equal fingerprints meet in one row before keys are made, so copies never make pairs
* a bit set in exactly half of the shingles is 0; repeated rows: one output row each
* empty table: empty result; other input columns are ignored
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import id_and_text, map_rows, materialise, packed_rows, probable
from quillspark.llm.components import connected_components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
CUTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR, LENGTH, CHECK = 0b110001110101, 23, 11
_BLOCK = 1 << 16


def fingerprint(text: str, words_each: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the XXH64 values of the text's word shingles, A-Z lower-cased."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(words)
    joined = b" ".join(words)
    if n <= words_each:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: n - words_each + 1].tolist(), ends[words_each - 1 :].tolist()
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _BLOCK):
        block = hashes[lo : lo + _BLOCK].astype("<u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return sum(1 << int(b) for b in np.flatnonzero(2 * total > len(hashes)))


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit integer."""

    def make() -> Callable[[tuple], Iterable[tuple]]:
        def row(values: tuple) -> Iterable[tuple]:
            f = fingerprint(values[1], words_each)
            yield values[0], f - (1 << 64) if f >> 63 else f

        return row

    return map_rows(id_and_text(docs), make, "doc_id long, fp long")


class Golay:
    """Nearest-codeword indices of 23-bit words, by syndrome."""

    def __init__(self) -> None:
        rests = []
        for b in range(LENGTH):
            rest = 1 << b
            for high in range(LENGTH - 1, CHECK - 1, -1):
                if rest >> high & 1:
                    rest ^= GENERATOR << (high - CHECK)
            rests.append(rest)
        self.rests = np.array(rests, np.int64)
        #: error pattern of up to three bits by syndrome
        self.errors = np.zeros(1 << CHECK, np.int64)
        for i in range(LENGTH):
            for j in range(i, LENGTH):
                for k in range(j, LENGTH):
                    pattern = 1 << i | 1 << j | 1 << k
                    rest = 0
                    for b in {i, j, k}:
                        rest ^= rests[b]
                    self.errors[rest] = pattern

    def index(self, words: np.ndarray) -> np.ndarray:
        """The twelve message bits of the codeword nearest to each word."""
        rest = np.zeros_like(words)
        for b in range(LENGTH):
            rest ^= (words >> b & 1) * self.rests[b]
        return (words ^ self.errors[rest]) >> CHECK

    def near(self, words: np.ndarray, bits: int, itself: bool = True) -> list[list[int]]:
        """Distinct indices of the words within one of the low ``bits`` of each word; with or without the word itself."""
        flips = np.array([0] * itself + [1 << b for b in range(bits)], np.int64)
        found = np.sort(self.index((words[:, None] ^ flips).ravel()).reshape(len(words), -1), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        return [row[keep].tolist() for row, keep in zip(found, first, strict=True)]


def _keys(fps: np.ndarray, golay: Golay) -> Iterator[tuple[int, int, int]]:
    """Key, side (0 and 1 meet; 2 meets itself) and place of each fingerprint."""
    raw = fps.astype("<u8")
    a, b, c = ((raw >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in CUTS)
    near_a, near_b = golay.near(a, CUTS[0][1]), golay.near(b, CUTS[1][1])
    flip_a, flip_b = golay.near(a, CUTS[0][1], False), golay.near(b, CUTS[1][1], False)
    index_a, index_b = golay.index(a).tolist(), golay.index(b).tolist()
    for i, (x, y, z) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), strict=True)):
        for k in near_b[i]:
            yield 1 << 60 | x << 12 | k, 2, i
        for k in near_a[i]:
            yield 2 << 60 | y << 12 | k, 2, i
            yield 3 << 60 | z << 12 | k, 2, i
        yield 4 << 60 | x << 21 | z, 2, i
        yield 5 << 60 | y << 21 | z, 2, i
        odd_b, odd_c = y.bit_count() & 1, z.bit_count() & 1
        if x.bit_count() & 1:
            for k in flip_a[i]:
                for m in flip_b[i]:
                    yield 6 << 60 | k << 14 | m << 2 | (1 - odd_b) << 1 | (1 - odd_c), 1, i
        else:
            yield 6 << 60 | index_a[i] << 14 | index_b[i] << 2 | odd_b << 1 | odd_c, 0, i


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """``key``, ``side``, ``fp`` and ``rep`` for each row of ``fp`` and ``rep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                fps = part.column(0).to_numpy(zero_copy_only=False)
                reps = part.column(1).to_numpy(zero_copy_only=False)
                keys, sides, at = zip(*_keys(fps, golay), strict=True)
                at = np.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(sides, pa.int32()), pa.array(fps[at], pa.int64()), pa.array(reps[at], pa.int64())],
                    ["key", "side", "fp", "rep"],
                )

    return distinct.select("fp", "rep").mapInArrow(run, "key long, side int, fp long, rep long")


def links(distinct: DataFrame, most_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``u``, ``v`` of representatives whose fingerprints differ in at most ``most_bits`` (up to 3) bits."""
    # The table of fingerprints is small, its keys aren't. Tables here grow with the input: merged at every size, never broadcast.
    keys = fuzzy_keys(distinct.repartition("fp"))
    close = F.expr(f"bit_count(x.fp ^ y.fp) <= {int(most_bits)}")
    x, y = keys.alias("x"), keys.alias("y").hint("merge")
    meet = (F.col("x.key") == F.col("y.key")) & F.expr("(x.side = 2 AND x.fp < y.fp) OR (x.side = 0 AND y.side = 1)") & close
    return x.join(y, meet).select(F.col("x.rep").alias("u"), F.col("y.rep").alias("v"))


def stars(distinct: DataFrame, most_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``u < v`` of which one has the least fingerprint under a key of both: a row a key at most, whatever the group's size."""
    keys = materialise(fuzzy_keys(distinct), "simhash-keys")
    least = keys.where("side <> 1").groupBy("key").agg(F.min(F.struct("fp", "rep")).alias("y")).select(F.col("key").alias("of"), "y.*")
    close = F.expr(f"x.key = y.of AND x.rep <> y.rep AND bit_count(x.fp ^ y.fp) <= {int(most_bits)}")
    return keys.alias("x").join(least.alias("y").hint("merge"), close).select(F.least("x.rep", "y.rep").alias("u"), F.greatest("x.rep", "y.rep").alias("v"))


def near_duplicates(docs: DataFrame, words_each: int = SHINGLE_WORDS, most_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` as hex digits and ``component_id``, the smallest id reachable over links."""
    prints = materialise(fingerprints(docs, words_each), "simhash")
    distinct = materialise(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = connected_components(links(distinct, most_bits))
    of_fp = distinct.join(roots.hint("merge"), distinct["rep"] == roots["node"], "left").select(
        F.col("fp").alias("of_fp"), F.coalesce("component", "rep").alias("component")
    )
    return prints.join(of_fp.hint("merge"), F.col("fp") == F.col("of_fp"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def keep_one(docs: DataFrame, words_each: int = SHINGLE_WORDS, most_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with only the smallest doc_id of each component; rows without an id stay."""
    return without_copies(docs, near_duplicates(docs, words_each, most_bits))


def without_copies(docs: DataFrame, components: DataFrame) -> DataFrame:
    """``docs`` without those whose ``component_id`` is less than their ``doc_id``; columns of any name pass through."""
    copies = materialise(components.where("component_id < doc_id").select(F.col("doc_id").cast("long").alias("copy")).distinct(), "copies")
    # Only rows whose id may be a copy's move to be joined.
    may_go = probable(copies.select(F.xxhash64("copy").alias("h")), "h")(F.xxhash64(F.col("row.doc_id").cast("long")))
    rows = packed_rows(docs)
    left = rows.where(~may_go).union(rows.where(may_go).join(copies.hint("merge"), F.col("row.doc_id") == F.col("copy"), "left_anti"))
    return left.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
