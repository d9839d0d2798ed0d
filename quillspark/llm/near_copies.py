"""SimHash near-dedup of whole corpora: every pair of texts whose word shingles have a Jaccard similarity of ``LEAST`` at least.

Fingerprints of the five-word shingles meet by the Golay keys of ``simhash``, texts that meet are verified by
their exact similarity, and what is verified gives the first components. Fingerprints of 64 bits alone can't find all:
at 0.8 they differ in about ten bits, and Golay keys reach three. So a set-similarity join by prefixes finds the rest,
between those components only, and makes the result exact: a prefix key under which all texts are of one component goes
before anything is joined, and no two texts of one component meet again.

All sets are sorted by one total order, rare shingles first; two
sets of ``n`` and ``m`` shingles that reach the similarity share one of the first ``n - ceil(LEAST * n) + 1``
and ``m - ceil(LEAST * m) + 1``. Any order gives the same pairs; the one taken here, from counts of all
shingles in ``1 << SKETCH_BITS`` buckets, keeps common passages out of the prefixes.

Pairs are made in three rounds. First every text meets one text of each of its Golay keys. Then it meets the smallest id
of each of its prefix keys, if that is of another component; what is verified joins components. Then the texts of one key meet
where their components still differ. A pair inside a component has nothing to add, so a large group of near copies costs a row a key, not a pair.

Before sets move, a pair must pass a bound: each set has a bitmap of the parities of its shingles' hashes, and two
bitmaps differ in no more bits than the sets differ in shingles. The bound drops no similar pair; what passes is verified.

Rows and edge cases
-------------------
* null or wordless text: the empty set, a copy of any other; fewer words than a shingle: one shingle
* null ``doc_id``: kept, takes no part
* equal sets meet in one row before keys are made
* repeated rows: rows of one doc_id don't remove each other; empty table: empty result
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.llm.common import id_and_text, map_rows, materialise, probable
from quillspark.llm.components import connected_components

SHINGLE_WORDS, LEAST, SEED = 5, 0.8, 42
SKETCH_BITS, _SLOTS = 20, 8
#: 64-bit words of a set's parity bitmap.
PARITY_WORDS = 8
#: A bucket of the counts this often as full as the average holds a hot shingle, whose rows are dealt over so many tasks.
HOT_TIMES, HOT_PARTS = 64, 256
#: ``LEAST`` as a fraction, so that limits are whole numbers.
_UP, _DOWN = 4, 5


def shingles(text: str, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the text's word shingles, A-Z lower-cased."""
    import xxhash

    words = text.encode().lower().split()
    digest, n = xxhash.xxh64_intdigest, len(words)
    joined = b" ".join(words)
    if n <= words_each:
        return np.array([digest(joined, SEED)] if words else [], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: n - words_each + 1].tolist(), ends[words_each - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64))


def prefix_size(n: int) -> int:
    """How many of ``n`` sorted shingles must hold one of any set that is similar enough."""
    return n - -(-_UP * n // _DOWN) + 1 if n else 0


def parities(own: np.ndarray) -> list[int]:
    """The parity of the number of shingles under each of the bitmap's places, as signed 64-bit words."""
    odd = np.bincount((own & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``d1``, ``d2`` (a digest of the set), ``n``, the fingerprint ``fp`` and ``odd``, the parities; in rows without ``n``, counts of a task's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "d1", "d2", "n", "fp", "odd", "slot", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

        def rows(*columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                ids, texts = (c.to_pylist() for c in batch.slice(lo, 1024).columns)
                found = []
                for text in texts:
                    own = shingles(text)
                    np.add.at(counts, own >> np.uint64(64 - SKETCH_BITS), 1)
                    whole = xxhash.xxh3_128_digest(own.tobytes())
                    f = simhash.majority(own)
                    found.append((*np.frombuffer(whole, "<i8").tolist(), len(own), f - (1 << 64) if f >> 63 else f, parities(own)))
                yield rows(ids, *map(list, zip(*found, strict=True)), [None] * len(ids), [None] * len(ids))
        task = TaskContext.get()
        yield rows([None], [None], [None], [None], [None], [None], [task.partitionId() % _SLOTS if task else 0], [zlib.compress(counts.tobytes(), 1)])

    return id_and_text(docs).mapInArrow(run, "doc_id long, d1 long, d2 long, n long, fp long, odd array<long>, slot int, counts binary")


def _sketch(seen: DataFrame) -> np.ndarray:
    """Sum of all tasks' counts; a few partial sums reach the driver, whatever the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for packed in batch.column(0):
                own = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
                total = own.astype(np.uint64) if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)], pa.binary())], ["counts"])

    parts = seen.where("n IS NULL").repartition(_SLOTS, "slot").select("counts").mapInArrow(run, "counts binary")
    # A job a partition: no more of them than slots, into however many partitions the rows were dealt.
    parts = parts.coalesce(_SLOTS)
    total = np.zeros(1 << SKETCH_BITS, np.uint64)
    for row in parts.toLocalIterator():
        total += np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return np.minimum(total, 2**32 - 1).astype(np.uint32)


def prefix_keys(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``key``, ``id``, ``n`` and ``at``, the place of the key in its sorted set, for the keys of each text's prefix, with the
    text's ``component``; ``part`` is 0 but for hot keys. ``docs``: doc_id, text and component."""
    common = docs.sparkSession.sparkContext.broadcast(zlib.compress(sketch.tobytes(), 1))
    hot = HOT_TIMES * max(1.0, float(sketch.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(zlib.decompress(common.value), np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, texts, components = (c.to_pylist() for c in batch.slice(lo, 256).columns)
                keys, sizes, kept, parts = [np.array([], np.uint64)], [], [], [np.array([], np.int64)]
                for i, text in zip(ids, texts, strict=True):
                    own = shingles(text)
                    times = counts[own >> np.uint64(64 - SKETCH_BITS)]
                    order = np.lexsort((own, times))[: prefix_size(len(own))]
                    keys.append(own[order])
                    sizes.append(len(own))
                    kept.append(len(order))
                    parts.append(np.where(times[order] > hot, 1 + i % HOT_PARTS, 0))
                at = np.concatenate([np.array([], np.int64), *(np.arange(k) for k in kept)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64), pa.int64()), pa.array(np.repeat(np.array(ids, np.int64), kept), pa.int64()),
                        pa.array(np.repeat(np.array(sizes, np.int32), kept), pa.int32()), pa.array(at.astype(np.int32), pa.int32()),
                        pa.array(np.concatenate(parts).astype(np.int32), pa.int32()), pa.array(np.repeat(np.array(components, np.int64), kept), pa.int64()),
                    ],
                    ["key", "id", "n", "at", "part", "component"],
                )

    columns = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "component")
    return columns.mapInArrow(run, "key long, id long, n int, at int, part int, component long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` without those of keys that only one ``component`` has (without that column, one id): one exchange, then a
    stream over sorted rows. Rows of hot keys all stay, so what waits for the end of its key is bounded."""
    of = "component" if "component" in keys.columns else "id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the last key of a batch wait for the next one; those of hot keys don't.
        held: list[pa.RecordBatch] = []
        for last in (False, True):
            for batch in batches if not last else [None]:
                if batch is not None and not batch.num_rows:
                    continue
                if batch is not None and held and batch.column("key")[-1] == held[0].column("key")[0] and not batch.column("part")[-1].as_py():
                    held.append(batch)
                    continue
                own = [*held, *([batch] if batch is not None else [])]
                if not own:
                    continue
                table = pa.Table.from_batches(own).combine_chunks()
                key, part, component = (table.column(c).to_numpy() for c in ("key", "part", of))
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                mixed = np.minimum.reduceat(component, starts) < np.maximum.reduceat(component, starts)
                stays = np.repeat(mixed, np.diff(np.append(starts, len(key)))) | (part > 0)
                end = len(key) if last or part[-1] else int(starts[-1])
                yield from table.slice(0, end).filter(pa.array(stays[:end])).to_batches()
                held = table.slice(end).to_batches()

    dealt = keys.repartition("key", "part").sortWithinPartitions("key")
    return dealt.mapInArrow(run, keys.schema).drop("part")


def grouped(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """``docs`` with the ``component`` that ``roots`` gives their id, else the id. Only texts whose id may be in ``roots`` move."""
    may_be = probable(roots.select(F.xxhash64("node").alias("h")), "h")(F.xxhash64("doc_id"))
    joined = docs.where(may_be).join(roots.hint("merge"), F.col("doc_id") == F.col("node"), "left")
    named = joined.select("doc_id", "text", F.coalesce("component", "doc_id").alias("component"))
    return docs.where(~may_be).select("doc_id", "text", F.col("doc_id").alias("component")).union(named)


#: Sizes, and what is left from the key on in both sets, allow the similarity; true of the first key that two similar sets share.
_POSSIBLE = (
    f"{_DOWN} * least(x.n, y.n) >= {_UP} * greatest(x.n, y.n) AND "
    f"{_UP + _DOWN} * least(x.n - x.at, y.n - y.at) >= {_UP} * (x.n + y.n)"
)


def _near_enough(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Distinct ``pairs`` whose parity bitmaps allow the similarity: sets of n and m shingles may differ in a ninth of n + m at 0.8."""
    a, b = (bitmaps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")).hint("merge") for c in "uv")
    differ = " + ".join(f"bit_count(odd_u[{i}] ^ odd_v[{i}])" for i in range(PARITY_WORDS))
    allowed = F.expr(f"{_UP + _DOWN} * ({differ}) <= {_DOWN - _UP} * (n_u + n_v)")
    return pairs.distinct().join(a, "u").join(b, "v").where(allowed).select("u", "v").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs ``u``, ``v`` whose sets, made again from the texts, are similar enough."""

    def make() -> Callable[[tuple], Iterable[tuple]]:
        def row(values: tuple) -> Iterable[tuple]:
            yield values[0], shingles(values[1]).view(np.int64).tolist()

        return row

    wanted = materialise(pairs.select(F.explode(F.array("u", "v")).alias("wanted")).distinct(), f"{name}-ids")
    is_wanted = probable(wanted.select(F.xxhash64("wanted").alias("h")), "h")(F.xxhash64("doc_id"))
    texts = id_and_text(docs).where(is_wanted).join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
    sets = materialise(map_rows(texts, make, "id long, own array<long>", 64), f"{name}-sets")
    # Sets grow with the input: merged at every size, never broadcast.
    a = sets.select(F.col("id").alias("u"), F.col("own").alias("a")).hint("merge")
    b = sets.select(F.col("id").alias("v"), F.col("own").alias("b")).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = batch.columns
            close = []
            for x, y in zip(a, b, strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                close.append(_DOWN * both >= _UP * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(close, pa.bool_()))

    joined = pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b")
    return materialise(joined.mapInArrow(run, "u long, v long").distinct(), f"{name}-links")


def links(docs: DataFrame, sketch: np.ndarray, likely: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Pairs ``u``, ``v`` of ids whose components are those of all pairs of similar texts. ``docs``: no null id; ``likely``: pairs of
    like fingerprints; ``bitmaps``: ``doc_id``, ``n`` and ``odd`` of every text."""
    likely = materialise(_near_enough(likely, bitmaps), "near-likely")
    found = _verified(likely, docs, "near-prints")
    # Keys of one text, or of texts that fingerprints have linked, go before anything is joined.
    keys = materialise(shared_keys(prefix_keys(grouped(docs, connected_components(found)), sketch)), "near-keys")
    least = keys.groupBy("key").agg(F.min_by(F.struct("id", "n", "at", "component"), "id").alias("y")).select(F.col("key").alias("of"), "y.*")
    meet = F.expr(f"x.key = y.of AND y.id < x.id AND y.component <> x.component AND {_POSSIBLE}")
    stars = keys.alias("x").join(least.alias("y"), meet).select(F.col("y.id").alias("u"), F.col("x.id").alias("v"))
    stars = materialise(_near_enough(stars, bitmaps).join(likely, ["u", "v"], "left_anti"), "near-stars")
    first = found.union(_verified(stars, docs, "near-first"))
    roots = connected_components(first).withColumnRenamed("component", "root")
    named = keys.join(roots.hint("merge"), F.col("id") == F.col("node"), "left").select("key", "id", "n", "at", F.coalesce("root", "id").alias("part"))
    named = materialise(named, "near-named")
    mixed = named.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    named = materialise(named.join(mixed, "key", "left_semi"), "near-mixed")
    meet = F.expr(f"x.key = y.key AND x.part < y.part AND {_POSSIBLE}")
    rest = named.alias("x").join(named.alias("y"), meet).select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v"))
    rest = materialise(_near_enough(rest, bitmaps).join(stars.union(likely), ["u", "v"], "left_anti"), "near-rest")
    return first.union(_verified(rest, docs, "near-last"))


def components(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest id reachable over similar texts; rows without an id are left out."""
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialise(_sets(known), "near-sets")
    sketch = _sketch(seen)
    seen = seen.where("n IS NOT NULL")
    distinct = materialise(seen.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp")), "near-distinct")
    by_print = materialise(distinct.groupBy("fp").agg(F.min("rep").alias("first")), "near-prints")
    # Sets with one fingerprint meet the first of them, others by the Golay keys of their fingerprints.
    of_print = by_print.withColumnRenamed("fp", "of_fp")
    alike = distinct.join(of_print, F.col("fp") == F.col("of_fp")).where("first < rep").select(F.col("first").alias("u"), F.col("rep").alias("v"))
    likely = alike.union(simhash.stars(by_print.withColumnRenamed("first", "rep").repartition("fp")))
    of_set = distinct.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "rep")
    named = materialise(seen.join(of_set, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select("doc_id", "rep").distinct(), "near-reps")
    # A text whose set has a smaller id makes no keys, unless its id also has another text.
    copies = named.groupBy("doc_id").agg(F.max("rep").alias("last")).where("last < doc_id").select(F.col("doc_id").alias("_copy"))
    copies = materialise(copies, "near-copies")
    # Only texts whose id may be a copy's move to be joined.
    may_go = probable(copies.select(F.xxhash64("_copy").alias("h")), "h")(F.xxhash64("doc_id"))
    alone = known.where(~may_go).union(known.where(may_go).join(copies, F.col("doc_id") == F.col("_copy"), "left_anti"))
    same = named.where("rep < doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    roots = connected_components(links(alone, sketch, likely, seen.select("doc_id", "n", "odd")).union(same))
    return named.select("doc_id").distinct().join(roots.hint("merge"), F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with only the smallest doc_id of each component; rows without an id stay."""
    return simhash.without_copies(docs, components(docs.select("doc_id", "text")))
