"""Chat formatting: roles of transcript turns by a hidden Markov model and Viterbi, then canonical turns.

A turn is observed through its speaker marker (``Human:``, ``AI:``, ... or none) and through features of its lines. A
marker is cut off only where the recovered role is its own; a word that also starts sentences (``A:``, ``Context:``)
is a marker only if the conversation uses it twice, so no other word of a text is lost. Start, transition and emission probabilities are counted over all turns whose role is
known, with one added to each count. Turns are sorted by conversation, turn and text over all
tasks, and what a task holds of a conversation is a block: a max-plus matrix from the role before it to its last role.
Matrices of a conversation are chained, and each block is then traced between its two known ends. So a conversation
with a third of all rows is dealt over many tasks, whatever its turns' numbers.

Rows and edge cases
-------------------
* null text: the empty text; null ``conv_id``: all such turns are one conversation; null ``turn``: before all others
* null or unknown role: not counted, still decoded; no known role at all: every path ties
* ties: the role that comes first in ``ROLES``; turns with one number are ordered by their text, repeated rows stay
* empty table: empty result; other columns are ignored
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialise

ROLES = ("system", "user", "assistant")
MARKERS = {"system": ("system", "context"), "user": ("user", "human", "q"), "assistant": ("assistant", "ai", "bot", "a")}
#: Markers that are ordinary words: only before a colon, and only if the conversation has them twice.
WEAK = ("context", "q", "a")
_WORDS = [w for words in MARKERS.values() for w in words]
_PATTERN = (
    rf"(?i)^\s*[*#]{{0,3}}(?:({'|'.join(w for w in _WORDS if w not in WEAK)})[*]{{0,2}}\s*[:>]"
    rf"|({'|'.join(WEAK)})[*]{{0,2}}\s*:)[*]{{0,2}}\s*"
)
#: How many values each feature takes.
FEATURES = {"marker": 4, "size": 6, "line": 3, "ask": 2}


def observe(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role`` (place in ``ROLES`` or null), ``body``, ``cut`` (the marker's length), the features and ``block``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.lower("role"))
    word = F.lower(F.concat(F.regexp_extract("body", _PATTERN, 1), F.regexp_extract("body", _PATTERN, 2)))
    dealt = turns.select("conv_id", "turn", F.when(known > 0, known - 1).cast("int").alias("role"), text.alias("body"))
    # The last key parts rows that are alike in all else, whose order doesn't matter.
    dealt = dealt.repartitionByRange("conv_id", "turn", "body", F.rand(7)).withColumn("block", F.spark_partition_id().cast("long"))
    dealt = materialise(dealt.withColumn("word", word), "chat-turns")
    uses = dealt.where(F.col("word").isin(*WEAK)).groupBy("conv_id", "word").count().where("count > 1")
    uses = materialise(uses.select(F.col("conv_id").alias("of"), F.col("word").alias("weak")), "chat-markers")
    used = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("word") == F.col("weak"))
    seen = dealt.join(uses, used, "left")
    word = F.when(~F.col("word").isin(*WEAK) | F.col("weak").isNotNull(), F.col("word")).otherwise("")
    marker = F.lit(0)
    for k, role in enumerate(ROLES, 1):
        marker = F.when(F.col("word").isin(*MARKERS[role]), F.lit(k)).otherwise(marker)
    head = F.when(F.col("marker") > 0, F.length("body") - F.length(F.regexp_replace("body", _PATTERN, ""))).otherwise(0)
    said = F.expr("substring(body, cut + 1)")
    return (
        seen.withColumn("word", word)
        .select("conv_id", "turn", "role", "body", "block", marker.cast("int").alias("marker"))
        .withColumn("cut", head.cast("int"))
        .withColumn("size", F.least(F.lit(5), F.floor(F.log2(F.length(said) / 40 + 1))).cast("int"))
        .withColumn("line", F.least(F.lit(2), F.size(F.split(said, "\n")) - 1).cast("int"))
        .withColumn("ask", F.rtrim(said).endswith("?").cast("int"))
    )


class Model:
    """Log probabilities: ``start``, ``move`` and, for each feature, ``emit``."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: dict[str, np.ndarray]):
        def log(counts: np.ndarray) -> np.ndarray:
            return np.log((counts + 1) / (counts + 1).sum(axis=-1, keepdims=True))

        self.start, self.move = log(start), log(move)
        self.emit = {k: log(v) for k, v in emit.items()}
        #: a list of log probabilities, by role, for each combination of features
        self.of = {
            codes: [math.fsum(float(self.emit[f][r][c]) for f, c in zip(FEATURES, codes, strict=True)) for r in range(len(ROLES))]
            for codes in itertools.product(*map(range, FEATURES.values()))
        }


def fit(seen: DataFrame) -> Model:
    """Counts over all turns with known roles; a few dozen numbers reach the driver."""
    n = len(ROLES)
    emit = {f: np.zeros((n, k)) for f, k in FEATURES.items()}
    for row in seen.where("role IS NOT NULL").groupBy("role", *FEATURES).count().collect():
        for f in FEATURES:
            emit[f][row["role"], row[f]] += row["count"]
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "body", "role")
    moves = seen.select("conv_id", "block", "role", F.lag("role").over(in_block).alias("was"), F.row_number().over(in_block).alias("k"))
    ends = (
        seen.groupBy("conv_id", "block")
        .agg(F.max(F.struct("turn", "body", "role"))["role"].alias("last"), F.min(F.struct("turn", "body", "role"))["role"].alias("first"))
        .select(F.col("last"), F.col("first"), F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")).alias("was"),
                F.row_number().over(Window.partitionBy("conv_id").orderBy("block")).alias("b"))
    )
    counted = (
        moves.where("k > 1").select("was", "role")
        .union(ends.where("b > 1").select("was", F.col("first").alias("role")))
        .union(ends.where("b = 1").select(F.lit(-1).alias("was"), F.col("first").alias("role")))
        .where("was IS NOT NULL AND role IS NOT NULL").groupBy("was", "role").count().collect()
    )
    start, move = np.zeros(n), np.zeros((n, n))
    for row in counted:
        if row["was"] < 0:
            start[row["role"]] += row["count"]
        else:
            move[row["was"], row["role"]] += row["count"]
    return Model(start, move, emit)


def viterbi(model: Model, codes: list[tuple[int, ...]], before: int | None, last: int | None = None) -> tuple[float, list[int]]:
    """Best score and roles of a run of turns, after role ``before`` (None: at the start), ending in ``last`` if given."""
    n = range(len(ROLES))
    first = model.start if before is None else model.move[before]
    score = [float(first[r]) + model.of[codes[0]][r] for r in n]
    back: list[list[int]] = []
    move = model.move.tolist()
    for code in codes[1:]:
        here, new, came = model.of[code], [], []
        for r in n:
            best = max(n, key=lambda p: (score[p] + move[p][r], -p))
            new.append(score[best] + move[best][r] + here[r])
            came.append(best)
        score = new
        back.append(came)
    at = max(n, key=lambda r: (score[r], -r)) if last is None else last
    path = [at]
    for came in reversed(back):
        path.append(came[path[-1]])
    return score[at], path[::-1]


def block_matrix(model: Model, codes: list[tuple[int, ...]], first: bool) -> list[float]:
    """Best scores from each role before the block (or the start, in the first row) to each last role, row by row."""
    n = range(len(ROLES))
    rows = [[float(model.start[r]) if first else float(model.move[p][r]) for r in n] for p in n]
    out, move = [], model.move.tolist()
    for row in rows:
        score = [row[r] + model.of[codes[0]][r] for r in n]
        for code in codes[1:]:
            here = model.of[code]
            score = [max(score[p] + move[p][r] for p in n) + here[r] for r in n]
        out += score
    return out


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``width`` columns, across batches."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, run in itertools.groupby(rows, key=lambda r: r[:width]):
        yield key, list(run)


def _emit(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while chunk := list(itertools.islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk, strict=True), types, strict=True)], names)


def chain(blocks: list[tuple[int, list[float], bool]]) -> list[tuple[int, int | None, int]]:
    """For each block, in order, the role before it (None: start) and its last role, on the best path."""
    n = range(len(ROLES))
    score, back = blocks[0][1][: len(ROLES)], []
    for _, matrix, _ in blocks[1:]:
        came = [max(n, key=lambda p: (score[p] + matrix[p * len(ROLES) + r], -p)) for r in n]
        score = [score[came[r]] + matrix[came[r] * len(ROLES) + r] for r in n]
        back.append(came)
    ends = [max(n, key=lambda r: (score[r], -r))]
    for came in reversed(back):
        ends.append(came[ends[-1]])
    ends.reverse()
    return [(b[0], ends[k - 1] if k else None, ends[k]) for k, b in enumerate(blocks)]


def decode(seen: DataFrame, model: Model) -> DataFrame:
    """``conv_id, turn, body`` (without the marker of its own role) and ``role``, the recovered one, of every turn."""
    codes = [*FEATURES]
    marked = codes.index("marker")
    blocks = seen.select("conv_id", "block").groupBy("conv_id").agg(F.min("block").alias("first_block"))
    rows = seen.join(blocks.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).withColumn(
        "is_first", F.col("block") == F.col("first_block")
    )

    def dealt(df: DataFrame, *columns: str) -> DataFrame:
        return df.select("conv_id", "block", *columns).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "body")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (
            (conv, block, block_matrix(model, [r[5:] for r in run], run[0][4]))
            for (conv, block), run in _groups(batches, 2)
        )
        yield from _emit(made, ["conv_id", "block", "matrix"], [pa.int64(), pa.int64(), pa.list_(pa.float64())])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (
            (conv, *known)
            for (conv,), run in _groups(batches, 1)
            for known in chain([(block, matrix, False) for _, block, matrix in run])
        )
        yield from _emit(made, ["conv_id", "block", "entry", "exit"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for (conv, _), run in _groups(batches, 2):
                _, path = viterbi(model, [r[7:] for r in run], run[0][4], run[0][5])
                for row, role in zip(run, path, strict=True):
                    yield conv, row[2], row[3][row[6] if row[7 + marked] == role + 1 else 0 :], ROLES[role]

        yield from _emit(turns(), ["conv_id", "turn", "body", "role"], [pa.int64(), pa.int64(), pa.string(), pa.string()])

    matrix = dealt(rows, "turn", "body", "is_first", *codes).mapInArrow(matrices, "conv_id long, block long, matrix array<double>")
    ends = matrix.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(chained, "conv_id long, block long, entry int, exit int")
    ends = materialise(ends, "chat").select(F.col("conv_id").alias("of_conv"), F.col("block").alias("of_block"), "entry", "exit")
    both = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("block") == F.col("of_block")))
    return dealt(both, "turn", "body", "entry", "exit", "cut", *codes).mapInArrow(traced, "conv_id long, turn long, body string, role string")


def render(role: Column, body: Column) -> Column:
    """One canonical turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(body), F.lit("\n<|end|>\n"))


def format_turns(turns: DataFrame, known: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``conv_id, turn, role`` and ``rendered`` of every turn of ``turns`` (conv_id, turn, role, text).

    Roles of ``turns`` only count towards the model; ``known`` may blank some of them.
    """
    seen = materialise(observe(turns), "chat-seen")
    found = decode(seen, fit(known(seen)))
    return found.select("conv_id", "turn", "role", render(F.col("role"), F.col("body")).alias("rendered"))
