"""Quality rules: word statistics of whole texts, and a decision list learned by sequential covering.

The list grows conjunctions of threshold tests on one half of the labelled rows, prunes each on the other
half, and stops when a rule no longer holds there. It is emitted as an ordered Spark conditional expression;
rows that no rule covers are kept.

Rows and edge cases
-------------------
* null text: no words, so it fails the base rules; null ``doc_id``: kept as null, never used for learning
* labels: null or repeated labels of a document count by their mean; fewer than ``MIN_SIDE`` rows of either
  class: an empty list, so only the base rules reject
* ties between candidate tests: the first by feature order, then by threshold, so learning is deterministic
* repeated rows: one output row each; empty table: empty result; other input columns are ignored
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.llm.common import id_and_text, map_rows, materialise

#: Rows that the list is fitted on at most: all labelled ones, or those with the smallest hashes of their ids, about 19 in 20 of this many.
FIT_ROWS = 20_000
#: Labelled rows of either class without which nothing is learned.
MIN_SIDE = 10
#: A rule must hold for this share of the rows it covers, on the pruning half.
PRECISION = 0.9
#: A rule must cover this many bad rows of the growing half, and this many of the pruning half.
SUPPORT, PRUNE_SUPPORT = 4, 2
MAX_TESTS, MAX_RULES = 4, 16
SYMBOLS = b"#*$%&|<>"

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_bangs long, n_lines long"
#: Learned features, all from the statistics.
FEATURES: dict[str, str] = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
}

_UPPER = re.compile(r"[A-Z]+")


def text_stats(text: str) -> tuple[int, ...]:
    """The columns of ``STATS`` after the id. A word is a run without the six ASCII white-space bytes, on which ``bytes.split`` cuts."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    white = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    duplicates = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            end = 0
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, len(text) - white, symbols, duplicates, repeated, upper, raw.count(b"!"), lines


def statistics(docs: DataFrame) -> DataFrame:
    """The statistics of every document's whole text."""

    def make() -> Callable[[tuple], Iterable[tuple]]:
        return lambda v: [(v[0], *text_stats(v[1]))]

    return map_rows(id_and_text(docs), make, STATS)


def with_statistics(docs: DataFrame) -> DataFrame:
    """Each whole row of ``docs`` as the struct ``row``, beside the statistics of its text; nothing is shuffled."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    names = [part.split()[0] for part in STATS.split(", ")]
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.column(0).slice(lo, 512)
                found = zip(*(text_stats(text or "") for text in rows.field(text_at).to_pylist()), strict=True)
                columns = [rows, rows.field(id_at).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in found)]
                yield pa.RecordBatch.from_arrays(columns, ["row", *names])

    schema = StructType([packed.schema["row"], *StructType.fromDDL(STATS).fields])
    return packed.mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the learned list reject."""
    rules = fit(materialise(statistics(docs), "stats"), labels)
    return judge(with_statistics(docs), rules).where("kept").select("row.*")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Test:
    """``feature > at`` if ``above``, else ``feature <= at``."""

    feature: str
    above: bool
    at: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.at if self.above else x[self.feature] <= self.at

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.at!r}D"


Rule = tuple[Test, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, Test] | None:
    """The test with the largest information gain for the covered bad rows."""
    p0, n0 = int(bad[rows].sum()), int((~bad[rows]).sum())
    before = np.log2(p0 / (p0 + n0))
    best: tuple[float, Test] | None = None
    for feature, values in x.items():
        v = values[rows]
        order = np.argsort(v, kind="stable")
        v, b = v[order], bad[rows][order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        below_p = np.cumsum(b)[cuts]
        below_n = cuts + 1 - below_p
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p >= SUPPORT, p * (np.log2(p / (p + n)) - before), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > 0 and (best is None or gain[k] > best[0] + 1e-12):
                at = float((v[cuts[k]] + v[cuts[k] + 1]) / 2)
                best = float(gain[k]), Test(feature, above, at if v[cuts[k]] <= at < v[cuts[k] + 1] else float(v[cuts[k]]))
    return best


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int, int]:
    """Pruning value (p - n) / (p + n), and p and n."""
    hit = _covered(rule, x, len(bad))
    p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0, p, n


def learn(x: dict[str, np.ndarray], bad: np.ndarray, half: np.ndarray) -> list[Rule]:
    """An ordered list of rules that cover bad rows. ``half``: true for the growing half."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & half, left & ~half
        gx, gb = {k: v[grow] for k, v in x.items()}, bad[grow]
        px, pb = {k: v[prune] for k, v in x.items()}, bad[prune]
        if gb.sum() < SUPPORT or not (~gb).any():
            break
        rule: Rule = ()
        rows = np.ones(len(gb), bool)
        while len(rule) < MAX_TESTS and (~gb[rows]).any() and (found := _best_test(gx, gb, rows)):
            rule = (*rule, found[1])
            rows &= found[1].holds(gx)
        candidates = [rule[:k] for k in range(1, len(rule) + 1)]
        if not candidates:
            break
        scored = [(_worth(r, px, pb), r) for r in candidates]
        (_, p, n), rule = max(scored, key=lambda s: (s[0][0], s[0][1], -len(s[1])))
        if p < PRUNE_SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~_covered(rule, x, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that fires, else 0."""
    out = F
    for k, rule in enumerate(rules, 1):
        out = out.when(F.expr(" AND ".join(t.sql() for t in rule)), F.lit(k))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def fit(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learn from at most ``FIT_ROWS`` labelled documents. ``labels`` has doc_id and quality (1: good)."""
    quality = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = (
        stats.join(quality, "doc_id")
        .where(~base_failed())
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality", *(F.expr(f"double({e})").alias(k) for k, e in FEATURES.items()))
    )
    # A cut of the hash takes the sample where the rows are; a top-k would send its k from every partition to the driver.
    share = 0.95 * FIT_ROWS / max(1, known.count())
    if share < 1:
        known = known.where(F.col("h") < int((2 * share - 1) * 2**63))
    chosen = known.limit(FIT_ROWS).toPandas().sort_values(["h", "doc_id", *FEATURES], ignore_index=True)
    bad = (chosen["quality"] < 0.5).to_numpy(bool)
    if min(bad.sum(), (~bad).sum()) < MIN_SIDE:
        return []
    return learn({k: chosen[k].to_numpy(float) for k in FEATURES}, bad, np.arange(len(bad)) % 2 == 0)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with ``base_failed``, ``rule`` (0: none) and ``kept``."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", F.expr("NOT base_failed AND rule = 0"))
