"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every historical version of a file is content-addressed by SHA-256. A ledger in a shared folder holds which
blobs were scanned by which rule version, and the findings. A run scans only unseen pairs of blob and rule
version, appends to the ledger, and joins the findings of the rule versions in force back to every path that ever
held the blob. A rule's pattern may only change with its version.

Positions come from one anchored pattern: ``\\G``, a lazy gap, the rule. Its matches tile the text up to the
last finding, so running sums of gap and match lengths are the spans, in code points, end exclusive.

Rows and edge cases
-------------------
* null text: the empty text; null ``doc_id``: kept as null
* matches of one kind don't overlap; matches of two kinds may, and both are returned
* a text may hold any number of findings: they are rows, never one growing value, until they meet per blob
* copies are scanned once: one row for each blob reaches a scan, combined before the shuffle
* ties of start: by kind as listed; repeated rows: one output row each; empty table: empty result
* other input columns are ignored by ``scan``; ``redact`` returns them as they are, whatever their names
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, packed_rows, probable, scratch_path, unpacked


@dataclass(frozen=True)
class Rule:
    """A pattern without own groups but the one whose length counts; ``version`` changes with any other part."""

    kind: str
    pattern: str
    version: int = 1
    #: group of ``pattern`` that must have ``least`` characters; 0: the whole match
    group: int = 0
    least: int = 1


# The three base kinds, in the order in which ties are listed.
BASE = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=1,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
)
#: What the operator finds besides: headers of private keys.
RULES = (*BASE, Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"))
#: Only a text that a cheap search hits is tiled; a match of the rule implies one of the search.
SEARCH = {"assign": BASE[0].pattern[: -len("+)")] + "{12})", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}


def _matches(text: Column, rule: Rule) -> Column:
    """Lengths of gap and match, in characters and bytes, and whether the group that counts is long enough, for each match."""
    tiles = rf"\G([\s\S]*?)({rule.pattern})"

    def group(k: int) -> Column:
        return F.regexp_extract_all(text, F.lit(tiles), F.lit(k))

    zipped = F.arrays_zip(group(1).alias("gap"), group(2).alias("hit"), group(2 + rule.group).alias("counts"))
    sizes = F.transform(
        zipped,
        lambda x: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.version).alias("version"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("size"),
            F.octet_length(x["gap"]).alias("gap_bytes"),
            F.octet_length(x["hit"]).alias("bytes"),
            (F.length(x["counts"]) >= rule.least).alias("good"),
        ),
    )
    none = F.expr("cast(array() as array<struct<kind: string, version: int, gap: int, size: int, gap_bytes: int, bytes: int, good: boolean>>)")
    return F.when(text.rlike(SEARCH.get(rule.kind, rule.pattern)), sizes).otherwise(none)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _signature(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def _is_written(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(
        jvm.org.apache.hadoop.fs.Path(path)
    )


def scan_new_blobs(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the pairs of blob and rule version that ``ledger`` doesn't list, and append them. ``versions``: text.

    Findings are appended before the list of pairs; a run that dies between scans the same pairs again, and
    ``findings`` reads repeated rows once.
    """
    spark = versions.sparkSession
    texts = versions.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    every = F.array(*(F.lit(_signature(r)) for r in rules))
    if _is_written(spark, f"{ledger}/seen"):
        seen = spark.read.parquet(f"{ledger}/seen").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
        # Only hashes are looked up in the ledger; texts of blobs that are wholly done don't move.
        asked = texts.select("blob").distinct().join(seen, "blob", "left")
        asked = asked.select("blob", F.array_except(every, F.coalesce("done", F.expr("array()"))).alias("todo")).where(F.size("todo") > 0)
        todo = materialise(asked, "secret-todo")
        if todo.isEmpty():
            return
        likely = texts.where(probable(todo.select(F.xxhash64("blob").alias("h")), "h")(F.xxhash64("blob")))
        blobs = likely.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    else:
        todo = texts.select("blob").distinct().withColumn("todo", every)
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)
    found = F.flatten(
        F.array(*(F.when(F.array_contains("todo", _signature(r)), _matches(F.col("text"), r)).otherwise(F.expr("array()")) for r in rules))
    )
    tiles = blobs.select("blob", F.posexplode(found).alias("at", "m")).select("blob", "at", "m.*")
    along = Window.partitionBy("blob", "kind").orderBy("at")
    spans = (
        tiles.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(along))
        .withColumn("byte_end", F.sum(F.col("gap_bytes").cast("long") + F.col("bytes")).over(along))
        .where("good")
        .select("blob", "kind", "version", (F.col("end") - F.col("size")).alias("start"), "end", (F.col("byte_end") - F.col("bytes")).alias("byte_start"), "byte_end")
    )
    spans.write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger}/seen")


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with findings of ``rules``, at their versions: ``spans``, an array of start, place of the kind, kind, end and bounds in bytes, in order."""
    place = F.array_position(F.array(*(F.lit(_signature(r)) for r in rules)), F.concat_ws("@", "kind", "version"))
    rows = spark.read.parquet(f"{ledger}/findings").distinct().withColumn("place", place).where("place > 0")
    each = F.struct("start", "place", "kind", "end", "byte_start", "byte_end")
    # Written, so that joins with it have both sides dealt anew and a common blob can be split over tasks.
    return materialise(rows.groupBy("blob").agg(F.array_sort(F.collect_list(each)).alias("spans")), "secret-findings")


_NONE = "cast(array() as array<struct<start: bigint, place: bigint, kind: string, end: bigint, byte_start: bigint, byte_end: bigint>>)"


def scan(paths: DataFrame, key: str = "doc_id", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key``, ``blob`` and ``spans`` for every row of ``paths`` (columns ``key`` and text), through the ledger.

    Without a ledger's path, a new one is laid in the shared folder.
    """
    ledger = ledger or scratch_path(paths.sparkSession, "secret-ledger")
    scan_new_blobs(paths, ledger, rules)
    held = paths.select(key, blob_id(F.col("text")).alias("blob"))
    found = findings(paths.sparkSession, ledger, rules).withColumnRenamed("blob", "of_blob")
    joined = held.join(found, F.col("blob") == F.col("of_blob"), "left")
    return joined.select(key, "blob", F.coalesce("spans", F.expr(_NONE)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _runs(spans: Column) -> Column:
    """Bounds in bytes of runs of overlapping spans, which are sorted by start: each end is pushed to the furthest one inside its run."""
    start = F.struct(F.expr("cast(array() as array<struct<lo: bigint, hi: bigint>>)").alias("runs"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))

    def step(done: Column, s: Column) -> Column:
        inside = F.struct(done["runs"].alias("runs"), done["lo"].alias("lo"), F.greatest(done["hi"], s["byte_end"]).alias("hi"))
        closed = F.when(done["hi"] < 0, done["runs"]).otherwise(F.array_append(done["runs"], F.struct(done["lo"].alias("lo"), done["hi"].alias("hi"))))
        return F.when(s["byte_start"] < done["hi"], inside).otherwise(F.struct(closed.alias("runs"), s["byte_start"].alias("lo"), s["byte_end"].alias("hi")))

    last = lambda d: F.array_append(d["runs"], F.struct(d["lo"].alias("lo"), d["hi"].alias("hi")))
    return F.aggregate(spans, start, step, last)


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping ``spans`` replaced by ``mark``; pieces are cut by bytes, each once."""

    def pieces(c: Column) -> Column:
        def piece(j: Column) -> Column:
            lo = F.when(j == 0, F.lit(0)).otherwise(F.get(c["runs"], j - 1)["hi"])
            hi = F.when(j == F.size(c["runs"]), F.octet_length(c["raw"])).otherwise(F.get(c["runs"], j)["lo"])
            return F.substring(c["raw"], (lo + 1).cast("int"), (hi - lo).cast("int")).cast("string")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(c["runs"])), piece), mark)

    return F.transform(F.array(F.struct(text.cast("binary").alias("raw"), _runs(spans).alias("runs"))), pieces)[0]


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark`` (overlapping ones by a single mark) and n_chars made to fit.

    Only texts whose blob may have findings move to meet them.
    """
    ledger = scratch_path(docs.sparkSession, "secret-ledger")
    scan_new_blobs(docs, ledger)
    found = findings(docs.sparkSession, ledger)
    rows = packed_rows(docs).withColumn("held", blob_id(F.col("row.text")))
    maybe = probable(found.select(F.xxhash64("blob").alias("h")), "h")(F.xxhash64("held"))
    joined = rows.where(maybe).join(found, F.col("held") == F.col("blob"), "left")
    clean = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(redacted(F.col("row.text"), F.col("spans"), mark))
    touched = unpacked(joined.withColumn("clean", clean), docs, "clean")
    return touched.union(unpacked(rows.where(~maybe).withColumn("clean", F.col("row.text")), docs, "clean"))
