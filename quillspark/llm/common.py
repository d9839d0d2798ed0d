"""What the training-data operators share: scratch folders, input shape and Arrow row mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); where it is unset, a local one in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors.

    Shuffle files of the write go as soon as it is done, since nothing reads them again. ``batch_rows`` bounds the rows
    that are sent to a Python worker at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before, rows_before = spark.conf.get(_CLEANUP, "false"), spark.conf.get(_BATCH)
    spark.conf.set(_CLEANUP, "true")
    if batch_rows is not None:
        spark.conf.set(_BATCH, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
        spark.conf.set(_BATCH, rows_before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing will read again."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the largest bitmap that ``probable`` ships (4 MB), and bits for each value where that many fit.
_MOST_BITS, _BITS_EACH = 25, 32


def probable(held: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that is false only of 64-bit hashes that aren't in ``column`` of ``held``.

    The hashes' low bits fill a bitmap of bounded size, which every task gets; an exact join must follow. When there
    are more values than bits, all pass, and the join moves what it would have moved without the bitmap.

    The bitmap is written as one row. Plans hold the test many times over, and each copy is planned on the driver: it
    only reads that row, and doesn't hold how the bitmap was filled.
    """
    spark = held.sparkSession
    bits = min(_MOST_BITS, max(12, (_BITS_EACH * held.count()).bit_length()))
    words = 1 << (bits - 6)
    at = F.col(column)
    low = at.bitwiseAND(F.lit((1 << bits) - 1))
    own = held.select(F.shiftrightunsigned(low, 6).alias("w"), F.expr(f"shiftleft(1L, int({column} & 63))").alias("b"))
    every = own.union(spark.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")))
    filled = every.groupBy("w").agg(F.bit_or("b").alias("b")).agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("all"))
    bitmap = materialise(filled.select(F.transform("all", lambda x: x["b"]).alias("words")), "bitmap").scalar()

    def test(c: Column) -> Column:
        word = F.get(bitmap, F.shiftrightunsigned(c.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, c.bitwiseAND(F.lit(63)).cast("int"))
        return bit.bitwiseAND(F.lit(1).cast("long")) == 1

    return test


def packed_rows(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unpacked(joined: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``row``, with ``text`` as their text and n_chars, if there is one, made to fit."""

    def column(name: str) -> Column:
        if name == "text":
            return F.col(text).alias("text")
        if name == "n_chars":
            return F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col(f"row.`{name}`").alias(name)

    return joined.select(*map(column, docs.columns))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables between iterations."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one; other columns never meet ours."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[tuple], Iterable[tuple]]], schema: str, batch_rows: int = 4096
) -> DataFrame:
    """``mapInArrow`` for functions of one row.

    ``make()`` runs once a task and returns the function, which gets the row's values as a tuple
    and yields output tuples. Output goes out every ``batch_rows`` rows, so memory is bounded by a batch.
    """
    parsed = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        out: list[tuple] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out.extend(fn(row))
                    if len(out) >= batch_rows:
                        yield _batch(out, arrow_schema)
                        out = []
        if out:
            yield _batch(out, arrow_schema)

    return df.mapInArrow(run, parsed)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
