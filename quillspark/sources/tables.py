"""Sources and sinks: scoped tables, tolerant JSON lines, labels, content sniffing, object keys, guarded CSV, JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import csv_cell, csv_line
from quillspark.operators.documents import visible

_KEY = r"^org/([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})/original/([0-9a-z]{2})/([0-9a-z]{32})$"
# Magic bytes of the accepted types, in hex digits.
MAGIC = {"application/pdf": "^255044462D", "image/png": "^89504E470D0A1A0A", "image/jpeg": "^FFD8FF", "image/webp": "^52494646.{8}57454250"}
BOM = "﻿"


def scoped(spark: SparkSession, path: str, organization: str) -> DataFrame:
    """A tenant's visible rows. The filter reaches the Parquet scan; it is a default, not a security boundary."""
    return spark.read.parquet(path).where(F.col("organization_id") == organization).where(visible())


def json_lines(lines: DataFrame, line: str, line_no: str, schema: str, key: list[str]) -> DataFrame:
    """Rows of valid JSON lines; blank and invalid ones are skipped, and the last line of a key wins."""
    parsed = lines.where(F.trim(line) != "").where(F.try_parse_json(line).isNotNull()).select(F.col(line_no).alias("_no"), F.from_json(line, schema).alias("r"))
    rows = parsed.select("_no", "r.*")
    columns = [c for c in rows.columns if c not in ("_no", *key)]
    complete = rows.dropna(subset=key)
    last = complete.groupBy(*key).agg(F.max_by(F.struct(*columns), "_no").alias("_r"))
    return last.select(*key, *(F.col(f"_r.{c}") for c in columns))


def unlabelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return rows.join(labels.select(key).distinct(), key, "left_anti")


def sniffed(content: Column, name: Column) -> Column:
    """The type that bytes show; a name is never trusted over them."""
    head = F.hex(F.substring(content, 1, 16))
    out = F
    for kind, magic in MAGIC.items():
        out = out.when(head.rlike(magic), kind)
    return out.otherwise(None)


def object_key(organization: Column, digest: Column) -> Column:
    return F.concat(F.lit("org/"), F.lower(organization), F.lit("/original/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 1, 32))


def parsed_key(key: Column) -> Column:
    """Parts of an object key, or null for any other text."""
    return F.when(key.rlike(_KEY), F.struct(F.regexp_extract(key, _KEY, 1).alias("organization"), F.regexp_extract(key, _KEY, 3).alias("name")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files as path and content; decoding is a later, partition-wise step."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_csv(df: DataFrame, path: str, text_columns: set[str]) -> None:
    """CSV lines with quoting and the formula guard on text; CRLF ends, and each part starts with its header."""
    cells = [csv_cell(F.col(c).cast("string"), c in text_columns) for c in df.columns]
    df.select(csv_line(cells).alias("value")).write.option("lineSep", "\r\n").text(path)


def csv_header(columns: list[str]) -> str:
    return BOM + ",".join(c if not re.search(r'[",\r\n]', c) else '"' + c.replace('"', '""') + '"' for c in columns)


def write_json_lines(df: DataFrame, path: str, stamps: tuple[str, ...] = ()) -> None:
    """One object a line; each time column has a ``_utc`` twin."""
    twins = {f"{c}_utc": F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") for c in stamps}
    full = df.withColumns(twins) if twins else df
    full.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def retained(df: DataFrame, expires_at: str, now: Column) -> DataFrame:
    """Rows that haven't expired; the caller rewrites the table with them."""
    return df.where(F.col(expires_at).isNull() | (F.col(expires_at) > now))
