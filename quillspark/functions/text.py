"""Text normalisation: match keys, cleaning, joining, guarding and fuzzy matching.

Everything is a column expression but NFC, HTML entities and the similarity ratio, for which Spark has no
built-in; those are pandas UDFs.
"""

from __future__ import annotations

import difflib
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

# Thai digits; the punctuation that match keys drop; Thai vowels and tone marks above and below;
# the white space that filename keys collapse; control and bidi characters that filenames drop; placeholders.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
KEY_DROP = r"[\s.\-_,:;/()]+"
THAI_MARKS = "[ัิ-ฺ็-๎]"
KEY_SPACES = "[ \\t\\n\\r\\f\\x0B   -     　﻿]+"
FILENAME_DROP = "[\\x00-\\x1f\\x7f-\\x9f​-‏‪-‮⁦-⁩]"
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "unknown", "blank", "empty")
SKELETON_WEIGHT = 0.8
#: A cell of a spreadsheet holds fewer UTF-16 units than this.
CELL_UNITS = 32_000


def ascii_digits(text: Column) -> Column:
    return F.translate(text, THAI_DIGITS, "0123456789")


def match_key(text: Column) -> Column:
    """Digits to ASCII, lower case, spaces and punctuation dropped."""
    return F.regexp_replace(F.lower(ascii_digits(text)), "(?U)" + KEY_DROP, "")


def skeleton(text: Column) -> Column:
    """The match key without Thai vowels and tone marks."""
    return F.regexp_replace(match_key(text), THAI_MARKS, "")


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def score_key(text: Column) -> Column:
    """The scorer's key: NFC and no digit mapping, unlike ``match_key``."""
    return F.regexp_replace(F.lower(nfc(text)), "(?U)" + KEY_DROP, "")


def clean_filename(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(nfc(name), FILENAME_DROP, ""), F.lit("")), F.lit("untitled"))


def filename_key(name: Column, clean: bool = True) -> Column:
    """The key that upload names are compared by; ``clean=False`` for names that were cleaned when stored."""
    return F.lower(F.trim(F.regexp_replace(clean_filename(name) if clean else name, KEY_SPACES, " ")))


def drop_placeholders(items: Column) -> Column:
    """An array without nulls and words that stand for nothing."""
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & ~F.lower(x).isin(*PLACEHOLDERS))


def join_list(items: Column) -> Column:
    """Items joined by ``; ``, nulls dropped; nothing left gives null."""
    return F.nullif(F.array_join(F.filter(items, lambda x: x.isNotNull()), "; "), F.lit(""))


def guard_formula(text: Column) -> Column:
    """A leading quote for text that a spreadsheet would take as a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cell(text: Column, guard: bool = True) -> Column:
    """RFC 4180 cell; null is empty."""
    cell = F.coalesce(guard_formula(text) if guard else text, F.lit(""))
    return F.when(cell.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def csv_line(cells: list[Column]) -> Column:
    return F.concat_ws(",", *cells)


def truncate_units(text: Column, units: int = CELL_UNITS) -> Column:
    """At most ``units`` UTF-16 units, never half a character."""
    @pandas_udf(StringType())
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t.encode("utf-16-le")[: 2 * units].decode("utf-16-le", "ignore"), na_action="ignore")

    # Only a text with more units than fit goes to Python; a character has one or two.
    return F.when(F.length(text) * 2 <= units, text).otherwise(cut(text))


def strip_markup(markup: Column) -> Column:
    """Text of an HTML answer: cells as ``label: value``, block tags as line ends, other tags gone, entities decoded."""
    text = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</t[dh]>\s*<t[dh][^>]*>", ": ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6]|p|div|tr|li|h[1-6])\b[^>]*>", "\n")
    text = unescape(F.regexp_replace(text, r"<[^>]+>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio of lower-cased, trimmed texts; order matters, and it isn't an edit distance."""
    return pd.Series([None if x is None or y is None else ratio(x.lower().strip(), y.lower().strip()) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def _match_score(raw: pd.Series, name: pd.Series, raw_key: pd.Series, raw_bones: pd.Series, bones: pd.Series) -> pd.Series:
    out = []
    for r, n, key, rb, nb in zip(raw, name, raw_key, raw_bones, bones, strict=True):
        score = ratio(r.lower().strip(), n.lower().strip())
        if rb and nb and rb != key:
            score = max(score, SKELETON_WEIGHT * ratio(rb, nb))
        out.append(score)
    return pd.Series(out, dtype="float64")


def best_match(rows: DataFrame, raw: str, masters: DataFrame, most_masters: int = 10_000, scope: str | None = None) -> DataFrame:
    """The best master entry for each distinct ``raw``: ``raw, name, score, is_alias, ordinal``.

    With ``scope``, a column of ``rows`` and of ``masters`` (there named scope), only entries of a row's scope or of none
    are matched, and the result has a scope too; a row without one meets all entries. Empty scopes are none.

    ``masters`` has ordinal, name and aliases, a master list whose size is checked before it is broadcast. An
    equal key wins with 1.0, the first such entry; else the highest score, of ties the first entry.
    """
    if masters.limit(most_masters + 1).count() > most_masters:
        raise ValueError(f"a master list has at most {most_masters} entries")
    none = F.lit(None).cast("string")
    its_scope = F.nullif(F.col("scope"), F.lit("")) if scope else none
    spelled = masters.select("ordinal", "name", its_scope.alias("of_scope"), F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelling_no", "spelling"))
    spelled = spelled.withColumn("key", match_key(F.col("spelling"))).withColumn("bones", skeleton(F.col("spelling")))
    asked = rows.select(F.col(raw).alias("raw"), (F.nullif(F.col(scope), F.lit("")) if scope else none).alias("scope")).where(F.col("raw").isNotNull()).distinct()
    asked = asked.withColumn("raw_key", match_key(F.col("raw"))).withColumn("raw_bones", skeleton(F.col("raw")))
    in_scope = F.col("scope").isNull() | F.col("of_scope").isNull() | (F.col("scope") == F.col("of_scope"))
    order = F.struct("ordinal", "spelling_no")
    exact = asked.where("raw_key <> ''").join(F.broadcast(spelled), (F.col("raw_key") == F.col("key")) & in_scope).groupBy("raw", "scope").agg(F.min_by(F.struct("name", (F.col("spelling_no") > 0).alias("is_alias"), "ordinal"), order).alias("hit"))
    found = exact.select(F.col("raw").alias("found"), F.col("scope").alias("found_scope"))
    left = asked.join(found, (F.col("raw") == F.col("found")) & F.col("scope").eqNullSafe(F.col("found_scope")), "left_anti")
    rest = left.join(F.broadcast(spelled), in_scope) if scope else left.join(F.broadcast(spelled))  # every asked text against a checked master list
    scored = rest.withColumn("score", _match_score("raw", "spelling", "raw_key", "raw_bones", "bones"))
    fuzzy = scored.groupBy("raw", "scope").agg(F.max_by(F.struct("name", "score", "ordinal"), F.struct("score", -F.col("ordinal"), -F.col("spelling_no"))).alias("hit"))
    scopes = ["scope"] if scope else []
    return exact.select("raw", *scopes, "hit.name", F.lit(1.0).alias("score"), "hit.is_alias", "hit.ordinal").union(
        fuzzy.select("raw", *scopes, F.when(F.col("hit.score") > 0, F.col("hit.name")), "hit.score", F.lit(False), "hit.ordinal")
    )
