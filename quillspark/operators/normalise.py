"""Branches, nationalities, therapists and treatments of raw answers, matched to master lists.

Each operator adds a struct ``{value, confidence, source, needsReview}`` to its rows. A distinct text is matched once; the
rules over scores are column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import THAI_DIGITS, best_match, match_key

# Scores from which a match counts, is sure, or at which it is held.
REVIEW_BELOW = 0.85
NATIONALITY_FROM, NATIONALITY_SURE, ONE_TOKEN = 0.8, 0.9, 0.8
THERAPIST_FROM, SEED_AT_MOST = 0.65, 0.8
TREATMENT_FROM, BY_ALIAS = 0.6, 0.95
# What is printed in the staff box beside branch names.
PRINTED = ("staff only", "ploenchit", "makkha", "health & spa")
_RESTRICTED = r"(?:[(（]\s*)?仅[^\s)）]*(?:\s*[)）])?"

_NAME_BREAK = r"(?U)\s*[/+＋&,，]\s*|\sและ\s+"
_TOKEN_BREAK = r"(?U)[\s,;/|()\[\]]+"


def _field(value: Column, confidence: Column | float, source: Column | str, review: Column | bool) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(value.cast("string").alias("value"), lit(confidence).cast("double").alias("confidence"), lit(source).alias("source"), lit(review).alias("needsReview"))


def _latin_digits(text: Column) -> Column:
    return F.translate(text, THAI_DIGITS, "0123456789")


def _spaced(name: str) -> str:
    """A pattern of a printed name's words with any space, or none, between them."""
    return r"\s*".join(re.escape(w) for w in name.translate(str.maketrans(THAI_DIGITS, "0123456789")).split())


def _standing_alone(name: str) -> str:
    return rf"(?<![A-Za-z0-9]){_spaced(name)}(?![A-Za-z0-9])"


def _branch_spellings(branches: list[dict], most: int) -> list[tuple[str, str, bool]]:
    found = [(e["name"], s, s != e["name"]) for e in branches for s in (e["name"], *e.get("aliases", [])) if s.strip()]
    if len(found) > most:
        raise ValueError(f"branches have at most {most} spellings, as each is an expression")
    return found


def branch(staff_text: Column, branches: list[dict], most: int = 500) -> Column:
    """The branch printed in a staff box: the first entry in list order that stands in the text by name (1.0) or alias (0.95).

    Nothing found, a null or an empty text gives null, which needs no review.
    """
    text = _latin_digits(F.coalesce(staff_text, F.lit("")))
    hits = [
        F.when(text.rlike(f"(?iU){_standing_alone(spelling)}"), _field(F.lit(name), BY_ALIAS if is_alias else 1.0, "rule", False))
        for name, spelling, is_alias in _branch_spellings(branches, most)
    ]
    return F.coalesce(*hits, _field(F.lit(None), 0.0, "none", False))


def without_print(staff_text: Column, branches: list[dict], most: int = 500) -> Column:
    """A staff answer without printed text and branch names, each replaced by a space; null stays null."""
    printed = [_spaced(p) for p in PRINTED] + [_RESTRICTED] + [_standing_alone(s) for _, s, _ in _branch_spellings(branches, most)]
    return F.regexp_replace(_latin_digits(staff_text), f"(?iU)(?:{'|'.join(printed)})", " ")


def _with_match(rows: DataFrame, raw: Column, masters: DataFrame, scope: Column | None = None) -> DataFrame:
    """``rows`` packed as ``_row``, with ``_raw``, ``_scope`` and the best entry's ``_name``, ``_score``, ``_alias``."""
    packed = rows.select(F.struct("*").alias("_row"), raw.alias("_raw"), (F.lit(None).cast("string") if scope is None else scope).alias("_scope"))
    found = best_match(packed, "_raw", masters, scope=None if scope is None else "_scope")
    on = packed._raw == found.raw
    if scope is not None:
        on &= packed._scope.eqNullSafe(found.scope)
    return packed.join(found, on, "left").select("_row", "_raw", "_scope", F.col("name").alias("_name"), F.coalesce("score", F.lit(0.0)).alias("_score"), F.coalesce("is_alias", F.lit(False)).alias("_alias"), F.col("ordinal").alias("_entry"))


def nationality(rows: DataFrame, raw: str, masters: DataFrame, out: str, fallback: Column | None = None) -> DataFrame:
    """``rows`` with the nationality of ``raw`` as ``out``.

    A score of 0.8 is a match, flagged below 0.9 or where the label was guessed (``fallback``). Else the one entry that
    single words equal, flagged; else the text itself at 0.5, flagged. Null: null at 0.0, flagged.
    """
    named = rows.select(F.struct("*").alias("_all"), F.col(raw).alias("_text"), (F.lit(False) if fallback is None else F.coalesce(fallback, F.lit(False))).alias("_guess"))
    matched = _with_match(named, F.col("_text"), masters)
    spelled = masters.select("name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("s")).select("name", match_key(F.col("s")).alias("key")).distinct()
    words = named.select("_text").where("_text IS NOT NULL").distinct().select("_text", F.explode(F.array_distinct(F.split("_text", _TOKEN_BREAK))).alias("w"))
    hits = words.select(F.col("_text").alias("asked"), match_key(F.col("w")).alias("key")).where("key <> ''").join(F.broadcast(spelled), "key")
    # best_match has checked the list's size; a text's hits are at most the list.
    single = hits.groupBy("asked").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low = high").select("asked", "low")
    every = matched.join(single, matched._raw == single.asked, "left")
    answer = (
        F.when(F.col("_raw").isNull(), _field(F.lit(None), 0.0, "none", True))
        .when(F.col("_score") >= NATIONALITY_FROM, _field(F.col("_name"), F.col("_score"), "master-fuzzy", F.col("_row._guess") | (F.col("_score") < NATIONALITY_SURE)))
        .when(F.col("low").isNotNull(), _field(F.col("low"), ONE_TOKEN, "master-fuzzy", True))
        .otherwise(_field(F.col("_raw"), 0.5, "ocr", True))
    )
    return every.select("_row._all.*", answer.alias(out))


def therapist(rows: DataFrame, raw: str, branch_of: str, masters: DataFrame, out: str) -> DataFrame:
    """``rows`` with the therapists of ``raw`` as ``out``; ``masters`` has ordinal, name, aliases, scope (a branch) and seed.

    Names between ``/ + & ,`` or the Thai "and" are matched one by one among the branch's entries and those of no branch
    (no branch: all). Below 0.65 a name has no match and stays as written; a seed entry holds at most 0.8. The weakest
    name gives the confidence, and all must be sure (0.85, no seed) to need no review. Null or empty: null, flagged.
    """
    asked = rows.select(F.col(raw).alias("_text"), F.nullif(F.col(branch_of), F.lit("")).alias("_branch")).where("_text <> ''").distinct()
    parts = F.filter(F.transform(F.split(F.trim("_text"), _NAME_BREAK), lambda p: F.trim(p)), lambda p: F.btrim(p, F.lit(" .")) != "")
    names = asked.select("_text", "_branch", F.posexplode(F.when(F.size(parts) > 1, parts).otherwise(F.array("_text"))).alias("_at", "_part"))
    found = _with_match(names, F.col("_part"), masters, F.col("_branch"))
    seeds = masters.where("seed").select(F.col("ordinal").alias("_seed")).distinct()  # best_match has checked the list's size
    each = found.join(F.broadcast(seeds), F.col("_entry") == F.col("_seed"), "left").withColumn("_is_seed", F.col("_seed").isNotNull())
    known = F.col("_score") >= THERAPIST_FROM
    each = each.select(
        "_row._text", "_row._branch", "_row._at", "_row._part", F.when(known, F.col("_name")).alias("_value"),
        F.when(known & F.col("_is_seed"), F.least("_score", F.lit(SEED_AT_MOST))).otherwise(F.col("_score")).alias("_held"),
        (known & ~F.col("_is_seed") & (F.col("_score") >= REVIEW_BELOW)).alias("_sure"),
    )
    text = each.groupBy("_text", "_branch").agg(
        F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_value", "_part").alias("shown"), "_value"))).alias("_names"), F.min("_held").alias("_least"), F.bool_and("_sure").alias("_all_sure")
    )  # one text's names
    shown = F.when(F.size("_names") > 1, F.array_join("_names.shown", " / ")).otherwise(F.col("_names")[0]["_value"])
    answer = text.select(F.col("_text").alias("_t"), F.col("_branch").alias("_b"), _field(shown, F.col("_least"), "master-fuzzy", ~F.col("_all_sure")).alias("_answer"))
    packed = rows.select(F.struct("*").alias("_row"), F.col(raw).alias("_text"), F.nullif(F.col(branch_of), F.lit("")).alias("_branch"))
    joined = packed.join(answer, (F.col("_text") == F.col("_t")) & F.col("_branch").eqNullSafe(F.col("_b")), "left")
    return joined.select("_row.*", F.coalesce("_answer", _field(F.lit(None), 0.0, "none", True)).alias(out))


def treatment(rows: DataFrame, raw: str, masters: DataFrame, out: str) -> DataFrame:
    """``rows`` with the treatment that ``raw`` names as ``out``: by name 1.0, by alias 0.95, from 0.6 a suggestion, else null.

    What is below 0.85 needs review. Null: null at 0.0, flagged.
    """
    every = _with_match(rows, F.col(raw), masters)
    held = F.when(F.col("_alias"), F.lit(BY_ALIAS)).otherwise(F.col("_score"))
    answer = _field(F.when(held >= TREATMENT_FROM, F.col("_name")), held, F.when(F.col("_alias"), "rule").when(F.col("_raw").isNull(), "none").otherwise("master-fuzzy"), held < REVIEW_BELOW)
    return every.select("_row.*", answer.alias(out))
