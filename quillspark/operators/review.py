"""Nested documents: canonical fields, leaves, flags, edits, diffs and their flat export.

A field is ``struct<raw, value, confidence, source, needsReview>``. Documents arrive as JSON and are read with a
fixed schema: unknown shapes become nulls, never errors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import displayed_percent
from quillspark.functions.text import join_list

FIELD = "struct<raw: string, value: string, confidence: double, source: string, needsReview: boolean>"
# Sections of a document with their single fields and their lists, in order.
SECTIONS = {
    "header": (("formNumber", "date", "time"), ()),
    "customerInformation": (("name", "gender", "nationality", "hotelName"), ("referralSources", "healthConditions")),
    "recommendationCard": (("pressure",), ("massageOilScrub", "preferredAreas", "avoidAreas")),
    "staffOnly": (("therapistName", "roomNo", "branch"), ("treatments",)),
}
TREATMENT_SLOTS = 4
#: Slots that hold handwriting, beside every treatment.
HANDWRITTEN = tuple(("header", f) for f in SECTIONS["header"][0]) + tuple(
    (s, f) for s, f in (("customerInformation", "name"), ("customerInformation", "nationality"), ("customerInformation", "hotelName"), ("staffOnly", "therapistName"), ("staffOnly", "roomNo"))
)


def document_schema() -> str:
    def section(fields: tuple[str, ...], lists: tuple[str, ...]) -> str:
        return "struct<" + ", ".join([*(f"{f}: {FIELD}" for f in fields), *(f"{f}: array<{FIELD}>" for f in lists)]) + ">"

    return "struct<schemaVersion: int, " + ", ".join(f"{k}: {section(*v)}" for k, v in SECTIONS.items()) + ">"


def canonical(text: Column) -> Column:
    """A JSON document as the fixed nested type; malformed text gives null."""
    return F.from_json(text, document_schema(), {"mode": "PERMISSIVE"})


def canonical_field(json: Column) -> Column:
    """One field from any of its JSON forms: null, a primitive (its value), or an object."""
    v = F.try_parse_json(json)
    whole = F.from_json(json, FIELD)
    kind = F.schema_of_variant(v)
    plain = F.struct(
        F.try_variant_get(v, "$", "string").alias("raw"), F.try_variant_get(v, "$", "string").alias("value"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("needsReview"),
    )
    return F.when(v.isNull() | (kind == "VOID"), None).when(kind.startswith("OBJECT"), whole).when(kind.startswith("ARRAY"), None).otherwise(plain)


def _list_leaf(name: str) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(F.concat(F.lit(name + "["), i.cast("string"), F.lit("]")).alias("path"), x.alias("field"))


def leaves(doc: Column) -> Column:
    """Every leaf as ``path`` (with list places) and ``field``, in section and key order."""
    parts = []
    for section, (fields, lists) in SECTIONS.items():
        for f in fields:
            parts.append(F.array(F.struct(F.lit(f"{section}.{f}").alias("path"), doc[section][f].alias("field"))))
        for f in lists:
            none = F.array().cast(f"array<struct<path: string, field: {FIELD}>>")
            parts.append(F.coalesce(F.transform(doc[section][f], _list_leaf(f"{section}.{f}")), none))
    return F.filter(F.concat(*parts), lambda x: x["field"].isNotNull())


def flagged(leaf: Column) -> Column:
    return F.coalesce(leaf["field"]["needsReview"], F.lit(False))


def flagged_paths(found: Column) -> Column:
    return F.transform(F.filter(found, flagged), lambda x: x["path"])


def any_flag(found: Column, but: str = "") -> Column:
    """Whether a leaf is flagged, other than those below path ``but``."""
    return F.exists(found, lambda x: flagged(x) & (~x["path"].startswith(but) if but else F.lit(True)))


def unread(field: Column) -> Column:
    return field["value"].isNull() & flagged_field(field)


def flagged_field(field: Column) -> Column:
    return F.coalesce(field["needsReview"], F.lit(False))


def least_confidence(found: Column) -> Column:
    """The least confidence of read leaves; a person's edit counts 1."""
    return F.array_min(
        F.transform(F.filter(found, lambda x: ~unread(x["field"])), lambda x: F.when(x["field"]["source"] == "human", 1.0).otherwise(x["field"]["confidence"]))
    )


def reading_summary(doc: Column) -> Column:
    """How well the machine read the handwriting: slots with writing, those read, and their mean percent, rounded once.

    An edit keeps the machine's reading and counts if it has one; ink that couldn't be read counts 0.
    """
    slots = [doc[section][f] for section, f in HANDWRITTEN]
    every = F.filter(F.concat(F.array(*slots), F.coalesce(doc["staffOnly"]["treatments"], F.array().cast(f"array<{FIELD}>"))), lambda x: x.isNotNull())
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    written = F.filter(every, lambda x: ~F.coalesce(x["source"] == "ink-mark", F.lit(False)) & (~blank(x["raw"]) | ~blank(x["value"]) & ~F.coalesce(x["source"] == "human", F.lit(False)) | (F.coalesce(x["source"] == "none", F.lit(False)) & flagged_field(x))))
    seen = lambda x: ~blank(x["value"]) | F.coalesce(x["source"] == "human", F.lit(False))
    percent = lambda x: F.when(seen(x), F.when(x["confidence"] <= 1, x["confidence"] * 100).otherwise(F.coalesce(x["confidence"], F.lit(0.0)))).otherwise(0.0)
    total = F.aggregate(F.transform(written, percent), F.lit(0.0), lambda a, x: a + x)
    return F.struct(
        F.size(written).cast("long").alias("with_writing"), F.size(F.filter(written, seen)).cast("long").alias("n_read"),
        F.when(F.size(written) > 0, F.floor(total / F.size(written) + 0.5)).alias("percent"),
    )


def cleared(field: Column) -> Column:
    return field.withField("needsReview", F.lit(False))


def edited(field: Column, value: Column) -> Column:
    """A field after a person's edit: the raw reading stays."""
    return F.when(field["value"].eqNullSafe(value), cleared(field)).otherwise(
        cleared(field).withField("value", value).withField("confidence", F.lit(1.0)).withField("source", F.lit("human"))
    )


def diff(old: Column, new: Column) -> Column:
    """Change rows ``field, old_raw, verified_value, confirms`` between two arrays of leaves, by path; removals end in ``.removed``.

    Only an edit with both a raw and a value confirms.
    """
    by_path = lambda found: F.map_from_entries(F.transform(found, lambda x: F.struct(x["path"], x["field"])))
    before, now = by_path(old), by_path(new)

    def change(x: Column) -> Column:
        was = F.try_element_at(before, x["path"])
        confirms = F.coalesce((F.length(was["raw"]) > 0) & (F.length(x["field"]["value"]) > 0), F.lit(False))
        return F.struct(x["path"].alias("field"), was["raw"].alias("old_raw"), x["field"]["value"].alias("verified_value"), confirms.alias("confirms"))

    moved = F.filter(new, lambda x: ~F.try_element_at(before, x["path"])["value"].eqNullSafe(x["field"]["value"]))
    gone = F.filter(old, lambda x: F.try_element_at(now, x["path"]).isNull())
    removed = lambda x: F.struct(F.concat(x["path"], F.lit(".removed")).alias("field"), x["field"]["raw"].alias("old_raw"), F.lit(None).cast("string").alias("verified_value"), F.lit(False).alias("confirms"))
    return F.concat(F.transform(moved, change), F.transform(gone, removed))


def leaf_percent(field: Column) -> Column:
    """Edited 100, unread null, else the displayed percent."""
    return F.when(field["source"] == "human", F.lit(100).cast("long")).when(~unread(field), displayed_percent(field["confidence"]))


def flat_columns(doc: Column, detail: bool = False) -> list[Column]:
    """Export columns of a canonical document: values, then with ``detail`` raw, percent and flag of each field; lists are joined
    and the first treatments have columns of their own."""
    out = []
    for section, (fields, lists) in SECTIONS.items():
        for f in fields:
            field = doc[section][f]
            out.append(field["value"].alias(f"{section}_{f}"))
            if detail:
                out += [field["raw"].alias(f"{section}_{f}_raw"), leaf_percent(field).alias(f"{section}_{f}_percent"), flagged_field(field).alias(f"{section}_{f}_flag")]
        for f in lists:
            items = doc[section][f]
            if f == "treatments":
                out += [F.get(items, F.lit(k))["value"].alias(f"treatment_{k + 1}") for k in range(TREATMENT_SLOTS)]
                items = F.when(F.size(items) > TREATMENT_SLOTS, F.slice(items, TREATMENT_SLOTS + 1, 1_000_000))
            out.append(join_list(F.transform(items, lambda x: x["value"])).alias(f"{section}_{f}"))
            if detail:
                flag = F.when(F.size(doc[section][f]) > 0, F.exists(doc[section][f], flagged_field))
                out.append(flag.alias(f"{section}_{f}_flag"))
    return out


def treatment_minutes(items: Column, total: Column) -> Column:
    """The sum of numeric minutes when there are any, else the numeric total."""
    numbers = F.filter(F.transform(items, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)).otherwise(total.try_cast("double"))


def allowed_details(details: Column, allowed: tuple[str, ...], most_bytes: int = 4096) -> Column:
    """A detail map's allowed keys without those that name secrets; null when its JSON is too long."""
    kept = F.map_filter(details, lambda k, v: k.isin(*allowed) & ~k.rlike("(?i)pass|secret|token|cookie|authorization|session"))
    return F.when(F.octet_length(F.to_json(kept)) <= most_bytes, kept)


def apply_confidence(rows: DataFrame, thresholds: dict[str, float], token_floor: float = 0.5) -> DataFrame:
    """Confidence of fields (kind, confidence, needs_review, mean_logprob, min_prob) lowered to the model's.

    Digit kinds take the weakest token, others the mean; a field is flagged under its threshold or the token floor.
    """
    model = F.when(F.col("kind").isin("formNumber", "date", "time", "room"), F.col("min_prob")).otherwise(F.exp("mean_logprob"))
    limit = F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv))[F.col("kind")]
    low = (model < limit) | (F.col("min_prob") < token_floor)
    return rows.withColumns({"confidence": F.coalesce(F.least("confidence", model), F.col("confidence")), "needs_review": F.col("needs_review") | F.coalesce(low, F.lit(False))})
