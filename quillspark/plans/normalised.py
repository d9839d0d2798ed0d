"""Queries of answers matched to master lists; names are one repeated letter a nation, so SQL can tell their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import normalise
from quillspark.plans.registry import Tables, query


def _letters(key: str, n: int) -> Column:
    return F.repeat(F.chr(97 + F.col(key)), F.lit(n))


def _people(t: Tables) -> DataFrame:
    """Eight letters a nation, its region as scope, two letters and a hash as alias; every fifth is a seed."""
    return t.nation.select(
        F.col("n_nationkey").alias("ordinal"), _letters("n_nationkey", 8).alias("name"), F.array(F.concat(_letters("n_nationkey", 2), F.lit("#"))).alias("aliases"),
        F.concat(F.lit("REGION "), F.col("n_regionkey")).alias("scope"), (F.col("n_nationkey") % 5 == 0).alias("seed"),
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'Branch ' || c_nationkey END AS branch, CASE c_custkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || CASE c_custkey % 3 WHEN 1 THEN '' ELSE ' xbranch' || c_nationkey END END AS rest FROM customer""")
def printed_branches(t: Tables) -> DataFrame:
    """Rows 100, 101: the branch printed in a staff box, by name or alias in any spacing, and the text without print."""
    branches = [{"name": f"Branch {k}", "aliases": [f"Lane {k} no. {k}"]} for k in range(25)]
    key = F.col("c_nationkey").cast("string")
    printed = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" BRANCH"), key)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" lane  "), key, F.lit(" NO."), key)).otherwise(F.concat(F.lit(" xbranch"), key))
    staff = F.concat(F.lit("STAFF  ONLY （仅限员工） "), "c_name", printed)
    found = normalise.branch(staff, branches)
    rest = F.trim(F.regexp_replace(normalise.without_print(staff, branches), r"\s+", " "))
    return t.customer.select("c_custkey", found["value"].alias("branch"), found["confidence"].alias("confidence"), rest.alias("rest"))


@query("""WITH r AS (SELECT c_custkey, c_custkey % 5 AS form, repeat(chr(CAST(97 + c_nationkey AS INT)), 8) AS own, repeat(chr(CAST(97 + (c_nationkey + 1) % 25 AS INT)), 8) AS other FROM customer)
  SELECT c_custkey, CASE form WHEN 3 THEN own || ' ' || other || ' 0123' WHEN 4 THEN '0123' ELSE own END AS nationality,
    CASE form WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 14.0::DOUBLE / 15 WHEN 2 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence, form > 1 OR c_custkey % 2 = 1 AS needs_review FROM r""")
def nationalities(t: Tables) -> DataFrame:
    """Row 106: a like name, else the one entry that single words equal, else the text."""
    form, own, other = F.col("c_custkey") % 5, _letters("c_nationkey", 8), F.repeat(F.chr(97 + (F.col("c_nationkey") + 1) % 25), F.lit(8))
    raw = F.when(form == 0, F.upper(own)).when(form == 1, _letters("c_nationkey", 7)).when(form == 2, F.concat(F.lit("0123456789 ("), own, F.lit(")"))).when(form == 3, F.concat(own, F.lit(" "), other, F.lit(" 0123"))).otherwise(F.lit("0123"))
    rows = t.customer.select("c_custkey", raw.alias("raw"))
    found = normalise.nationality(rows, "raw", _people(t), "field", F.col("c_custkey") % 2 == 1)
    return found.select("c_custkey", F.col("field.value").alias("nationality"), F.col("field.confidence").alias("confidence"), F.col("field.needsReview").alias("needs_review"))


@query("""WITH r AS (SELECT c_custkey, c_custkey % 4 AS form, n_nationkey % 5 = 0 AS seed, repeat(chr(CAST(97 + n_nationkey AS INT)), 8) AS own FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT c_custkey, CASE form WHEN 1 THEN own || ' / 0123' WHEN 2 THEN own || ' / ' || own WHEN 3 THEN NULL ELSE own END AS therapist,
    CASE WHEN form IN (1, 3) THEN 0.0::DOUBLE WHEN seed THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence, form IN (1, 3) OR seed AS needs_review FROM r""")
def therapists(t: Tables) -> DataFrame:
    """Row 107: each name among the branch's entries; a name of another branch has no match."""
    form, own = F.col("c_custkey") % 4, _letters("n_nationkey", 8)
    raw = F.when(form == 1, F.concat(own, F.lit(" + 0123"))).when(form == 2, F.concat(own, F.lit(" และ "), F.upper(own))).otherwise(own)
    scope = F.concat(F.lit("REGION "), F.when(form == 3, 99).otherwise(F.col("n_regionkey")))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", raw.alias("raw"), scope.alias("branch"))
    found = normalise.therapist(rows, "raw", "branch", _people(t), "field")
    return found.select("c_custkey", F.col("field.value").alias("therapist"), F.col("field.confidence").alias("confidence"), F.col("field.needsReview").alias("needs_review"))


@query("""WITH r AS (SELECT p_partkey, p_partkey % 4 AS form, repeat(chr(CAST(97 + p_partkey % 25 AS INT)), 8) AS own FROM part)
  SELECT p_partkey, CASE WHEN form < 3 THEN own END AS treatment, CASE form WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 10.0::DOUBLE / 13 ELSE 8.0::DOUBLE / 14 END AS confidence, form > 1 AS needs_review FROM r""")
def treatments(t: Tables) -> DataFrame:
    """Rows 108, 109: by name, by alias, as a suggestion, or not at all."""
    form, letter = F.col("p_partkey") % 4, F.chr(97 + F.col("p_partkey") % 25)
    raw = F.when(form == 0, F.upper(F.repeat(letter, F.lit(8)))).when(form == 1, F.concat(letter, letter, F.lit("#"))).when(form == 2, F.repeat(letter, F.lit(5))).otherwise(F.concat(F.repeat(letter, F.lit(4)), F.lit("01")))
    found = normalise.treatment(t.part.select("p_partkey", raw.alias("raw")), "raw", _people(t), "field")
    return found.select("p_partkey", F.col("field.value").alias("treatment"), F.col("field.confidence").alias("confidence"), F.col("field.needsReview").alias("needs_review"))
