"""URL filters: fixed host and path rules, then association rules that FP-growth mines from labelled URLs.

A transaction is the set of a bad URL's tokens, of host, path and what follows. Tokens that occur in the very same
labelled URLs are one item, so that what always comes together is mined once and not in all its subsets. A frequent
itemset is a rule if enough of all labelled URLs that hold it are bad, by the lower bound of that share and by its lift;
the second count is made through the same inverted index that matches rules: from each rule's rarest item to the rule,
and a check of its other items. A rule goes if a shorter one is as sure.

Rows and edge cases
-------------------
* null url or one without ``://``: empty host and path, so no rule fits; the method's verdict is ``allow``
* null ``page_id``: kept; labels that are null, or of no page, teach nothing; no labels: no mined rules
* ties: of fitting fixed rules the longest wins; lengths of two rules that fit one url never tie, as they
  are suffixes and prefixes of the same strings unless rules repeat
* very long urls: tokens are a set, matched by equality; repeated rows: one output row each
* empty table: empty result; other input columns are ignored
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialise

# The rules of the contract, as verdict, host and path prefix.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Bad labelled URLs that a mined rule must cover, as a share and as a count; the share of URLs under it that must be
#: bad, as the lower end of Wilson's interval at ``Z`` deviations; and how many times the share of all that must be.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, Z, MIN_LIFT = 0.002, 10, 0.6, 1.96, 1.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tail_of(url: Column) -> Column:
    """Query string and fragment of a URL."""
    return F.coalesce(F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)), F.lit(""))


def tokens(host: Column, path: Column, tail: Column) -> Column:
    """The distinct tokens of host, path and tail, marked by where they stand."""
    def part(mark: str, text: Column) -> Column:
        words = F.array_distinct(F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), ""))
        return F.transform(words, lambda w: F.concat(F.lit(mark), w))

    return F.concat(part("h:", host), part("p:", path), part("q:", tail))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``, else null."""
    out = F
    for verdict, of_host, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(prefix)
        out = out.when(fits, F.struct(F.lit(of_host + prefix).alias("rule"), F.lit(verdict).alias("verdict")))
    return out


def item_classes(labelled: DataFrame) -> DataFrame:
    """``token`` and ``item``, the least token of those that occur in the very same rows of ``url`` and ``tokens``."""
    places = labelled.select(F.xxhash64("url").alias("a"), F.xxhash64(F.lit(1), "url").alias("b"), F.explode("tokens").alias("token"))
    held = places.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.bit_xor("b").alias("b"))
    same = held.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return held.join(same, ["n", "a", "b"]).select("token", "item")


def with_items(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``key`` and ``items``, the classes of each row's tokens, for rows with any."""
    dealt = rows.select(key, F.explode("tokens").alias("token")).join(classes, "token")
    return dealt.groupBy(key).agg(F.collect_set("item").alias("items"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Rules ``rule_id, tokens`` (items), ``confidence, support``, and the classes of tokens, from rows of ``url``, ``tokens`` and ``bad``; a url may have many rows."""
    labelled = materialise(labelled.select(F.monotonically_increasing_id().alias("row"), "url", "tokens", "bad"), "url-labels")
    total, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    classes = materialise(item_classes(labelled.select(F.col("row").cast("string").alias("url"), "tokens")), "url-classes")
    baskets = materialise(with_items(labelled, classes, "row").join(labelled.select("row", "bad"), "row"), "url-baskets")
    least = max(min_count, min_support * total)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(1, bad))).fit(baskets.where("bad"))
    sets = model.freqItemsets.where(F.col("freq") >= least).select(F.sort_array("items").alias("tokens"), "freq").withColumn("rule_id", F.xxhash64("tokens"))
    sets = materialise(sets.withColumn("confidence", F.lit(1.0)), "url-itemsets")
    probes = baskets.select("row", F.col("items").alias("has"), F.explode("items").alias("token"))
    covered = probes.join(_index(sets), "token").where(F.size(F.array_except("needs", "has")) == 0).groupBy("rule_id").agg(F.count("*").alias("n"))
    share, n = F.col("freq") / F.col("n"), F.col("n")
    low = (share + Z * Z / (2 * n) - Z * F.sqrt((share * (1 - share) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    sure = sets.drop("confidence").join(covered, "rule_id").withColumn("confidence", share).where((low >= min_confidence) & (share * total >= MIN_LIFT * bad))
    sure = materialise(sure.select("rule_id", "tokens", "confidence", (F.col("freq") / max(1, total)).alias("support")), "url-rules")
    # A rule goes if a shorter one with its items, of any length, is as sure; shorter ones are found by the index.
    probes = sure.select(F.col("rule_id").alias("whole_id"), F.col("tokens").alias("whole"), F.col("confidence").alias("own"), F.explode("tokens").alias("token"))
    within = F.expr("size(needs) < size(whole) AND confidence >= own AND size(array_except(needs, whole)) = 0")
    shadowed = probes.join(_index(sure), "token").where(within).select(F.col("whole_id").alias("rule_id")).distinct()
    return sure.join(shadowed, "rule_id", "left_anti").select("tokens", "confidence", "support", "rule_id"), classes


def _index(rules: DataFrame) -> DataFrame:
    """``token``, ``needs``, ``confidence`` and ``rule_id``: each rule under its item that is rarest among rules."""
    use = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("rule_id").orderBy("n", "token")
    return (
        rules.withColumn("token", F.explode("tokens")).join(use, "token")
        .withColumn("k", F.row_number().over(rarest)).where("k = 1")
        .select("token", F.col("tokens").alias("needs"), "confidence", "rule_id")
    )


def mined_matches(urls: DataFrame, rules: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``key``, ``mined`` (the surest fitting rule) and its ``confidence``, for urls with a fitting rule.

    The index holds each rule under its item that is rarest among rules, so frequent items start few probes. A url
    has an item if it has any of its tokens.
    """
    needed = rules.select(F.explode("tokens").alias("item")).distinct()
    items = with_items(urls, classes.join(needed, "item"), key)
    probes = items.select(key, F.col("items").alias("has"), F.explode("items").alias("token"))
    fits = probes.join(_index(rules), "token").where(F.size(F.array_except("needs", "has")) == 0)
    best = F.max(F.struct("confidence", F.array_join("needs", "+").alias("mined")))
    return fits.groupBy(key).agg(best.alias("b")).select(key, "b.mined", F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the ``mined`` rule. ``labels``: doc_id of a page and quality (0: bad)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), tail_of(F.col("url")).alias("tail"))
    of_url = tokens(F.col("host"), F.col("path"), F.col("tail"))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    rules, classes = mine(
        parsed.join(known, F.col("page_id") == F.col("doc_id")).where("host <> ''").select(F.col("page_id").cast("string").alias("url"), of_url.alias("tokens"), "bad")
    )
    # Distinct urls are judged once; a url that fills a third of the rows makes one probe.
    urls = parsed.select("host", "path", "tail").distinct().withColumn("url_key", F.sha2(F.concat_ws("\0", "host", "path", "tail"), 256))
    # Written, so that pages meet it with both sides dealt anew and a common url can be split over tasks.
    mined = materialise(mined_matches(urls.withColumn("tokens", of_url), rules, classes, "url_key"), "url-mined").withColumnRenamed("url_key", "of_key")
    return (
        parsed.withColumn("url_key", F.sha2(F.concat_ws("\0", "host", "path", "tail"), 256)).join(mined, F.col("url_key") == F.col("of_key"), "left")
        .withColumn("fixed", fixed_rule(F.col("host"), F.col("path")))
        .select(
            "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
            F.coalesce("fixed.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
            "mined", "confidence",
        )
    )
