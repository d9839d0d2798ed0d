"""The pipeline's near-copy stage against brute force over five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from conftest import TESTDATA

pytest.importorskip("xxhash")
from quillspark.llm import near_copies, simhash  # noqa: E402

SF = str(TESTDATA / "sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_kept(texts):
    """Ids that are the smallest of their component over all pairs with a Jaccard similarity of 0.8."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i for i in sets if find(i) == i}


def edited_copies():
    r = random.Random(21)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        base = r.choices(vocabulary, k=r.randint(5, 160))
        texts.append(base)
        for _ in range(r.randint(0, 5)):
            near = list(r.choice(texts[-3:]))
            for _ in range(r.randint(0, 5)):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            texts.append(near)
    r.shuffle(texts)
    rows = {i: " ".join(t) for i, t in enumerate(texts)}
    return rows | {500: None, 501: "", 502: " \n", 503: "two words", 504: "Two  words", 505: "a"}


def test_stage_equals_brute_force(spark):
    texts = edited_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], SCHEMA).repartition(3)
    stage = corpus_pipeline.keep_one_of_copies(spark, docs, SF)
    assert stage.columns == docs.columns
    assert {x.doc_id for x in stage.collect()} == plain_kept(texts)


def test_stage_equals_brute_force_on_the_fixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
    assert {x.doc_id for x in corpus_pipeline.keep_one_of_copies(spark, docs, SF).collect()} == plain_kept(texts)


def test_rows_without_or_with_one_id(spark):
    rows = [(None, "same text", "en", "s", 9), (3, "same text", "en", "s", 9), (4, "same text", "en", "s", 9), (7, "twice", "en", "s", 5), (7, "twice", "en", "s", 5)]
    got = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(x.doc_id or -1 for x in got) == [-1, 3, 7, 7]
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parity_bound_drops_no_similar_pair():
    r = random.Random(5)
    for _ in range(300):
        n = r.choice([1, 3, 40, 170, 3000])
        base = [r.getrandbits(64) for _ in range(n)]
        near = [x if r.random() > 0.12 else r.getrandbits(64) for x in base] + [r.getrandbits(64) for _ in range(r.randint(0, n // 10))]
        a, b = (near_copies.np.unique(near_copies.np.array(x, near_copies.np.uint64)) for x in (base, near))
        differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(near_copies.parities(a), near_copies.parities(b), strict=True))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_shared_keys_keep_rows_that_meet(spark):
    r = random.Random(6)
    rows = [(r.randrange(3000), i, 9, 0, 0) for i in range(3000)] + [(7000, i, 9, 0, 1 + i % 3) for i in range(40)] + [(8000, 1, 9, 0, 2)]
    keys = spark.createDataFrame(rows, "key long, id long, n int, at int, part int").repartition(4)
    often = {k: sum(x[0] == k for x in rows) for k in {x[0] for x in rows}}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (before, "1", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sorted(tuple(x) for x in near_copies.shared_keys(keys).collect())
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert got == sorted(x[:4] for x in rows if often[x[0]] > 1 or x[4])


def test_components_of_fingerprints_decide_what_prefix_keys_do(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    # 0 to 2 are alike by their fingerprints; 3 is similar to 0 by its shingles, but further away; 9 to 11 are alone.
    texts = {i: " ".join([*base, *(f"end{i}x{k}" for k in range(i))]) for i in range(3)}
    texts[3] = " ".join([*base[:2750], *(f"other{k}" for k in range(250))])
    texts |= {i: " ".join(f"v{i}x{k}" for k in range(60)) for i in range(9, 12)}
    prints = [simhash.majority(near_copies.shingles(texts[i])) for i in range(4)]
    assert all((prints[0] ^ prints[i]).bit_count() <= 3 for i in (1, 2)) and (prints[0] ^ prints[3]).bit_count() > 3
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    seen, shared = [], near_copies.shared_keys

    def spy(keys):
        seen.append([(x.key, x.id) for x in shared(keys).collect()])
        return shared(keys)

    monkeypatch.setattr(near_copies, "shared_keys", spy)
    want = {0: 0, 1: 0, 2: 0, 3: 0, 9: 9, 10: 10, 11: 11}
    assert {x.doc_id: x.component_id for x in near_copies.components(docs).collect()} == want
    stars = simhash.stars
    monkeypatch.setattr(near_copies.simhash, "stars", lambda distinct: stars(distinct).limit(0))
    assert {x.doc_id: x.component_id for x in near_copies.components(docs).collect()} == want
    with_prints, without = (set(x) for x in seen)
    assert with_prints < without
    # What is left has a key of the text that fingerprints didn't link.
    far = {key for key, i in with_prints if i == 3}
    assert with_prints and {key for key, _ in with_prints} == far
