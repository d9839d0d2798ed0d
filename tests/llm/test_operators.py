"""Each training-data operator against a plain version, and its defined results for odd rows."""

from __future__ import annotations

import itertools
import random
import re
import struct
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillspark.llm import (  # noqa: E402
    bpe,
    chat,
    line_dedup,
    media,
    packing,
    quality_rules,
    secret_scan,
    simhash,
    suffix_dedup,
    url_filter,
)
from quillspark.llm.components import connected_components  # noqa: E402

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
#: Columns that clash with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part long, fp long, row string, key long, blob string"
ODD = [None, "", " \n\t ", "a", "one two", "x" * 64, "é中\U0001f600 " * 40, "\n\n", "word " * 3000, "<|endoftext|> hi", "same text", "same text"]


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 7, 8, "r", 9, "b") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, [*ODD, "no id", "twice", "twice"], [*range(len(ODD)), None, 77, 77])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def words_of(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def noise(r, n, letters="abcdefgh é"):
    return "".join(r.choice(letters) for _ in range(n))


# Secret scans


def plain_spans(text):
    out = []
    for place, (kind, pattern, group, least) in enumerate((
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    )):
        out += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secret_spans_equal_a_plain_scan(spark):
    r = random.Random(2)
    parts = ["token", "API_KEY", "secret", "passwd", " = ", ":", '"', "AKIA", "ABCD1234EFGH5678", "deadbeefdeadbeef", "é\U0001f600", " ", "\n", "abcdefghijklmnop", "=", "x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(300)]
    texts += ["token=secret=" + "a" * 12, "token: secret=\"abcdefghijklmnop\"", "f" * 5000, None, ""]
    got = {x.doc_id: x.s for x in secret_scan.scan(docs_of(spark, texts)).select("doc_id", secret_scan.joined(F.col("spans")).alias("s")).collect()}
    assert got == {i: plain_spans(t or "") for i, t in enumerate(texts)}


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    secret_scan.scan(docs_of(spark, ["token=abcdefghijkl", "clean"]), ledger=ledger)
    before = spark.read.parquet(f"{ledger}/findings").count()
    again = secret_scan.scan(docs_of(spark, ["token=abcdefghijkl", "clean", "AKIA" + "A" * 16, "token=abcdefghijkl"]), ledger=ledger)
    assert spark.read.parquet(f"{ledger}/findings").count() == before + 1
    assert sorted((x.doc_id, len(x.spans)) for x in again.collect()) == [(0, 1), (1, 0), (2, 1), (3, 1)]
    newer = (*secret_scan.RULES, secret_scan.Rule("word", "clean"))
    assert dict((x.doc_id, len(x.spans)) for x in secret_scan.scan(docs_of(spark, ["token=abcdefghijkl", "clean"]), ledger=ledger, rules=newer).collect()) == {0: 1, 1: 1}


def test_a_rule_of_a_new_version_replaces_its_findings(spark, tmp_path):
    docs = docs_of(spark, ["abc 12 w1", "abc 12 w1", "none", "w22 x"])
    ledger, of = str(tmp_path / "ledger"), lambda pattern, version: (secret_scan.Rule("w", pattern, version), secret_scan.Rule("n", r"[0-9]{2}"))

    def spans(rules):
        return {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans] for x in secret_scan.scan(docs, ledger=ledger, rules=rules).collect()}

    def seen():
        return spark.read.parquet(f"{ledger}/seen").count(), spark.read.parquet(f"{ledger}/findings").count()

    assert spans(of("w[0-9]", 1)) == {0: [("n", 4, 6), ("w", 7, 9)], 1: [("n", 4, 6), ("w", 7, 9)], 2: [], 3: [("w", 0, 2), ("n", 1, 3)]}
    first = seen()
    assert first[0] == 3 and spans(of("w[0-9]", 1))[3] == [("w", 0, 2), ("n", 1, 3)] and seen() == first
    assert spans(of("w[0-9]+", 2)) == {0: [("n", 4, 6), ("w", 7, 9)], 1: [("n", 4, 6), ("w", 7, 9)], 2: [], 3: [("w", 0, 3), ("n", 1, 3)]}
    # Only the changed rule was scanned again; going back scans nothing.
    assert seen() == (6, first[1] + 2)
    assert spans(of("w[0-9]", 1))[3] == [("w", 0, 2), ("n", 1, 3)] and seen() == (6, first[1] + 2)


def test_redaction_of_many_findings_and_clashing_names(spark):
    text = "é token=abcdefghijkl " * 400 + "end"
    docs = spark.createDataFrame([(1, text, 5, "h", [1], "c"), (2, "clean", 6, "h", [2], "d")], "doc_id long, text string, row long, held string, spans array<int>, clean string")
    got = sorted(map(tuple, secret_scan.redact(docs).collect()))
    assert got == [(1, "é [secret] " * 400 + "end", 5, "h", [1], "c"), (2, "clean", 6, "h", [2], "d")]


def test_redaction_covers_overlaps_and_keeps_columns(spark, odd):
    texts = ["a token = deadbeefdeadbeef00 b", "é AKIA" + "Z" * 16 + " x " + "0123456789abcdef", "clean", None]
    got = {x.doc_id: x for x in secret_scan.redact(docs_of(spark, texts)).collect()}
    assert [got[i].text for i in range(4)] == ["a [secret] b", "é [secret] x [secret]", "clean", None]
    assert got[0].n_chars == len("a [secret] b") and got[0].part == 7
    assert secret_scan.redact(odd).columns == odd.columns and secret_scan.redact(odd).count() == odd.count()


# Media columns


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * 256, 64 * 256 * 3 + 5, 64 * 512])
def test_container_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    whole = media.container(media.padded(data))
    (track,) = media.read_tracks(whole)
    places = track.ranges(len(whole))
    assert media.payload(whole, places) == media.padded(data)
    assert (track.codec, track.handler, track.ticks) == ("raw ", "vide", track.stts_ticks)
    assert all(whole[a : a + size] == media.padded(data)[k * 16 * 64 : k * 16 * 64 + 64] for k, (a, size) in enumerate(track.key_ranges(places)))


def test_malformed_containers_get_a_reason(spark):
    good = media.container(media.padded(b"abc"))
    rows = [(0, 3, bytearray(good)), (1, 3, bytearray(good[:-1])), (2, 0, None), (3, 0, bytearray(b"\0\0\0\4free")), (4, 0, bytearray()), (5, 9, bytearray(good[:40]))]
    got = {x.doc_id: x for x in media.describe(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[0].error is None and got[0].samples == 1
    assert all(got[i].error and got[i].codec is None for i in range(1, 6))


def described(spark, files):
    rows = list(enumerate(files))
    df = spark.createDataFrame([(i, 0, bytearray(x)) for i, x in rows], "doc_id long, n_bytes long, media binary")
    return {x.doc_id: x for x in media.describe(df).collect()}


def test_hostile_containers_get_a_reason(spark):
    nested = b""
    for _ in range(3000):
        nested = media.box(b"moov", nested)
    claims = media.full(b"stsz", struct.pack(">II", 0, 0xFFFFFFFF)), media.full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF))
    many = [media.box(b"moov", media.box(b"trak", media.box(b"mdia", x))) for x in (media.box(b"mdhd"), media.box(b"hdlr"), media.box(b"stsd"), *claims)]
    got = described(spark, [nested, *many])
    assert all(x.error and x.codec is None for x in got.values()) and len(got) == 6


def test_damaged_containers_never_raise(spark):
    r = random.Random(8)
    good = [media.container(media.padded(bytes(r.randrange(256) for _ in range(n)))) for n in (0, 100, 3000)]
    files = []
    for _ in range(10_000):
        raw = bytearray(r.choice(good))
        for _ in range(r.randint(1, 6)):
            raw[r.randrange(min(len(raw), 700))] = r.choice([0, 1, 255, r.randrange(256)])
        files.append(raw[: r.choice([len(raw), r.randrange(len(raw))])])
    got = described(spark, files)
    assert len(got) == len(files) and any(x.error for x in got.values())
    assert all((x.error is None) == (x.payload_sha256 is not None) for x in got.values())


def test_media_columns_of_odd_rows(odd, empty):
    rows = media.describe(media.store(odd)).collect()
    assert len(rows) == odd.count() and media.describe(media.store(empty)).count() == 0
    by = {x.doc_id: x for x in rows}
    for i, text in enumerate(ODD):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (by[i].n_bytes, by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


# Quality rules


def plain_stats(text):
    words, lines = words_of(text), (text or "").split("\n")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in lines:
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_statistics_equal_a_plain_count(spark, odd, empty):
    r = random.Random(4)
    texts = [*ODD, *(" ".join(r.choice("ab# é* c|") + r.choice(["", "\n", "\x0b"]) for _ in range(r.randint(0, 30))) for _ in range(200))]
    got = {x[0]: tuple(x[1:6]) for x in quality_rules.statistics(docs_of(spark, texts)).collect()}
    assert got == {i: plain_stats(t) for i, t in enumerate(texts)}
    assert quality_rules.statistics(empty).count() == 0


def test_learned_list_recovers_a_conjunction_and_generalises():
    r = np.random.default_rng(0)
    x = {k: r.random(4000) for k in quality_rules.FEATURES}
    bad = (x["symbol_share"] > 0.8) & (x["upper_share"] > 0.5)
    rules = quality_rules.learn(x, bad, np.arange(4000) % 2 == 0)
    y = {k: r.random(4000) for k in quality_rules.FEATURES}
    truth = (y["symbol_share"] > 0.8) & (y["upper_share"] > 0.5)
    said = np.any([quality_rules._covered(rule, y, 4000) for rule in rules], axis=0)
    assert (said == truth).mean() > 0.98


def test_noise_teaches_nothing():
    r = np.random.default_rng(1)
    x = {k: r.random(600) for k in quality_rules.FEATURES}
    rules = quality_rules.learn(x, r.random(600) < 0.1, np.arange(600) % 2 == 0)
    assert sum(quality_rules._covered(rule, x, 600).sum() for rule in rules) < 30


def test_kept_rows_keep_clashing_columns(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (None, 0), (1, None)], "doc_id long, quality int")
    kept = quality_rules.keep(odd, labels)
    assert kept.columns == odd.columns and {x.doc_id for x in kept.collect()} <= {6}
    assert quality_rules.keep(empty, labels).count() == 0


# Line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, text, edits, letters="abcz"):
    out = list(text)
    for _ in range(edits):
        i = r.randint(0, len(out))
        out[i : i + r.randint(0, 1)] = r.choice([[], [r.choice(letters)]])
    return "".join(out)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_bit_parallel_distance(spark, threshold):
    r = random.Random(threshold)
    rows = []
    for _ in range(600):
        a = noise(r, r.randint(0, 8), "abcé")
        rows.append((a, edited(r, a, r.randint(0, 4), "abcé")))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), threshold).alias("w")).collect()
    assert all(x.w == (distance(x.a, x.b) <= threshold) for x in got)


def allowed(a, b, threshold):
    return min(line_dedup.MOST_EDITS, min(len(a), len(b)) // line_dedup.CHARS) if threshold is None else threshold


def near_by_brute_force(texts, threshold):
    """Removed lines of each document, and links between different lines."""
    at = [(d, i, line) for d, t in enumerate(texts) for i, line in enumerate((t or "").split("\n")) if words_of(line)]
    known = sorted({line for _, _, line in at}, key=len)
    links = set()
    for k, a in enumerate(known):
        for b in itertools.takewhile(lambda b: len(b) - len(a) <= 3, known[k + 1 :]):
            if 0 < distance(a, b) <= allowed(a, b, threshold):
                links.add((a, b))
    links |= {(b, a) for a, b in links}
    want, seen = {}, set()
    for d, i, line in at:
        if line in seen or any((line, o) in links for o in seen):
            want.setdefault(d, []).append(i)
        seen.add(line)
    return want, len(links), Counter(a for a, _ in links), at


@pytest.mark.parametrize(("threshold", "hot"), [(2, 1000), (3, 2), (None, 2)])
def test_removed_lines_equal_brute_force(spark, monkeypatch, threshold, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(9)
    base = [noise(r, r.choice([7, 18, 22, 39, 43, 59, 61, 64, 90])) for _ in range(14)]
    base += [base[-1][:45] + noise(r, 45) for _ in range(6)] + ["ab" * 33, "-" * 64]
    texts = ["\n".join(edited(r, r.choice(base), r.choice([0, 0, 1, 1, 2, 3, 4])) for _ in range(r.randint(0, 6))) for _ in range(70)]
    texts += ["", None, base[0][:10], base[0][:10], "\n \n\n"]
    want, _, links, at = near_by_brute_force(texts, threshold)
    got = line_dedup.removed_lines(docs_of(spark, texts), threshold).collect()
    assert {x.doc_id: x.removed for x in got if x.removed} == want
    of_doc = Counter()
    for d, _, line in at:
        of_doc[d] += links[line]
    assert {x.doc_id: x.n_links for x in got if x.n_links} == {d: n for d, n in of_doc.items() if n}


def cases_of(n, threshold):
    """Edits, gap, segment and shift of all that a line of ``n`` characters looks up, and the characters there."""
    most = line_dedup.MOST_EDITS if threshold is None else threshold
    for g in range(min(n, most) + 1):
        e = min(most, (n - g) // line_dedup.CHARS) if threshold is None else threshold
        for i in range(e + 1) if g <= e and (e or threshold is not None) else ():
            sizes = sorted((n - g + k) // (e + 1) for k in range(e + 1))
            for s in range(max(-i, g - (e - i)), min(i, g + e - i) + 1):
                at = sum(sizes[:i]) + s
                yield (e, g, i, s), (at, at + sizes[i])


def lines_of_lengths(spark, lengths):
    r = random.Random(4)
    texts = sorted({noise(r, n, letters) for n in lengths for letters in ("abcdefgh", "abcdéfñ你😀")})
    return spark.createDataFrame([(t, t) for t in texts], "text string, line string").withColumn("n", F.length("line"))


@pytest.mark.parametrize("threshold", [None, 0, 1, 3, 5])
def test_a_line_makes_a_key_for_each_part_once(spark, threshold):
    known = lines_of_lengths(spark, [*range(20 if threshold is None else 0, 72), 150, 151, 152, 153, 361])
    for x in line_dedup.line_keys(known, threshold, "text").groupBy("text").agg(F.count("*").alias("n")).collect():
        want = {(c[0], c[2], span) for c, span in cases_of(len(x.text), threshold)}
        assert x.n == len(want) and (threshold is not None or x.n <= 14)


@pytest.mark.parametrize("threshold", [None, 0, 1, 3, 5])
def test_parts_are_dealt_to_all_lengths(spark, threshold):
    known = lines_of_lengths(spark, [*range(20 if threshold is None else 0, 72), 150, 151, 152, 153, 361])
    rows = line_dedup.by_length(line_dedup.line_keys(known, threshold, "text"), threshold, "text").collect()
    got, key_of = {}, {}
    for x in rows:
        got.setdefault(x.text, []).append((tuple(x.x), x.own))
        at, end = dict(cases_of(len(x.text), threshold))[tuple(x.x)]
        seen = (x.x.e, x.x.i, len(x.text) - x.x.g, x.text[at:end])
        if 0 <= at and end <= len(x.text):  # no alignment reaches beyond the line
            assert key_of.setdefault(seen, x.key) == x.key
    assert len(set(key_of.values())) == len(key_of)
    for x in known.collect():
        want = sorted((c, c[1] == c[3] == 0) for c, _ in cases_of(len(x.text), threshold))
        assert sorted(got.get(x.text, [])) == want


def test_lines_with_a_common_half_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 50)
    r = random.Random(3)
    half = noise(r, 50)
    texts = [half + noise(r, 50, "0123456789") for _ in range(2000)]
    texts += [edited(r, t, 2, "0123456789") for t in texts[:40]]
    sizes, whole = [], line_dedup._links

    def counted(rows, threshold):
        sizes.append(rows.groupBy("key").count().agg(F.sum("count"), F.max("count")).first())
        return whole(rows, threshold)

    monkeypatch.setattr(line_dedup, "_links", counted)
    _, links = line_dedup.near_lines(docs_of(spark, texts))
    others = [t for k, t in enumerate(texts[:40]) if t != texts[2000 + k]]
    assert links.count() >= len(others) > 30
    assert sum(n or 0 for n, _ in sizes) < 20 * len(texts) and max(m or 0 for _, m in sizes) <= 50


def test_lines_two_and_three_edits_apart_go(spark):
    base = "the visitor of the second day asked for room 17 and signed the form"
    texts = [base, base.replace("17", "42"), base.replace("form", "farms"), base.replace("visitor", "tourists")]
    got = {x.doc_id: x.removed for x in line_dedup.removed_lines(docs_of(spark, texts)).collect() if x.removed}
    assert [distance(base, t) for t in texts[1:3]] == [2, 2] and distance(base, texts[3]) > 3
    assert len(base) >= 3 * line_dedup.CHARS
    three = [base, base.replace("17", "423")]
    assert got == {1: [0], 2: [0]} and distance(*three) == 3
    assert [x.removed for x in line_dedup.removed_lines(docs_of(spark, three)).collect() if x.doc_id == 1] == [[0]]


def test_dedup_lines_keeps_columns_of_any_name(spark):
    rows = [(1, "a b\nc d", 9, "x", [1], 5), (2, "c d\ne f\nc d", 8, "y", [2], 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of_doc long, row string, removed array<int>, new_text long")
    got = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
    assert got == [(1, "a b\nc d", 9, "x", [1], 5), (2, "e f", 8, "y", [2], 6)]


def test_line_dedup_of_odd_rows(odd, empty):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count() and line_dedup.dedup_lines(empty).count() == 0
    texts = Counter(x.text for x in rows)
    assert texts["same text"] == 1 and texts["twice"] == 2 and texts["no id"] == 1 and texts[None] == 1


# Packing


def test_pieces_hold_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    r = random.Random(3)
    texts = [*ODD, *(noise(r, 40, ["I", "'s", " ", "\n", "\x1c", "\u3000", "\u0130", "1", "!", "don't", "e\u0301", "\U0001f600", "<|endoftext|>"]) for _ in range(200))]
    for text in texts:
        assert np.frombuffer(packing.document_ids(text or "", WORD_BPE), "<u4").tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_is_whole_gapless_and_tight(spark, odd, empty):
    r = random.Random(5)
    texts = [*ODD, *("word " * int(r.lognormvariate(6, 1.2)) for _ in range(400))]
    rows = packing.packed(docs_of(spark, texts), WORD_BPE).collect()
    ids = {i: packing.document_ids(t or "", WORD_BPE) for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_sequence.setdefault(x.sequence_id, []).append(x)
        assert x.ids_crc32 == zlib.crc32(ids[x.doc_id][4 * x.start : 4 * (x.start + x.length)])
        assert x.doc_tokens == len(ids[x.doc_id]) // 4
    for i, found in by_doc.items():
        assert sorted((x.start, x.start + x.length) for x in found)[-1][1] == len(ids[i]) // 4 == sum(x.length for x in found)
    for found in by_sequence.values():
        at = 0
        for x in sorted(found, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= packing.CAPACITY
    assert len(by_doc) == len(texts) and sum(x.length for x in rows) / (packing.CAPACITY * len(by_sequence)) > 0.9
    assert packing.packed(empty, WORD_BPE).count() == 0 and packing.packed(odd, WORD_BPE).count() >= odd.count()


def test_column_generation_is_near_the_bound():
    r = np.random.default_rng(2)
    histogram = {int(s): int(r.integers(1, 60)) for s in r.choice(np.arange(1, 128), 60, replace=False)}
    plan = packing.plan(histogram, 128)
    used = Counter()
    for times, items in plan:
        assert sum(size * n for size, n in items.items()) <= 128
        for size, n in items.items():
            used[size] += times * n
    assert used == histogram
    least = -(-sum(s * n for s, n in histogram.items()) // 128)
    least = max(least, sum(n for s, n in histogram.items() if s > 64))  # no two of these share a sequence
    assert sum(times for times, _ in plan) <= least * 1.01 + len(histogram)  # rounding costs less than a sequence a class


# Suffix-array dedup


def plain_removal(docs):
    seen, out = set(), {}
    for d, text in sorted(docs):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            window = raw[s : s + 100]
            if window in seen:
                gone[s : s + 100] = True
            seen.add(window)
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(raw), int(gone.sum()), runs, sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [10_000, 3])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(5)
    passages = [noise(r, r.randint(90, 260)) for _ in range(6)]
    docs = []
    for d in range(70):
        text = ""
        for _ in range(r.randint(0, 5)):
            k, p = r.random(), r.choice(passages)
            text += p[r.randint(0, 40) : len(p) - r.randint(0, 40)] if k < 0.5 else r.choice("ab") * r.randint(50, 300) if k < 0.6 else "abc" * r.randint(30, 120) if k < 0.7 else noise(r, r.randint(1, 150))
        docs.append((d * 7 % 83, text))
    rows = suffix_dedup.dedup(docs_of(spark, [t for _, t in docs], [d for d, _ in docs])).collect()
    assert {x[0]: tuple(x[1:]) for x in rows} == plain_removal(docs)


def test_blocks_of_long_texts_agree(monkeypatch):
    raw = noise(random.Random(1), 5000).encode()
    (whole,) = suffix_dedup.anchors(raw)
    monkeypatch.setattr(suffix_dedup, "_STEP", 700)
    cut = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(raw), strict=True)]

    def owners(found):
        return {int(f) + w: (int(h), int(f + d)) for h, f, n, d in zip(*found, strict=True) for w in range(n)}

    assert owners(whole) == owners(cut)


def test_suffix_dedup_of_odd_rows(spark, odd, empty):
    got = suffix_dedup.dedup(odd).collect()
    assert len(got) == odd.count() and suffix_dedup.dedup(empty).count() == 0
    copies = suffix_dedup.dedup(docs_of(spark, ["q" * 10 + noise(random.Random(1), 200)] * 4, [5, 5, None, 9])).collect()
    assert sorted((x.doc_id or 0, x.n_removed) for x in copies) == [(0, 0), (5, 0), (5, 0), (9, 210 + copies[0].n_bytes - 210)]


def test_interval_tree_of_a_small_array():
    assert list(suffix_dedup.intervals([0, 3, 5, 5, 2, 0, 4], 1)) == [(1, 3, 5, 3), (0, 3, 3, 2), (0, 4, 2, 0), (5, 6, 4, 0)]


# URL filters


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    (None, "", "", None), ("no scheme", "", "", None), ("http://A.Example.COM/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7"),
    ("x://example.net/de/81", "example.net", "/de/81", "example.net/de/8"), ("x://example.net/de/7", "example.net", "/de/7", "net/de/"),
    ("x://badcom/en/", "badcom", "/en/", None), ("x://com/en/", "com", "/en/", "com/en/"), ("x://a.org?q=/es/", "a.org", "", None),
    ("x://É.ORG/es/\n", "É.org", "/es/\n", "org/es/"), ("a://b://c/d", "b:", "//c/d", None), ("://", "", "", None),
])
def test_fixed_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, "h")], "page_id long, url string, html string")
    parts = url_filter.host_and_path(F.col("url"))
    x = pages.select(parts[0].alias("host"), parts[1].alias("path")).select("host", "path", url_filter.fixed_rule(F.col("host"), F.col("path"))["rule"].alias("rule")).first()
    assert (x.host, x.path, x.rule) == (host, path, rule)


def test_mined_rules_hold_against_brute_force(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        words = r.sample(["cheap", "pills", "news", "shop", "blog", "win"], r.randint(1, 3))
        bad = {"cheap", "pills"} <= set(words) or r.random() < 0.02
        rows.append((i, f"http://{'-'.join(words)}.test/{r.choice('xyz')}"))
        labels.append((i, int(not bad), i))
    rows += [(None, None), (300, "http://pills-cheap.test/x"), (301, "http://pills-cheap.test/x"), (302, "http://cheap.test/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame([*labels, (None, 0, 1), (5, None, 1)], "doc_id long, quality int, url long")
    got = {x.page_id: x for x in url_filter.judge(pages, marks).collect()}
    assert len(got) == len(rows) and got[300].verdict == got[301].verdict == "block" and got[302].verdict == got[None].verdict == "allow"
    for i, url in rows[:300]:
        if {"cheap", "pills"} <= set(re.findall("[a-z]+", url)):
            assert got[i].verdict == "block"
    assert url_filter.judge(pages.limit(0), marks).count() == 0
    assert {x.verdict for x in url_filter.judge(pages, marks.limit(0)).collect()} == {"allow"}


def plain_rules(rows):
    """All itemsets of bad baskets, judged on all baskets, without those that a shorter one shadows."""
    place = {}
    for k, (tokens, _) in enumerate(rows):
        for t in tokens:
            place.setdefault(t, set()).add(k)
    item = {t: min(u for u in place if place[u] == place[t]) for t in place}
    baskets = [({item[t] for t in tokens}, bad) for tokens, bad in rows]
    total, all_bad, sure, z = len(rows), sum(b for _, b in rows), {}, url_filter.Z
    for tokens in {frozenset(c) for has, bad in baskets if bad for n in range(1, len(has) + 1) for c in itertools.combinations(sorted(has), n)}:
        n = sum(tokens <= has for has, _ in baskets)
        hit = sum(tokens <= has for has, bad in baskets if bad)
        share = hit / n
        low = (share + z * z / (2 * n) - z * ((share * (1 - share) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)
        if hit >= max(url_filter.MIN_COUNT, url_filter.MIN_SUPPORT * total) and low >= url_filter.MIN_CONFIDENCE and share * total >= url_filter.MIN_LIFT * all_bad:
            sure[tokens] = share
    return {tuple(sorted(t)): c for t, c in sure.items() if not any(o < t and d >= c for o, d in sure.items())}


def test_mining_equals_brute_force(spark):
    r = random.Random(12)
    rows = []
    for _ in range(400):
        tokens = r.sample("abcdefg", r.randint(1, 5))
        tokens += ["twin", "sister"] if "a" in tokens else []
        rows.append((tokens, {"a", "b"} <= set(tokens) and r.random() < 0.97 or {"c", "d", "e"} <= set(tokens) or r.random() < 0.05))
    df = spark.createDataFrame([(f"u{k}", *row) for k, row in enumerate(rows)], "url string, tokens array<string>, bad boolean")
    got = {tuple(x.tokens): x.confidence for x in url_filter.mine(df)[0].collect()}
    want = plain_rules(rows)
    assert got.keys() == want.keys() and len(want) > 1 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_urls_are_mined_as_few_items(spark):
    long = [f"t{k}" for k in range(40)]
    rows = [(f"u{k}", [*long, f"own{k}"], True) for k in range(30)] + [(f"v{k}", ["other", f"x{k}"], False) for k in range(30)]
    rules, classes = url_filter.mine(spark.createDataFrame(rows, "url string, tokens array<string>, bad boolean"))
    assert [x.tokens for x in rules.collect()] == [["t0"]]
    urls = spark.createDataFrame([(1, ["t17"]), (2, ["other"])], "k long, tokens array<string>")
    assert [x.k for x in url_filter.mined_matches(urls, rules, classes, "k").collect()] == [1]


# BPE


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(BYTE_BPE), bpe.ByteBpe(BYTE_BPE)
    r = random.Random(8)
    letters = [*"ab 's\n\t  \u0085\x1c\u00a0\u3000Ç1２,.!  é中ß", "<|endoftext|>", "don't", " \n", "\ufeff", "\u200b", "\U0001f600"]
    for text in [t or "" for t in ODD] + [noise(r, r.randint(0, 14), letters) for _ in range(3000)] + ["a" * 20000]:
        ids = whole.encode(text, add_special_tokens=False).ids
        mine = own.encode(text)
        assert np.frombuffer(mine, "<u4").tolist() == ids
        assert own.decode(mine).decode() == whole.decode(ids, skip_special_tokens=False)


def test_bpe_decodes_broken_utf8():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(BYTE_BPE), bpe.ByteBpe(BYTE_BPE)
    r = random.Random(1)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(6)]
        assert own.decode(struct.pack("<6I", *ids)).decode() == whole.decode(ids, skip_special_tokens=False)


def test_bpe_of_odd_rows(odd, empty):
    rows = bpe.encode_digests(odd, BYTE_BPE).collect()
    assert len(rows) == odd.count() and bpe.encode_digests(empty, BYTE_BPE).count() == 0
    none = sha256(b"").hexdigest()
    assert {(x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in rows if x.doc_id in (0, 1)} == {(0, none, none)}


def test_rules_of_four_tokens_and_of_query_strings(spark):
    four = ["a", "b", "c", "d"]
    rows = [(four, True)] * 10 + [([t for t in four if t != gone], False) for gone in four for _ in range(10)]
    rows = [(f"u{k}", *row) for k, row in enumerate(rows)]
    found = url_filter.mine(spark.createDataFrame(rows, "url string, tokens array<string>, bad boolean"))[0].collect()
    assert [x.tokens for x in found] == [four]
    urls = [(i, f"http://x.y/p?kind={'spam' if i % 2 else 'ham'}") for i in range(40)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in urls], "doc_id long, quality int")
    assert {x.page_id for x in url_filter.judge(pages, labels).collect() if x.verdict == "block"} == set(range(1, 40, 2))


# Chat formatting


def test_roles_of_held_out_transcripts(spark):
    r = random.Random(7)
    rows = []
    for c in range(80):
        for t in range(r.randint(1, 12)):
            role = "user" if t % 2 == 0 else "assistant"
            mark = {"user": "Human: ", "assistant": "AI: "}[role] if r.random() < 0.6 else ""
            rows.append((c, t, role, mark + ("why is that?" if role == "user" else "because of this. " * 9)))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_turns(turns, lambda seen: seen.withColumn("role", F.when(F.col("conv_id") < 40, F.col("role")))).collect()
    truth = {(c, t): role for c, t, role, _ in rows}
    assert len(got) == len(rows) and all(x.role == truth[x.conv_id, x.turn] for x in got)
    assert got[0].rendered.startswith(f"<|{got[0].role}|>\n") and "Human:" not in got[0].rendered


def test_conversations_of_odd_ids_teach_too(spark, tmp_path):
    from quillspark.llm import queries

    said = {"user": "why is that?", "assistant": "because of this. " * 9}
    rows = [(2 * c + 1, t, role, said[role]) for c in range(40) for t, role in enumerate(("user", "assistant") * 3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(x.conv_id, x.turn): x.role for x in queries.queries()["op9_chat_format"](spark, str(tmp_path)).collect()}
    assert got == {(c, t): role for c, t, role, _ in rows}


def test_blocks_find_the_best_path():
    r = np.random.default_rng(3)
    n = len(chat.ROLES)
    model = chat.Model(r.random(n) * 9, r.random((n, n)) * 9, {f: r.random((n, k)) * 9 for f, k in chat.FEATURES.items()})
    for size in (1, 2, 5, 17):
        codes = [tuple(int(r.integers(k)) for k in chat.FEATURES.values()) for _ in range(size)]
        score, whole = chat.viterbi(model, codes, None)
        cuts = [codes[i : i + 3] for i in range(0, size, 3)]
        ends = chat.chain([(k, chat.block_matrix(model, c, k == 0), False) for k, c in enumerate(cuts)])
        path = [role for c, (_, entry, last) in zip(cuts, ends, strict=True) for role in chat.viterbi(model, c, entry, last)[1]]
        assert path == whole


def test_viterbi_equals_the_best_of_all_paths():
    r = np.random.default_rng(5)
    n = range(len(chat.ROLES))
    model = chat.Model(r.random(3) * 9, r.random((3, 3)) * 9, {f: r.random((3, k)) * 9 for f, k in chat.FEATURES.items()})
    for size in (1, 2, 4, 7):
        codes = [tuple(int(r.integers(k)) for k in chat.FEATURES.values()) for _ in range(size)]

        def score(path, codes=codes):
            moves = sum(model.move[a][b] for a, b in itertools.pairwise(path))
            return float(model.start[path[0]]) + moves + sum(model.of[c][x] for c, x in zip(codes, path, strict=True))

        best, path = chat.viterbi(model, codes, None)
        whole = max(itertools.product(n, repeat=size), key=score)
        assert abs(best - score(whole)) < 1e-9 and path == list(whole)


def test_no_word_of_a_text_is_lost(spark):
    texts = ["A > B implies C", "Context: see page 4", "Q: once", "a: one\nmore", "Human: hello there", "System > low", "user:   ", "it is human: yes"]
    rows = [(k, 0, None, t) for k, t in enumerate(texts)]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(["Q: why?", "A: because. " * 9] * 6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn): x for x in chat.format_turns(turns).collect()}
    for k in (0, 1, 2, 3, 7):
        assert texts[k] in got[k, 0].rendered
    assert "why?" in got[100, 0].rendered and "Q:" not in got[100, 0].rendered and "A: because. b" not in got[100, 1].rendered
    for k, t in enumerate(texts):
        said = got[k, 0].rendered
        marker = re.match(r"(Human|System|user)\b", t)
        assert t.strip() in said or marker and got[k, 0].role in (marker[0].lower(), "user" if marker[0] == "Human" else marker[0].lower())


def test_turns_without_a_number_come_first(spark):
    rows = [(1, -300, "assistant", "AI: because"), (1, None, "user", "Human: why?"), (1, 5, "assistant", "AI: so")]
    seen = chat.observe(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("block", "turn").collect()
    assert [x.turn for x in seen] == [None, -300, 5]


def test_chat_of_odd_rows(spark):
    rows = [(None, 0, "user", None), (1, None, None, ""), (1, 0, "robot", "User: hi"), (1, 0, "robot", "User: hi"), (2, 700, "user", "x" * 5000), (2, -3, "system", "System: s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_turns(turns).collect()
    assert len(got) == len(rows) and all(x.role in chat.ROLES for x in got)
    assert chat.format_turns(turns.limit(0)).count() == 0


# SimHash


def plain_fingerprint(text):
    import xxhash

    words = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_a_plain_version():
    r = random.Random(4)
    for text in [*ODD, *("".join(r.choice(["a", "B", " ", "\n", "\x1c", "É", "c d"]) for _ in range(60)) for _ in range(200))]:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def test_links_equal_brute_force(spark):
    r = random.Random(11)
    prints = {r.getrandbits(64) for _ in range(40)}
    for f in list(prints):
        for _ in range(6):
            near = f
            for b in r.sample(range(64), r.randint(1, 5)):
                near ^= 1 << b
            prints.add(near)
    prints = sorted(prints)
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    for bits in (3, 2, 1):
        got = {(min(x), max(x)) for x in simhash.links(spark.createDataFrame(rows, "fp long, rep long"), bits).collect()}
        want = {(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= bits}
        assert got == want


def test_components_equal_union_find(spark):
    r = random.Random(12)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_of_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and simhash.near_duplicates(empty).count() == 0
    by = {x.doc_id: x for x in rows}
    assert by[0].fingerprint == "0" * 16 and by[0].component_id == by[1].component_id == by[2].component_id == 0
    assert by[10].component_id == by[11].component_id == 10 and by[None].component_id is None and by[77].component_id == 77
    assert simhash.keep_one(odd).columns == odd.columns
    assert sorted(x.doc_id or -1 for x in simhash.keep_one(odd).collect() if x.text in ("same text", "twice", "no id")) == [-1, 10, 77, 77]
