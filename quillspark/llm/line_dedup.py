"""Line dedup: a segment-partition edit join over all lines of a corpus, in DataFrame functions only.

Lines within ``k`` edits of each other agree in one of ``k + 1`` segments of the shorter one. Every distinct line
indexes its own segments under its length, and probes the lengths from its own down to ``k`` less with the
substrings that an alignment allows: if segment ``i`` is the first with fewer edits up to its end than segments,
what lies before it holds ``i`` edits and what follows at most ``k - i``.

1. Segments of the lengths that a line probes are often the same characters of it: each such part makes one key, without
   the length. Keys are counted, combined before the shuffle, without what they belong to. Most occur once.
2. Keys that meet are looked up in a bitmap of bounded size, then by an exact join. Only what passes is dealt to lengths,
   and counted again with them.
3. A key of over ``HOT`` rows makes no pairs. By the rule above, the longer of the two rests has known edits left:
   it is cut into segments again, and rows meet on both keys. This goes on for at most ``DEEPEST`` levels.
4. Pairs that meet are filtered by counts of 32 characters within the join, and verified by a bit-parallel
   automaton over the ``2 * k + 1`` diagonals of the band, once their common ends are cut off.

A line goes if an earlier one (smaller doc_id, or same document and earlier line) equals it or is near. Lines are
judged on the input, not on what is left. With ``threshold``, lines are near within that many edits, whatever their
length. Without, a line may differ by one edit for every ``CHARS`` characters of the shorter line, up to ``MOST_EDITS``.

Rows and edge cases
-------------------
* null text: the empty text; lines without a word stay and never count
* null ``doc_id``: kept whole, its lines take no part
* repeated rows: lines at the same place of the same doc_id don't remove each other
* equal lines meet in one row before keys are made, combined before the shuffle, so a line that fills a third
  of the corpus makes no pairs; its occurrences only look up one row
* ties: two lines at one place keep each other; empty table: empty result; other columns pass through ``dedup_lines``,
  whatever their names
* links between different lines are whole: where many lines are all near each other, there are as many as pairs
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialise, packed_rows, probable, unpacked

#: Without a threshold, a line may differ by one edit for every ``CHARS`` characters, up to ``MOST_EDITS``.
MOST_EDITS, CHARS = 3, 20
#: Rows of a key that are joined directly, and how often the rows of larger ones are cut again.
HOT, DEEPEST = 1_000, 4
#: Characters behind the common start after which most pairs are known to be unlike.
OPENING = 24
#: Characters whose counts are compared before a pair is verified, four bits each, sixteen in a number.
COUNTED = ("etaoinsrhldcumfp", "0123456789gwyb .")
_LINE = ("h1", "h2")


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no``, ``line`` and two hashes of it, for lines with a word."""
    return (
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
        .select("doc_id", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )


def _shifts(i: int, edits: int, gap: int) -> range:
    """By how much segment ``i`` may have moved in a string that is ``gap`` characters longer."""
    return range(max(-i, gap - (edits - i)), min(i, gap + edits - i) + 1)


def _cases(edits: range, gaps: range) -> str:
    """SQL of the constant array of what may be looked up: edits, gap, segment and shift."""
    found = ((e, g, i, s) for e in edits for g in gaps if abs(g) <= e for i in range(e + 1) for s in _shifts(i, e, g))
    return "array(" + ", ".join(f"named_struct('e', {e}, 'g', {g}, 'i', {i}, 's', {s})" for e, g, i, s in found) + ")"


def _start(length: str, x: str) -> str:
    """Where segment ``x.i`` of ``x.e + 1`` starts in a string of ``length`` characters; the last ones are longer."""
    return f"({x}.i * ({length} div ({x}.e + 1)) + greatest(0, {x}.i - ({x}.e + 1 - {length} % ({x}.e + 1))))"


def _size(length: str, x: str) -> str:
    return f"({length} div ({x}.e + 1) + if({x}.i >= {x}.e + 1 - {length} % ({x}.e + 1), 1, 0))"


def _key(text: str, length: str, x: str, *more: str) -> str:
    """The segment's hash; ``raw``, the bytes of ``text``, is null if any of its characters has more than one."""
    at, size = f"int({_start(length, x)} + {x}.s + 1)", f"int({_size(length, x)})"
    part = f"if(raw IS NULL, binary(substring({text}, {at}, {size})), substring(raw, {at}, {size}))"
    return f"xxhash64({', '.join((*more, length, f'{x}.e', f'{x}.i', part))})"


def _raw(text: str) -> Column:
    return F.expr(f"if(octet_length({text}) = length({text}), binary({text}), null)").alias("raw")


def _allowed(length: str, threshold: int | None) -> str:
    return str(threshold) if threshold is not None else f"least({MOST_EDITS}, {length} div {CHARS})"


def _segment(length: int, e: int, i: int) -> tuple[int, int]:
    """Start and size of segment ``i``, as ``_start`` and ``_size`` give them."""
    size, longer = divmod(length, e + 1)
    return i * size + max(0, i - (e + 1 - longer)), size + (i >= e + 1 - longer)


def _parts(n: int, threshold: int | None) -> str:
    """SQL of the constant array of what a line of ``n`` characters looks up.

    That is edits, segment, by how much start and size exceed ``i * (n div (e + 1))`` and ``n div (e + 1)``, and whether it
    is a segment of the line itself. Segments of several lengths are often the same characters of the line: one part.
    """
    found: dict[tuple[int, int, int, int], bool] = {}
    for g in range(min(n, MOST_EDITS if threshold is None else threshold) + 1):
        e = min(MOST_EDITS, (n - g) // CHARS) if threshold is None else threshold
        for i in range(e + 1) if g <= e and (e or threshold is not None) else ():
            start, size = _segment(n - g, e, i)
            for s in _shifts(i, e, g):
                part = (e, i, start + s - i * (n // (e + 1)), size - n // (e + 1))
                found[part] = found.get(part, False) or g == s == 0
    return "array(" + ", ".join(f"named_struct('e', {e}, 'i', {i}, 'd', {d}, 't', {t}, 'own', {own})" for (e, i, d, t), own in found.items()) + ")"


def line_keys(known: DataFrame, threshold: int | None, *columns: str) -> DataFrame:
    """``columns``, ``n``, ``key``, ``own`` (indexes; all rows probe) and the place ``x`` of each part that ``line`` of length ``n`` looks up."""
    # From ``steady`` on, parts depend on the remainder of the length only.
    least, steady, edits = (CHARS, MOST_EDITS * CHARS + MOST_EDITS, MOST_EDITS) if threshold is None else (0, threshold, threshold)
    lengths = [*range(least, steady), *(steady + (r - steady) % (edits + 1) for r in range(edits + 1))]
    at_length = f"if(n >= {steady}, {steady - least} + n % {edits + 1}, n - {least})"
    parts = f"get(array({', '.join(_parts(n, threshold) for n in lengths)}), {at_length})"
    # Parts become rows before keys are made, so that all of it is compiled code.
    dealt = known.select(*columns, "line", "n", _raw("line")).select("*", F.explode(F.expr(parts)).alias("x"))
    at, size = "int(x.i * (n div (x.e + 1)) + x.d)", "int(n div (x.e + 1) + x.t)"
    part = f"if(raw IS NULL, binary(substring(line, {at} + 1, {size})), substring(raw, {at} + 1, {size}))"
    place = F.expr(f"named_struct('e', x.e, 'i', x.i, 'at', {at}, 'size', {size})").alias("x")
    return dealt.select(*columns, "n", F.expr(f"xxhash64(x.e, x.i, {part})").alias("key"), F.expr("x.own").alias("own"), place)


def by_length(keyed: DataFrame, threshold: int | None, *columns: str) -> DataFrame:
    """Rows of ``line_keys`` once for each length whose segment the part may be, under a key of both, with the case ``x``."""
    m = "(n - g)"
    dealt = keyed.select("*", F.explode(F.expr("sequence(0, least(n, x.e))")).alias("g"))
    dealt = dealt.withColumn("s", F.expr(f"int(x.at - {_start(m, 'x')})"))
    fits = f"{_allowed(m, threshold)} = x.e AND {_size(m, 'x')} = x.size AND s BETWEEN greatest(-x.i, g - (x.e - x.i)) AND least(x.i, g + x.e - x.i)"
    case = F.expr("named_struct('e', x.e, 'g', g, 'i', x.i, 's', s)").alias("x")
    return dealt.where(fits).select(*columns, F.expr(f"xxhash64(key, {m})").alias("key"), F.expr("g = 0 AND s = 0").alias("own"), case)


def _meeting(keyed: DataFrame) -> DataFrame:
    """``of_key`` and ``rows`` of each key that one line indexes and another row has."""
    both = F.sum(F.expr("if(own, 4294967297, 1)"))
    counted = keyed.groupBy("key").agg(both.alias("both")).select(F.col("key").alias("of_key"), F.expr("both & 4294967295").alias("rows"), F.expr("both >> 32").alias("owns"))
    return counted.where("owns > 0 AND rows > 1").select("of_key", "rows")


def _met(keyed: DataFrame, name: str) -> DataFrame:
    """The written table ``keyed`` without keys that don't meet, with ``rows`` of the key; ``keyed`` goes."""
    meeting = materialise(_meeting(keyed), f"{name}-keys")
    rows = materialise(keyed.join(meeting, F.col("key") == F.col("of_key")).drop("of_key"), f"{name}-rows")
    discard(keyed)
    return rows


def _counts() -> list[Column]:
    """Counts of ``COUNTED`` characters modulo 16."""
    out = []
    for k, chars in enumerate(COUNTED):
        each = (f"shiftleft(bigint((n - length(replace(line, '{c}', ''))) & 15), {4 * b})" for b, c in enumerate(chars))
        out.append(F.expr(" | ".join(each)).alias(f"c{k}"))
    return out


def _close(a: str, b: str, edits: str) -> Column:
    """One edit changes two counts by one at most; counts are known modulo 16."""
    gaps = (
        f"((shiftrightunsigned({a}.c{k}, {4 * j}) & 15) - (shiftrightunsigned({b}.c{k}, {4 * j}) & 15)) & 15"
        for k, chars in enumerate(COUNTED)
        for j in range(len(chars))
    )
    whole = " + ".join(f"least({g}, 16 - ({g}))" for g in gaps) + f" <= 2 * {edits}"
    unlike = " + ".join(
        f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)"
        for x in (f"({a}.c{k} ^ {b}.c{k})" for k in range(len(COUNTED)))
    )
    return F.expr(f"{unlike} <= 2 * {edits} AND {whole}")


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two strings are at most ``threshold`` edits apart: Wu and Manber's automaton on the band's diagonals.

    Common ends are cut off first. Bit ``r`` of the mask for ``e`` errors says that after ``j`` characters of
    ``b`` the first ``j + r - threshold`` characters of ``a`` match with at most ``e`` errors.
    """
    k, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    start = F.array(*(F.lit(sum(1 << (k + d) for d in range(e + 1))).cast("bigint") for e in range(k + 1)))

    def bound(of: Column, then) -> Column:
        return F.transform(F.array(of), then)[0]

    def step(masks: Column, j: Column, c: Column) -> Column:
        here = F.get(c["b"], j)
        same = [F.when(F.get(c["a"], j + r - k) == here, F.lit(1 << r)).otherwise(F.lit(0)).cast("bigint") for r in range(width)]
        match = same[0]
        for bit in same[1:]:
            match = match.bitwiseOR(bit)

        def moved(m: Column) -> Column:
            new = [masks[0].bitwiseAND(m)]
            for e in range(1, k + 1):
                reached = masks[e].bitwiseAND(m).bitwiseOR(masks[e - 1]).bitwiseOR(F.shiftright(masks[e - 1], 1))
                new.append(reached.bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(full).cast("bigint")))
            return F.array(*new)

        # Once no state is left, none comes back.
        return F.when(masks[k] == 0, masks).otherwise(bound(match, moved))

    def states(c: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(c["b"]) - 1), start, lambda m, j: step(m, j, c))

    def chars(text: Column) -> Column:
        return F.when(F.length(text) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(text, ""))

    def alike(x: Column, y: Column, most: Column) -> Column:
        """How many characters both start with, up to ``most``: by halving steps."""

        def longer(p: Column, s: Column) -> Column:
            return F.when((p + s <= most) & (F.substring(x, p + 1, s) == F.substring(y, p + 1, s)), p + s).otherwise(p)

        return F.aggregate(F.array(*(F.lit(1 << i) for i in range(30, -1, -1))), F.lit(0), longer)

    def whole(c: Column) -> Column:
        gap = F.length(c["a"]) - F.length(c["b"])
        ends = alike(F.reverse(c["a"]), F.reverse(c["b"]), F.least(F.length(c["a"]), F.length(c["b"])))

        def run(d: Column) -> Column:
            bit = F.expr("bigint(1)") * F.pow(F.lit(2), gap + k).cast("bigint")
            return F.when(F.size(d["b"]) == 0, F.lit(True)).otherwise(states(d)[k].bitwiseAND(bit) != 0)

        def core(q: Column) -> Column:
            return F.struct(*(chars(F.substring(c[x], F.lit(1), F.length(c[x]) - q)).alias(x) for x in "ab"))

        return bound(ends, lambda q: bound(core(q), run))

    def judge(c: Column) -> Column:
        # Most pairs that aren't near show it right after their common start.
        opening = F.struct(chars(F.substring(c["a"], 1, OPENING + k)).alias("a"), chars(F.substring(c["b"], 1, OPENING)).alias("b"))
        dead = bound(opening, lambda d: (F.size(d["b"]) > 0) & (states(d)[k] == 0))
        return F.when(dead, F.lit(False)).otherwise(whole(c))

    def cut(c: Column) -> Column:
        start_alike = alike(c["a"], c["b"], F.least(F.length(c["a"]), F.length(c["b"])))
        return bound(start_alike, lambda p: bound(F.struct(*(F.substring(c[x], p + 1, F.length(c[x])).alias(x) for x in "ab")), judge))

    near = bound(F.struct(a.alias("a"), b.alias("b")), cut)
    return F.when(F.abs(F.length(a) - F.length(b)) > k, F.lit(False)).otherwise(near)


def _near(a: Column, b: Column, threshold: int | None) -> Column:
    if threshold is not None:
        return within(a, b, threshold)
    shorter = F.least(F.length(a), F.length(b))
    out = F.when(shorter < CHARS, F.lit(False)).when(shorter < 2 * CHARS, within(a, b, 1))
    for edits in range(2, MOST_EDITS):
        out = out.when(shorter < (edits + 1) * CHARS, within(a, b, edits))
    return out.otherwise(within(a, b, MOST_EDITS))


def _links(rows: DataFrame, threshold: int | None) -> DataFrame:
    """``a1, a2, b1, b2`` of different lines that meet on a key and are near; lines of one length meet once."""
    once = F.expr("NOT p.even OR i.h1 < p.h1 OR i.h1 = p.h1 AND i.h2 < p.h2")
    i, p = rows.where("own").alias("i"), rows.alias("p")
    # Pairs that fail are never rows: all tests are part of the join.
    near = _close("i", "p", "p.k") & _near(F.col("i.line"), F.col("p.line"), threshold)
    met = i.join(p, (F.col("i.key") == F.col("p.key")) & once & near)
    return met.select(F.col("i.h1").alias("a1"), F.col("i.h2").alias("a2"), F.col("p.h1").alias("b1"), F.col("p.h2").alias("b2")).distinct()


def _narrowed(hot: DataFrame, most: int) -> DataFrame:
    """Rows of hot keys again, under keys that also hold a segment of the longer rest, which has ``x.e`` edits left."""
    m, start, size = "(length(rest) - x.g)", _start("m", "x"), _size("m", "x")
    right = "2 * x.i <= x.e"
    rest = f"if({right}, substring(rest, int({start} + x.s + {size} + 1)), substring(rest, 1, int({start} + x.s)))"
    left = hot.withColumn("m", F.expr(m)).select(
        "key", "own", "even", "k", *_LINE, "line", "c0", "c1", F.expr(rest).alias("rest"),
        F.expr(f"if({right}, x.e - x.i, x.i)").alias("e"), F.expr(f"if({right}, x.g - x.s, x.s)").alias("g"),
    )
    cases = f"filter({_cases(range(most + 1), range(-most, most + 1))}, x -> x.e = e AND x.g = g AND length(rest) >= g)"
    dealt = left.select("*", _raw("rest")).select("*", F.explode(F.expr(cases)).alias("x"))
    key = F.expr(_key("rest", "(length(rest) - g)", "x", "key")).alias("key")
    return dealt.select(key, F.expr("own AND x.s = 0").alias("own"), "x", "even", "k", *_LINE, "line", "c0", "c1", "rest")


def near_pairs(distinct: DataFrame, threshold: int | None) -> DataFrame:
    """Links between different lines, some of them more than once."""
    known = distinct.select(*_LINE, "line", F.length("line").alias("n"))
    if threshold is None:
        known = known.where(f"n >= {CHARS}")
    parts = materialise(_meeting(line_keys(known, threshold)), "line-parts")
    seen = line_keys(known, threshold, *_LINE).where(probable(parts, "of_key")(F.col("key")))
    seen = seen.join(parts, F.col("key") == F.col("of_key"))
    rows = _met(materialise(by_length(seen, threshold, *_LINE), "line-cases"), "line")
    wanted = materialise(rows.select(F.col("h1").alias("w1"), F.col("h2").alias("w2")).distinct(), "line-wanted")
    of_line = (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))
    texts = known.where(probable(wanted, "w1")(F.col("h1"))).join(wanted, of_line).select("w1", "w2", "line", *_counts())
    texts = materialise(texts, "line-texts")
    full = rows.join(texts, of_line).drop("w1", "w2").withColumns({"k": F.col("x.e"), "even": F.expr("x.g = 0"), "rest": F.col("line")})
    links = _links(full.where(f"rows <= {HOT}"), threshold)
    hot = full.where(f"rows > {HOT}")
    for _ in range(DEEPEST):
        if hot.isEmpty():
            return links
        rows = _met(materialise(_narrowed(hot, MOST_EDITS if threshold is None else threshold), "line-hot"), "line-hot")
        links = links.union(_links(rows.where(f"rows <= {HOT}"), threshold))
        hot = rows.where(f"rows > {HOT}")
    return links.union(_links(hot, threshold))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """``h1, h2``, the ``first`` place (doc_id, line_no), ``copies`` and the ``line`` of each distinct line."""
    place = F.struct("doc_id", "line_no")
    return lines(docs).groupBy(*_LINE).agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("line").alias("line"))


def near_lines(docs: DataFrame, threshold: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct lines and the links between them (``a1, a2, b1, b2``, once a pair)."""
    distinct = materialise(distinct_lines(docs), "lines")
    # A pair may come from several keys; the shorter line, or the one of the lesser hash, always comes first.
    return distinct, materialise(near_pairs(distinct, threshold).distinct(), "line-links")


def removed_lines(docs: DataFrame, threshold: int | None = None) -> DataFrame:
    """``doc_id, n_equal, n_near, n_links`` and ``removed``, the ordered numbers (from 0) of lines that go, for documents with any."""
    distinct, links = near_lines(docs, threshold)
    both = links.union(links.select("b1", "b2", "a1", "a2"))
    first = distinct.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("near"))
    near = both.join(first, ["b1", "b2"]).groupBy("a1", "a2").agg(F.min("near").alias("near"), F.count("*").alias("links"))
    of_line = (
        distinct.join(near, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")), "left")
        .where("copies > 1 OR near IS NOT NULL")
        .select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), "first", "near", "links")
    )
    # Written, so that both sides of the join are dealt anew and a common line can be split over tasks.
    of_line = materialise(of_line, "line-fates")
    discard(distinct)
    at = lines(docs).where(probable(of_line, "l1")(F.col("h1"))).select("doc_id", "line_no", *_LINE)
    here = F.struct("doc_id", "line_no")
    flagged = at.join(of_line, (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2"))).select(
        "doc_id", "line_no", "links", (F.col("first") < here).alias("equal"), (F.col("near") < here).alias("close")
    )
    gone = F.expr("equal OR coalesce(close, false)")
    return flagged.groupBy("doc_id").agg(
        F.count_if("equal").alias("n_equal"),
        F.count_if(F.expr("NOT equal AND close")).alias("n_near"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
        F.array_sort(F.collect_set(F.when(gone, F.col("line_no")))).alias("removed"),
    )


def without(text: Column, removed: Column) -> Column:
    """``text`` without the lines of ordered numbers ``removed``: the runs between them, each cut out once."""

    def kept(c: Column) -> Column:
        def run(j: Column) -> Column:
            start = F.when(j == 0, F.lit(0)).otherwise(F.get(c["gone"], j - 1) + 1)
            end = F.when(j == F.size(c["gone"]), F.size(c["lines"])).otherwise(F.get(c["gone"], j))
            return F.slice(c["lines"], start + 1, end - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(c["gone"])), run)), "\n")

    return F.transform(F.array(F.struct(F.split(text, "\n").alias("lines"), removed.alias("gone"))), kept)[0]


def dedup_lines(docs: DataFrame, threshold: int | None = None) -> DataFrame:
    """``docs`` without removed lines; n_chars is made to fit."""
    gone = removed_lines(docs.select("doc_id", "text"), threshold).select(F.col("doc_id").alias("of_doc"), "removed")
    joined = packed_rows(docs).join(gone, F.col("row.doc_id") == F.col("of_doc"), "left")
    text = F.when(F.size("removed") > 0, without(F.col("row.text"), F.col("removed"))).otherwise(F.col("row.text"))
    return unpacked(joined.withColumn("new_text", text), docs, "new_text")
