"""Durations as people write them, read from left to right: a clock, or a number with units; pandas UDFs over Arrow batches.

``1:30``, ``90 min``, ``1.5 hr``, ``1 hr 30``, ``2 ชม. ครึ่ง``. One reader serves texts that hold durations and texts
that are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from quillspark.functions.text import THAI_DIGITS

# Spellings of units and of a half.
HOURS = ("ชั่วโมง", "ชัวโมง", "ช.ม.", "ชม.", "ชม", "ซม.", "ซม", "hours", "hour", "hrs.", "hrs", "hr.", "hr", "h")
CUT_HOURS = ("ช.", "ช")
MINUTES = ("นาที", "นท.", "นท", "น.", "minutes", "minute", "mins.", "mins", "min.", "min", "m")
HALF = "ครึ่ง"
DIGITS = "0123456789"
_TO_ASCII = str.maketrans(THAI_DIGITS, DIGITS)
_INT_MAX = 2**31 - 1


@dataclass(frozen=True)
class Duration:
    """Where a duration stands in a text and how long it is, before rounding; ``unit`` is clock, hour, minute or none."""

    start: int
    end: int
    minutes: float
    unit: str


def _is_thai(c: str) -> bool:
    return "ก" <= c <= "๙"


def _spaces(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _digits(text: str, at: int) -> int:
    while at < len(text) and text[at] in DIGITS:
        at += 1
    return at


def _unit(text: str, at: int, words: tuple[str, ...]) -> int:
    """Where the longest of ``words`` at ``at`` ends, or -1; a lone Latin letter or a cut Thai one ends a word."""
    best = -1
    for word in words:
        end = at + len(word)
        if end <= best or text[at:end].lower() != word:
            continue
        after = text[end : end + 1]
        if (len(word) == 1 and word.isascii() and "a" <= after.lower() <= "z") or (word in CUT_HOURS and after and _is_thai(after)):
            continue
        best = end
    return best


def hours_at(text: str, at: int, cut: bool) -> int:
    return _unit(text, at, HOURS + CUT_HOURS if cut else HOURS)


def _extra_minutes(text: str, at: int, cut: bool) -> tuple[int, int]:
    """Minutes that follow hours, and where they end: two digits, or one with its unit, that belong to nothing else."""
    start = _spaces(text, at)
    end = _digits(text, start)
    after = _spaces(text, end)
    unit = _unit(text, after, MINUTES)
    whole = end - start == 2 and text[start] in "12345" or end - start == 1 and unit > 0
    taken = text[end : end + 1] in tuple(".,:") or hours_at(text, after, cut) > 0
    return (int(text[start:end]), unit if unit > 0 else end) if whole and not taken else (0, at)


def read(text: str, at: int, cut: bool = True, bare: bool = False) -> Duration | None:
    """The duration that starts with the digit at ``at``; ``cut``: hour units may be cut short, ``bare``: a number alone will do."""
    end = _digits(text, at)
    before = text[at - 1 : at]
    if end - at == 1 and text[at] in "01234" and text[end : end + 1] == ":" and before != ":" and before not in tuple(DIGITS):
        last = _digits(text, end + 1)
        if last - end == 3 and text[end + 1] in "012345" and text[last : last + 1] != ":":
            return Duration(at, last, 60 * int(text[at]) + int(text[end + 1 : last]), "clock")
    decimals = _digits(text, end + 1)
    if text[end : end + 1] in tuple(".,") and decimals > end + 1:
        end = decimals
    amount, after = float(text[at:end].replace(",", ".")), _spaces(text, end)
    stop = hours_at(text, after, cut)
    if stop > 0:
        half = _spaces(text, stop)
        halved = text.startswith(HALF, half)
        more, stop = _extra_minutes(text, half + len(HALF) if halved else stop, cut)
        return Duration(at, stop, 60 * amount + 30 * halved + more, "hour")
    stop = _unit(text, after, MINUTES)
    if stop > 0:
        return Duration(at, stop, amount, "minute")
    return Duration(at, end, amount, "none") if bare else None


def durations(text: str) -> Iterator[Duration]:
    """All durations inside a text, which has ASCII digits."""
    at = 0
    while at < len(text):
        found = read(text, at) if text[at] in DIGITS else None
        if found:
            yield found
        at = found.end if found else at + 1


def rounded(minutes: float) -> int | None:
    """Halves round to even."""
    return round(minutes) if minutes <= _INT_MAX else None


def whole_minutes(text: str) -> int | None:
    """Minutes of a text that is one duration, with a point at most behind it; halves round up, a bare number to 4 is hours."""
    source = text.translate(_TO_ASCII).strip()
    if source[:1] not in tuple(DIGITS):
        return None
    found = read(source, 0, cut=False, bare=True)
    if source[found.end :] not in ("", "."):
        return None
    minutes = 60 * found.minutes if found.unit == "none" and found.minutes <= 4 else found.minutes
    return math.floor(minutes + 0.5) if minutes <= _INT_MAX else None


@pandas_udf(IntegerType())
def reviewer_minutes(texts: pd.Series) -> pd.Series:
    """Minutes of texts that are one whole duration, else null."""
    return texts.map(lambda t: None if t is None else whole_minutes(t)).astype("Int32")


@pandas_udf(IntegerType())
def first_duration_minutes(texts: pd.Series) -> pd.Series:
    """Minutes of the first duration inside each text, a lone hour letter included."""

    def one(text: str | None) -> int | None:
        found = None if text is None else next(durations(text.translate(_TO_ASCII)), None)
        return None if found is None else rounded(found.minutes)

    return texts.map(one).astype("Int32")
