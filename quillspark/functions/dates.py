"""Dates, clock times, durations and the numbers derived from them; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import ascii_digits

LOCAL_ZONE = "Asia/Bangkok"
# Month names by number.
MONTHS = (
    ("jan", "january", "ม.ค", "มค", "มกราคม"),
    ("feb", "february", "ก.พ", "กพ", "กุมภาพันธ์"),
    ("mar", "march", "มี.ค", "มีค", "มีนาคม"),
    ("apr", "april", "เม.ย", "เมย", "เมษายน"),
    ("may", "พ.ค", "พค", "พฤษภาคม"),
    ("jun", "june", "มิ.ย", "มิย", "มิถุนายน"),
    ("jul", "july", "ก.ค", "กค", "กรกฎาคม"),
    ("aug", "august", "ส.ค", "สค", "สิงหาคม"),
    ("sep", "sept", "september", "ก.ย", "กย", "กันยายน"),
    ("oct", "october", "ต.ค", "ตค", "ตุลาคม"),
    ("nov", "november", "พ.ย", "พย", "พฤศจิกายน"),
    ("dec", "december", "ธ.ค", "ธค", "ธันวาคม"),
)
# What may part hours from minutes, and what may follow a time, with the half of the day that it names.
TIME_SEPARATORS = (":", ".", ";", ",", "h", "")
TIME_ENDINGS = {"": "", "am": "a", "pm": "p", "a.m.": "a", "p.m.": "p", "น": "", "น.": "", "นาฬิกา": ""}
HOUR_WORDS, THAI_HOUR_WORDS = ("h", "hr", "hrs", "hour", "hours"), ("ชม", "ชั่วโมง")


def full_year(year: Column) -> Column:
    """Two digits from 50 on are Buddhist (25xx), below it 20xx; Buddhist years are 543 ahead."""
    long = F.when(year >= 100, year).when(year >= 50, year + 2500).otherwise(year + 2000)
    return F.when(long >= 2400, long - 543).otherwise(long)


def parse_date(raw: Column) -> Column:
    """A handwritten date as a DATE, or null: day first, year first, month names, months and days swapped back."""
    text = F.lower(ascii_digits(raw))
    words = F.transform(F.regexp_extract_all(text, F.lit("([a-zก-๙.]+)"), F.lit(1)), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    names = F.create_map(*(F.lit(x) for k, of in enumerate(MONTHS, 1) for n in of for x in (n, k)))
    month = F.get(F.filter(F.transform(words, lambda w: F.try_element_at(names, w)), lambda m: m.isNotNull()), F.lit(0))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1)), lambda n: n.try_cast("int"))
    a, b, c = (F.get(numbers, F.lit(k)) for k in range(3))
    day_first = a <= 31
    day, mid, year = F.when(day_first, a).otherwise(c), b, F.when(day_first, c).otherwise(a)
    swapped = (mid > 12) & (day <= 12)
    whole = F.struct(
        full_year(year).alias("y"), F.when(swapped, day).otherwise(mid).alias("m"), F.when(swapped, mid).otherwise(day).alias("d")
    )
    named = F.struct(full_year(F.when(day_first, b).otherwise(a)).alias("y"), month.alias("m"), F.when(day_first, a).otherwise(b).alias("d"))
    parts = F.when(month.isNotNull(), F.when(F.size(numbers) >= 2, named)).when(F.size(numbers) == 3, whole)
    made = F.format_string("%04d-%02d-%02d", parts["y"], parts["m"], parts["d"]).try_cast("date")
    return F.when(parts["y"].between(2000, 2100), made)


def parse_time(raw: Column) -> Column:
    """A clock time as ``HH:MM``, or null: ``14:30``, ``2.30 pm``, ``1430``, ``2pm``.

    A time is its numbers and its shape: what is left when each number is a mark. The shape says what the numbers are.
    """
    text = F.trim(F.lower(ascii_digits(raw)))
    numbers = F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))
    shape = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "#"), r"\s*#\s*", "#")
    first, second = (F.coalesce(F.get(numbers, F.lit(k)), F.lit("")) for k in range(2))
    endings = {e + dot: half for e, half in TIME_ENDINGS.items() for dot in ("", ".")}
    parts = [(f"#{sep}#{e}", "pair", half) for sep in TIME_SEPARATORS for e, half in endings.items()]
    parts += [(f"#{e}", "four", "") for e in ("", "น", "น.")] + [(f"#{e}", "hour", e[0]) for e in ("am", "pm")]
    forms = F.create_map(*(F.lit(x) for s, kind, half in parts for x in (s, f"{kind}:{half}")))
    form = F.coalesce(F.try_element_at(forms, shape), F.lit(":"))
    kind, half = F.substring_index(form, ":", 1), F.substring_index(form, ":", -1)
    short = F.length(first) <= 2
    hour = F.when((kind == "four") & (F.length(first) == 4), F.substring(first, 1, 2)).when((kind == "pair") & short & (F.length(second) == 2), first)
    hour = hour.when((kind == "hour") & short, first).try_cast("int")
    minute = F.when(kind == "four", F.substring(first, 3, 2)).when(kind == "pair", second).otherwise("0").try_cast("int")
    hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
    return F.when((hour < 24) & (minute < 60), F.format_string("%02d:%02d", hour, minute))


def looks_like_duration(raw: Column, parsed: Column) -> Column:
    """A time that is more likely a session's length: before 09:00 with nothing behind it, or with an hour unit."""
    text = F.lower(ascii_digits(raw))
    bare = F.regexp_replace(text, r"[\s.]+$", "")
    ended = F.lit(False)
    for ending in sorted({e.rstrip(".") for e in TIME_ENDINGS} - {""}):
        ended = ended | bare.endswith(ending)
    early = F.substring(parsed, 1, 2).try_cast("int") < 9
    words = F.regexp_extract_all(text, F.lit(r"[0-9]\s*([a-z]+|[ก-๙]+)"), F.lit(1))

    def is_hours(word: Column) -> Column:
        out = word.isin(*HOUR_WORDS)
        for start in THAI_HOUR_WORDS:
            out = out | word.startswith(start)
        return out

    return (~ended & early) | F.exists(words, is_hours)


def _amount(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def total_as_hours(total: Column, has_unit: Column) -> Column:
    """A unit-less total that can't be a session's minutes, but starts with 1 to 4, is hours."""
    first = F.substring(total.cast("string"), 1, 1).cast("int")
    plain = has_unit | total.between(30, 240) | ((total < 30) & (total % 5 == 0))
    return F.when(plain, total).when(first.between(1, 4), first * 60).otherwise(total)


def written_total(text: Column) -> Column:
    """A label's total: up to 4, or with an hour letter, in hours; else minutes; ``unparsed`` when it isn't a number."""
    number = _amount(F.regexp_extract(ascii_digits(text), r"([0-9]+(?:[.,][0-9]+)?)", 1))
    minutes = F.when((number <= 4) | text.contains("ช"), number * 60).otherwise(number)
    return F.when(text.isNull(), None).when(number.isNull(), F.lit("unparsed")).otherwise(F.bround(minutes).cast("int").cast("string"))


def local_day_start(day: Column, zone: str = LOCAL_ZONE) -> Column:
    """The instant at which a local day starts, as a UTC wall clock."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def local_text(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """A local wall clock to the second."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss")


def row_version(ts: Column) -> Column:
    """Exact microseconds, in UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def displayed_percent(confidence: Column) -> Column:
    """Up to 1 is a fraction; halves round up."""
    return F.floor(F.when(confidence <= 1, confidence * 100).otherwise(confidence) + 0.5).cast("long")


def backoff_seconds(attempts: Column) -> Column:
    """Two to the attempts, at most an hour."""
    return F.least(F.lit(3600), F.pow(F.lit(2), F.least(attempts, F.lit(10)))).cast("long")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
