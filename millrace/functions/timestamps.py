"""ISO-like timestamps, read leniently: text after the seconds is ignored (an
offset too), days roll over, a second may be 60, and the fraction is what
follows the first dot, cut at six digits. A Column form and its Python twin."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^\s*([+-]?\d+)-\s*([+-]?\d+)-\s*([+-]?\d+)T\s*([+-]?\d+):\s*([+-]?\d+):\s*([+-]?\d+)"
_FRACTION = r"^[^.]*\.(\d*)"
#: month, day, hour, minute, second
_RANGES = ((1, 12), (1, 31), (0, 23), (0, 59), (0, 60))


def timestamp_micros(text: Column) -> Column:
    """Microseconds since 1970 in UTC, null where the text is no timestamp."""
    year, *rest = (F.regexp_extract(text, _PARTS, i).try_cast("int") for i in range(1, 7))
    fits = text.rlike(_PARTS) & year.between(-290_000, 290_000)
    for part, (low, high) in zip(rest, _RANGES, strict=True):
        fits = fits & part.between(low, high)
    month, day, hour, minute, second = rest
    days = F.unix_date(F.date_add(F.make_date(year, month, F.lit(1)), day - 1)).cast("bigint")
    digits = F.rpad(F.substring(F.regexp_extract(text, _FRACTION, 1), 1, 6), 6, "0")
    micros = F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(fits, (days * 86_400 + hour * 3600 + minute * 60 + second) * 1_000_000 + micros)


def usual_micros(text: Column) -> Column:
    """As ``timestamp_micros`` for texts like 2026-01-31T10:00:00.5Z, by one cast of
    their first 19 characters; null for every other text, timestamps of another shape too."""
    head = F.substring(text, 1, 19)
    seconds = F.unix_micros(F.concat(head, F.lit("Z")).try_cast("timestamp"))
    digits = F.rpad(F.substring(F.regexp_extract(F.substring(text, 20, 12), r"^\.([0-9]*)", 1), 1, 6), 6, "0").try_cast("bigint")
    micros = F.when(F.instr(text, ".") == 0, F.lit(0).cast("bigint")).when(F.substring(text, 20, 1) == ".", digits)
    return F.when(head.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"), seconds + micros)


def parse_timestamp(text: Column) -> Column:
    return F.timestamp_micros(timestamp_micros(text))


def looks_like_timestamp(text: Column) -> Column:
    return timestamp_micros(text).isNotNull()


def _days(year: int, month: int) -> int:
    """Days from 1970-01-01 to the first of a month, proleptic Gregorian."""
    y = year - (month <= 2)
    shifted = (month + 9) % 12
    return 365 * y + y // 4 - y // 100 + y // 400 + (153 * shifted + 2) // 5 - 719_468


def timestamp_micros_py(text: str) -> int | None:
    m = re.match(_PARTS, text, re.ASCII)
    if not m:
        return None
    year, *rest = map(int, m.groups())
    if not -290_000 <= year <= 290_000 or any(not lo <= p <= hi for p, (lo, hi) in zip(rest, _RANGES, strict=True)):
        return None
    month, day, hour, minute, second = rest
    f = re.match(_FRACTION, text, re.ASCII)
    micros = int((f[1][:6] if f else "").ljust(6, "0"))
    return ((_days(year, month) + day - 1) * 86_400 + hour * 3600 + minute * 60 + second) * 1_000_000 + micros
