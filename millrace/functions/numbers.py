"""Doubles as text in the manner of C's ``%f``: six decimals, the exact binary
value rounded half to even. Java's formatter rounds the shortest decimal form
instead, which differs at ties and beyond 2^53."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = float(1 << 53)
#: From here on the digits are those of the shortest decimal form.
_FAR = float(1 << 116)


def six_decimals(x: Column) -> Column:
    """Null for null and NaN."""
    size = F.abs(x)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    whole = F.floor(size).cast("bigint")
    # the fraction is (a + b) / 2^26, both exact; a millionth of it is low and (rest + c) / 2^26
    scaled = (size - whole.cast("double")) * float(1 << 26)
    a = F.floor(scaled).cast("bigint")
    c = (scaled - a.cast("double")) * 1e6
    low, rest = F.shiftright(a * 1_000_000, 26), (a * 1_000_000) % (1 << 26)
    need = (F.lit(1 << 25) - rest).cast("double")
    micros = low + F.when((c > need) | ((c == need) & (low % 2 == 1)), 1).otherwise(0)
    carried, digits = whole + F.floor(micros / 1_000_000).cast("bigint"), micros % 1_000_000
    near = F.concat(sign, carried.cast("string"), F.lit("."), F.lpad(digits.cast("string"), 6, "0"))
    high = F.floor(size / _WHOLE).cast("bigint")
    lower = (size - high.cast("double") * _WHOLE).cast("bigint")
    big = high.cast("decimal(19,0)") * F.lit(1 << 53).cast("decimal(17,0)") + lower.cast("decimal(19,0)")
    far = F.concat(sign, big.cast("string"), F.lit(".000000"))
    return F.when(F.isnan(x) | x.isNull(), F.lit(None).cast("string")).when(size < _WHOLE, near).when(size < _FAR, far).otherwise(F.format_string("%.6f", x))
