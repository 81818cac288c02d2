"""Exact order of decimal numbers in text, as plain sortable columns.

A number is compared by sign, then by the place of its first digit, then by its
digits; negative ones the other way round. So neither doubles nor a fixed
precision are needed. Texts that are no number come after numbers, blank ones last, in
either direction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[ \t\n\r\f]*"
_NUMBER = rf"\A{_W}[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?{_W}\z"
_MOST = "9223372036854775807"


def numeric_key(key: Column) -> list[Column]:
    """Columns ``grp, sign, magnitude, body`` of a text key.

    An exponent beyond 64 bits in a valid number is an error of the whole sort.
    """
    blank, number = key.rlike(rf"\A{_W}\z"), key.rlike(_NUMBER)
    whole = F.regexp_extract(key, rf"\A{_W}[+-]?([0-9]*)", 1)
    fraction = F.regexp_extract(key, rf"\A{_W}[+-]?[0-9]*[.]([0-9]*)", 1)
    exponent = F.regexp_extract(key, rf"[eE]([+-]?[0-9]+){_W}\z", 1)
    digits = F.concat(whole, fraction)
    significant = F.regexp_replace(digits, r"\A0+|0+\z", "")
    lead = F.length(digits) - F.length(F.regexp_replace(digits, r"\A0+", ""))
    size = F.regexp_replace(exponent, r"\A[+-]?0*", "")
    minus = F.startswith(F.trim(F.translate(key, "\t\n\r\f", "    ")), F.lit("-"))
    too_far = number & ((F.length(size) > len(_MOST)) | ((F.length(size) == len(_MOST)) & (size > _MOST)))
    power = F.when(exponent.startswith("-"), -F.nullif(size, F.lit("")).cast("decimal(20,0)")).otherwise(F.nullif(size, F.lit("")).cast("decimal(20,0)"))
    sign = F.when(~number | (significant == ""), 0).when(minus, -1).otherwise(1)
    magnitude = F.when(sign == 0, F.lit(0).cast("decimal(38,0)")).otherwise((sign * (F.length(whole) - lead + F.coalesce(power, F.lit(0).cast("decimal(20,0)")))).cast("decimal(38,0)"))
    group = F.when(too_far, F.raise_error(F.lit("a number's exponent is out of range")).cast("int")).when(blank, 2).when(number, 0).otherwise(1)
    body = F.when(blank, "").when(~number, key).when(sign < 0, F.concat(F.translate(significant, "0123456789", "9876543210"), F.lit("~"))).otherwise(significant)
    return [group.alias("grp"), sign.alias("sign"), magnitude.alias("magnitude"), body.alias("body")]
