"""Scalar functions as Spark expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """Fold A to Z only; other letters keep their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def column_letters(number: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA ... up to three letters."""
    n = number.cast("long")
    letter = lambda x: F.char(F.lit(65) + x.cast("int"))
    one, two = n - 1, n - 27
    three = n - 703
    return (
        F.when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(F.pmod(two, F.lit(26)))))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.pmod(F.floor(three / 26), F.lit(26))), letter(F.pmod(three, F.lit(26)))))
    )


def size_text(size: Column) -> Column:
    """Whole megabytes, or tenths of gigabytes, rounded up."""
    gb, mb = F.lit(1 << 30), F.lit(1 << 20)
    exact = lambda a, b: ((a + b - 1 - F.pmod(a + b - 1, b)) / b).cast("long")
    tenths = exact(size * 10, gb)
    return F.when(size >= gb, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" GB"))).otherwise(F.concat(exact(size, mb).cast("string"), F.lit(" MB")))


def row_label(row: Column) -> Column:
    """The one-based number that is shown for a zero-based row."""
    return (row + 1).cast("string")


def escape_display(text: Column) -> Column:
    """Control characters as visible escapes; a pass over the text only where one stands.

    LF, CR, TAB and NUL have short forms, other control characters are ``\\u{HEX}``.
    """
    short = text
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        short = F.replace(short, F.lit(raw), F.lit(shown))

    def other(c: Column) -> Column:
        code = F.ascii(c)
        return F.when((code < 32) | code.between(127, 159), F.concat(F.lit("\\u{"), F.hex(code), F.lit("}"))).otherwise(c)

    return F.when(short.rlike(r"[\x00-\x1f\x7f-\x9f]"), F.array_join(F.transform(F.split(short, ""), other), "")).otherwise(short)
