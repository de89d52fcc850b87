"""Column expressions shared by the operators. All are built from Spark functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since the epoch; expects a UTC session zone for zone-less times."""
    return F.unix_seconds(as_col(ts).cast("timestamp"))


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round half up by floor, the form that gives the same answer in other engines.

    Infinite values pass through unchanged.
    """
    x = as_col(c)
    scale = float(10**digits)
    finite = F.abs(x) < F.lit(9e18 / scale)
    return F.when(finite, F.floor(x * scale + 0.5) / scale).otherwise(x.cast("double"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(as_col(a), as_col(b))


def pearson(a: str | Column, b: str | Column) -> Column:
    """Correlation of two columns, NULL where one of them does not vary (``corr`` fails there)."""
    a, b = as_col(a), as_col(b)
    spread = F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b))
    return F.regr_sxy(a, b) / F.when(spread > 0, spread)


def blank_nan(c: str | Column) -> Column:
    """NaN to NULL: aggregates then skip the value."""
    x = as_col(c)
    return F.when(~F.isnan(x), x)


def exact_cents(total: str | Column, scale: int = 2) -> Column:
    """Sum of a money-like column without order-dependent float error."""
    return F.sum(as_col(total).cast(f"decimal(18,{scale})")).cast("double")


def python_strip(c: str | Column) -> Column:
    """Remove any Unicode whitespace, and the ASCII separators, at both ends."""
    return F.regexp_replace(as_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


# Period of each calendar part and the part as a column of the time.
CALENDAR_PERIODS = {"hour": 24, "day_of_week": 7, "month": 12}


def calendar_part(ts: str | Column, part: str) -> Column:
    """hour 0-23, day_of_week 0-6 from Monday, month 1-12."""
    t = as_col(ts)
    if part == "hour":
        return F.hour(t)
    if part == "day_of_week":
        return F.weekday(t)
    if part == "month":
        return F.month(t)
    raise ValueError(f"unknown calendar part {part!r}")


def cyclical(ts: str | Column, part: str) -> tuple[Column, Column]:
    """Sine and cosine of a calendar part on its period."""
    angle = F.lit(2 * math.pi) * calendar_part(ts, part) / F.lit(float(CALENDAR_PERIODS[part]))
    return F.sin(angle), F.cos(angle)


def first_at_min(value: str | Column, by: str | Column, ts: str | Column) -> Column:
    """``value`` on the row where ``by`` is smallest; the earliest row wins a tie."""
    x = as_col(by)
    return F.min_by(as_col(value), F.when(x.isNotNull(), F.struct(x.alias("x"), as_col(ts).alias("t"))))


def first_at_max(value: str | Column, by: str | Column, ts: str | Column) -> Column:
    """``value`` on the row where ``by`` is largest; the earliest row wins a tie."""
    return first_at_min(value, -as_col(by), ts)


# Fixed value: number of hex digits kept from the digest, so that the number fits 48 bits.
HASH_HEX_DIGITS = 12


def hash_unit(*parts: str | Column) -> Column:
    """A repeatable number in [0, 1) from the text of ``parts``."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    digest = F.conv(F.substring(F.md5(text), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")
    return digest / F.lit(float(16**HASH_HEX_DIGITS))
