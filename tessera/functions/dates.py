"""Dates: ranges, batches, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FORMAT = "MM/dd/yyyy"
# fixed values: what a name with a date holds, down to each granularity
GRANULARITY = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH", "minute": "yyyyMMddHHmm", "second": "yyyyMMddHHmmss"}


def to_date(value: Column, fmt: str = DEFAULT_FORMAT) -> Column:
    """A date from text; null where it cannot be read."""
    return F.to_date(F.try_to_timestamp(value, F.lit(fmt)))


def reformat(value: Column, source: str = DEFAULT_FORMAT, target: str = "yyMMdd") -> Column:
    return F.date_format(to_date(value, source), target)


def add_days(value: Column, n: int, fmt: str | None = None) -> Column:
    """``n`` days later (earlier for negative n), as text in the same format if one is given."""
    moved = F.date_add(to_date(value, fmt) if fmt else value, n)
    return F.date_format(moved, fmt) if fmt else moved


def stamped(name: Column, when: Column, granularity: str = "day", sep: str = "_") -> Column:
    """A name with its date down to the granularity before the extension."""
    date = F.date_format(when, GRANULARITY[granularity])
    return F.regexp_replace(name, r"^(.*?)(\.[^./]*)?$", F.concat(F.lit("$1" + sep), date, F.lit("$2")))


def dates(start: Column, end: Column, step_days: int = 1) -> Column:
    """All dates from start to end, both included, forward or backward."""
    step = F.when(start <= end, F.lit(abs(step_days))).otherwise(F.lit(-abs(step_days)))
    return F.sequence(start, end, F.make_dt_interval(step))


def days_from(start: Column, n: int) -> Column:
    """``n`` dates from ``start`` on, itself included; backward for a negative n."""
    if n == 0:
        return F.array().cast("array<date>")
    return dates(start, F.date_add(start, n - 1 if n > 0 else n + 1))


def batches_back(end: Column, num_days: int, size: int | str = "monthly") -> Column:
    """The ``num_days`` days up to ``end`` in batches, the last first: ``array<struct<start, end>>``.

    ``size`` is a number of days, ``monthly`` (calendar months) or ``biweekly`` (the days from the 16th, then those up to the
    15th).  The first and last batch may be partial.
    """
    days = days_from(end, -num_days)
    if isinstance(size, int):
        index = lambda d: F.floor(F.datediff(end, d) / size).cast("bigint")
    else:
        month = lambda d: (F.year(end) * 12 + F.month(end) - F.year(d) * 12 - F.month(d)).cast("bigint")
        half = lambda d: F.when(F.dayofmonth(d) <= 15, 1).otherwise(0)
        index = month if size == "monthly" else lambda d: month(d) * 2 + half(d)
    numbers = F.array_distinct(F.transform(days, index))
    return F.transform(numbers, lambda k: F.struct(F.array_min(F.filter(days, lambda d: index(d) == k)).alias("start"), F.array_max(F.filter(days, lambda d: index(d) == k)).alias("end")))


def week_range(date: Column, end: str, weeks: int = 1) -> Column:
    """How many ranges of ``weeks`` weeks a date lies before ``end`` (0: in the last range); negative after it."""
    return F.floor(F.datediff(F.lit(end).cast("date"), date) / (7 * weeks)).cast("bigint")


_FIELDS = {"year": "y", "month": "M", "day": "d", "hour": "H", "minute": "m", "second": "s"}


def format_down_to(granularity: str, fmt: str) -> str:
    """A format without the fields finer than the granularity, and without the separators that are left over."""
    names = list(_FIELDS)
    finer = "".join(_FIELDS[f] for f in names[names.index(granularity) + 1 :])
    kept = [part for part in re.findall(r"([yMdHms])\1*|[^yMdHms]+", fmt)]
    tokens = [m[0] for m in re.finditer(r"([yMdHms])\1*|[^yMdHms]+", fmt)]
    out: list[str] = []
    for token, letter in zip(tokens, kept, strict=True):
        if letter and letter in finer:
            continue
        if not letter and (not out or not _is_field(out[-1])):
            continue
        out.append(token)
    while out and not _is_field(out[-1]):
        out.pop()
    return "".join(out)


def _is_field(token: str) -> bool:
    return token[0] in "yMdHms"


def now_text(fmt: str = "yyyyMMddHHmmss") -> Column:
    """The time the query started, as text."""
    return F.date_format(F.current_timestamp(), fmt)


def today_text(fmt: str = "yyyyMMdd") -> Column:
    return F.date_format(F.current_date(), fmt)
