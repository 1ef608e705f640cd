"""Arithmetic that does not fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(x: Column, y: Column, default: float | None = 0) -> Column:
    """``x / y``, or the default where ``y`` is 0."""
    return F.when(y == 0, F.lit(default)).otherwise(F.try_divide(x, y))


def is_close(x: Column, y: Column, tolerance: float = 1e-4, ratio: bool = True) -> Column:
    """Strictly within the tolerance, of the ratio to ``y`` or of the difference; a ratio to 0 is null."""
    return F.abs(F.try_divide(x, y) - 1) < tolerance if ratio else F.abs(x - y) < tolerance


def is_negligible(x: Column, y: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(F.try_divide(x, y)) < tolerance


def part_of(total: Column, parts: int, k: Column) -> Column:
    """The k-th (from 0) of near-equal integer parts; earlier parts take the remainder."""
    total = total.cast("bigint")
    return F.floor(total / parts) + F.when(k < total % parts, 1).otherwise(0)


def short_number(n: Column, digits: int = 3) -> Column:
    """An integer in ``digits`` significant digits with a letter for its magnitude (1621 is 1.62K)."""
    size = F.abs(n)
    letters = ["", "K", "M", "B", "T"]
    power = F.when(size < 1, 0).otherwise(F.least(F.floor(F.log10(size) / 3 + 1e-12), F.lit(len(letters) - 1))).cast("int")
    scaled = n / F.pow(F.lit(1000.0), power)
    whole = F.when(scaled == 0, 1).otherwise(F.floor(F.log10(F.abs(scaled)) + 1e-12) + 1)
    unit = F.pow(F.lit(10.0), F.greatest(F.lit(digits) - whole, F.lit(0)))
    text = (F.round(scaled * unit) / unit).cast("decimal(24,6)").cast("string")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.element_at(F.array(*map(F.lit, letters)), power + 1))
