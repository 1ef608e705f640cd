"""Choosing, ordering and sampling rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is among the listed ones; an empty list passes everything."""
    return df.where(F.col(column).isin(values)) if values else df


def where_in_table(df: DataFrame, column: str, keys: DataFrame, key: str, negate: bool = False) -> DataFrame:
    """Semi join (or anti join) with a table of keys."""
    return df.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_anti" if negate else "left_semi")


def in_range(df: DataFrame, column: str, start, end, closed_left: bool = True) -> DataFrame:
    """``start <= c <= end``, or ``start < c <= end``."""
    low = F.col(column) >= start if closed_left else F.col(column) > start
    return df.where(low & (F.col(column) <= end))


def drop_counted(df: DataFrame, column: str, order: str, counts: DataFrame) -> DataFrame:
    """Multiset difference that keeps order: the first ``n`` rows of each value of ``counts`` ``(value, n)`` are dropped."""
    from tessera.operators.windows import positions

    numbered = positions(df, [column], [order], "__r").join(counts.select(F.col("value").alias(column), F.col("n").alias("__n")), column, "left")
    return numbered.where(F.col("__r") >= F.coalesce("__n", F.lit(0))).select(*df.columns)


def project(df: DataFrame, conversions: str | list[str] | dict[str, str | Callable[[], Column] | Column], **extra: Column) -> DataFrame:
    """A projection: a name, names, or ``{out: name or column}``; names that are missing are left out; ``extra`` columns are added."""
    if isinstance(conversions, str):
        conversions = [conversions]
    if not isinstance(conversions, dict):
        conversions = {c: c for c in conversions}
    chosen = [F.col(c).alias(out) if isinstance(c, str) else (c() if callable(c) and not isinstance(c, Column) else c).alias(out) for out, c in conversions.items() if not isinstance(c, str) or c in df.columns]
    return df.select(*chosen, *[c.alias(n) for n, c in extra.items()])


def columns_with_prefix(df: DataFrame, prefix: str, strip: bool = True) -> DataFrame:
    return df.select(*[F.col(c).alias(c[len(prefix) :] if strip else c) for c in df.columns if c.startswith(prefix)])


def columns_first(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, *[c for c in df.columns if c not in names])


def renamed(df: DataFrame, prefix: str = "", suffix: str = "", sep: str = "_", once: bool = False, only: list[str] | None = None) -> DataFrame:
    """All columns (or those of ``only``) with a prefix and suffix, not again where they have it with ``once``."""

    def new(c: str) -> str:
        if prefix and not (once and c.startswith(prefix + sep)):
            c = prefix + sep + c
        return c if not suffix or once and c.endswith(sep + suffix) else c + sep + suffix

    return df.toDF(*[new(c) if only is None or c in only else c for c in df.columns])


def split_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    return df.select(*[c for c in df.columns if c in names]), df.select(*[c for c in df.columns if c not in names])


def until_first(df: DataFrame, cond: Column, order: str, by: list[str] = ()) -> DataFrame:
    """Rows up to and including the first that meets the condition; all, if none does."""
    first = _first(df, cond, order, by)
    return _with(df, first, by).where(F.col("__at").isNull() | (F.col(order) <= F.col("__at"))).drop("__at")


def after_first(df: DataFrame, cond: Column, order: str, by: list[str] = (), keep: bool = False) -> DataFrame:
    """Rows after the first that meets the condition (with it, if kept)."""
    at = _with(df, _first(df, cond, order, by), by)
    return at.where(F.col(order) >= F.col("__at") if keep else F.col(order) > F.col("__at")).drop("__at")


def _first(df: DataFrame, cond: Column, order: str, by: list[str]) -> DataFrame:
    return df.where(cond).groupBy(*by).agg(F.min(order).alias("__at"))


def _with(df: DataFrame, first: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return df.join(first, list(by), "left")
    at = first.first()["__at"]
    return df.withColumn("__at", F.lit(at).cast(first.schema["__at"].dataType))


def closest(df: DataFrame, column: str, x: float, k: int) -> DataFrame:
    """The ``k`` rows closest to ``x``, smaller ones first among equals, in order of the column."""
    return df.orderBy(F.abs(F.col(column) - x), column).limit(k).orderBy(column)


def floor_value(df: DataFrame, column: str, x) -> DataFrame:
    return df.where(F.col(column) <= x).agg(F.max(column).alias(column))


def ceiling_value(df: DataFrame, column: str, x) -> DataFrame:
    return df.where(F.col(column) >= x).agg(F.min(column).alias(column))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; the rank filter keeps ``k`` rows per group and task before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def sample_rows(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``k`` rows."""
    return df.orderBy(F.rand(seed)).limit(k)


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """A sample of ``k`` rows that depends on the keys only, not on how the rows lie; ties by key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(k)


def ordered_sample(df: DataFrame, k: int, order: str, must: Column | None = None, seed: int = 0) -> DataFrame:
    """``k`` rows in their order: those that must be kept, and a uniform sample of the others."""
    must = F.lit(False) if must is None else F.coalesce(must, F.lit(False))
    return df.withColumn("__m", must).orderBy(F.desc("__m"), F.rand(seed)).limit(k).drop("__m").orderBy(order)


def weighted_split(df: DataFrame, key: str, weights: list[float]) -> DataFrame:
    """``df`` with ``split``: rows dealt by the hash of their key in shares of the weights, the same every time."""
    total, cut, at = sum(weights), [], 0.0
    for x in weights[:-1]:
        at += x / total
        cut.append(at)
    u = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return df.withColumn("split", reduce(lambda out, c: out + (u >= c).cast("int"), cut, F.lit(0)))
