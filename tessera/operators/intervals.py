"""Intervals of numbers or times, per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, start: str, end: str, by: list[str] = ()) -> DataFrame:
    """``(*by, start, end)``: overlapping and touching intervals as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")


def has_overlap(df: DataFrame, start: str, end: str, by: list[str] = ()) -> DataFrame:
    """``(*by, overlap)``: two intervals share more than an end point."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__o", F.coalesce(F.col(start) < reach, F.lit(False))).groupBy(*by).agg(F.bool_or("__o").alias("overlap"))


def max_overlap(df: DataFrame, start: str, end: str, by: list[str] = ()) -> DataFrame:
    """``(*by, peak)``: how many intervals are open at once.  An interval ends before another that starts there begins; one of no
    length counts at its own start."""
    named = lambda at, order, step: F.struct(at.alias("__t"), order.alias("__o"), F.lit(step).alias("__d"))
    point = named(F.col(start), F.lit(1), 1), named(F.col(end), F.when(F.col(end) > F.col(start), 0).otherwise(2), -1)
    events = df.select(*by, F.inline(F.array(*point)))
    # ends of proper intervals first, then starts, then ends of those of no length
    w = Window.partitionBy(*by).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("__n", F.sum("__d").over(w)).groupBy(*by).agg(F.max("__n").alias("peak"))


def interval_join(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, width: float, by: list[str] = ()) -> DataFrame:
    """Pairs of rows whose intervals share a point, met through buckets of ``width``.

    A pair is found in the bucket of the later of both starts only, so none comes twice.  Column names must differ but for ``by``.
    """
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    l = left.withColumn("__b", F.explode(F.sequence(bucket(l_start), bucket(l_end))))  # noqa: E741
    r = right.withColumn("__b", F.explode(F.sequence(bucket(r_start), bucket(r_end))))
    later = F.floor(F.greatest(F.col(l_start), F.col(r_start)).cast("double") / width)
    met = l.join(r, [*by, "__b"]).where((F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end)) & (F.col("__b") == later))
    return met.drop("__b")
