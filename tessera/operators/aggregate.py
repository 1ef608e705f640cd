"""Several aggregations at once, confusion matrices, frequencies and merges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Named aggregates.  ``bmin`` is 1 where all values are at least 1, ``bmax`` where any is.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp, "size": F.count, "count": F.count,
    "distinct": F.count_distinct, "group": F.collect_list, "set": F.collect_set,
    "bmin": lambda c: F.min((c >= 1).cast("int")), "bmax": lambda c: F.max((c >= 1).cast("int")),
    "approx_distinct": F.approx_count_distinct, "approx_median": lambda c: F.percentile_approx(c, 0.5),
}


@dataclass(frozen=True)
class Aggregation:
    """Targets, the aggregate (a name or a function of a column) and the group keys.

    ``explode`` says how keys that are arrays count a row in several groups: ``product`` of their elements, ``zip`` them, or ``none``.
    """

    target: str | list[str]
    agg: str | Callable[[Column], Column] = "mean"
    groupby: list[str] = field(default_factory=list)
    explode: str = "product"
    alias: str | None = None

    def columns(self) -> list[Column]:
        targets = [self.target] if isinstance(self.target, str) else self.target
        f = AGGREGATES[self.agg] if isinstance(self.agg, str) else self.agg
        name = self.alias or (self.agg if isinstance(self.agg, str) else getattr(self.agg, "__name__", "value"))
        return [f(F.col(t)).alias(f"{t}.{name}" if self.alias is None else (name if len(targets) == 1 else f"{t}.{name}")) for t in targets]


def exploded(df: DataFrame, keys: list[str], how: str = "product") -> DataFrame:
    """Rows for the elements of the array columns among ``keys``: of their product, or zipped position by position."""
    arrays = [k for k in keys if isinstance(df.schema[k].dataType, T.ArrayType)]
    if how == "none" or not arrays:
        return df
    if how == "product":
        return reduce(lambda d, k: d.withColumn(k, F.explode(k)), arrays, df)
    zipped = df.withColumn("__z", F.explode(F.arrays_zip(*arrays)))
    return reduce(lambda d, k: d.withColumn(k, F.col(f"__z.{k}")), arrays, zipped).drop("__z")


def aggregate(df: DataFrame, aggregations: list[Aggregation]) -> list[DataFrame]:
    """A table per different way of grouping, in the order they are asked for, each with all its aggregates.

    Aggregations that group alike share one pass and one shuffle, and combine before it.  Nulls are left out of values.
    """
    shared: dict[tuple, list[Aggregation]] = {}
    for a in aggregations:
        shared.setdefault((tuple(a.groupby), a.explode), []).append(a)
    return [exploded(df, list(keys), how).groupBy(*keys).agg(*[c for a in same for c in a.columns()]) for (keys, how), same in shared.items()]


def grouping_sets(df: DataFrame, sets: list[list[str]], *aggs: Column) -> DataFrame:
    """All groupings in one table, with nulls for the keys a grouping lacks, and ``grouping_id``."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggs, F.grouping_id().alias("grouping_id"))


def cube(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """All subsets of the keys as groupings, with ``grouping_id``."""
    return df.cube(*keys).agg(*aggs, F.grouping_id().alias("grouping_id"))


def rollup(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """The keys, the keys without the last, and so on, as groupings, with ``grouping_id``."""
    return df.rollup(*keys).agg(*aggs, F.grouping_id().alias("grouping_id"))


# ---- confusion


def confusion_matrix(df: DataFrame, reference: str, prediction: str, labels: list, count: str | None = None, ratios: bool = True) -> DataFrame:
    """A row per label of truth, ``p_<label>`` per predicted one, zero-filled; ``total`` and ``recall``, and the rows ``Total`` and,
    with ``ratios``, ``Precision``.

    The labels are given, so that the pivot needs no pass to find them; other labels are left out.
    """
    n = F.sum(count) if count else F.count("*")
    # combined before the pivot: what is pivoted is a row per pair of labels
    pairs = df.where(F.col(reference).isin(labels) & F.col(prediction).isin(labels)).groupBy(reference, prediction).agg(n.cast("double").alias("n"))
    every = df.sparkSession.createDataFrame([(x,) for x in labels], T.StructType([T.StructField(reference, df.schema[reference].dataType)]))
    cells = [F.coalesce(F.sum(F.when(F.col(prediction) == x, F.col("n"))), F.lit(0.0)).alias(f"p_{x}") for x in labels]
    matrix = every.join(pairs, reference, "left").groupBy(reference).agg(*cells)
    own = reduce(lambda a, x: F.when(F.col(reference) == x, F.col(f"p_{x}")).otherwise(a), labels, F.lit(0.0))
    body = matrix.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"p_{x}") for x in labels]))
    if ratios:
        body = body.withColumn("recall", F.when(F.col("total") > 0, own / F.col("total")))
    body = body.withColumn(reference, F.col(reference).cast("string"))
    total = body.agg(*[F.sum(c).alias(c) for c in [*[f"p_{x}" for x in labels], "total"]]).select(F.lit("Total").alias(reference), "*")
    out = body.unionByName(total, allowMissingColumns=True)
    if ratios:
        hits = [F.sum(F.when(F.col(reference) == str(x), F.col(f"p_{x}"))) for x in labels]
        precision = body.agg(*[F.try_divide(h, F.sum(f"p_{x}")).alias(f"p_{x}") for h, x in zip(hits, labels, strict=True)]).select(F.lit("Precision").alias(reference), "*")
        out = out.unionByName(precision, allowMissingColumns=True)
    return out


def top_confusions(df: DataFrame, reference: str, prediction: str, k: int = 5, count: str | None = None) -> DataFrame:
    """``(reference, rank, prediction, n)``: of each truth the ``k`` commonest wrong predictions."""
    n = F.sum(count) if count else F.count("*")
    wrong = df.where(F.col(reference) != F.col(prediction)).groupBy(reference, prediction).agg(n.alias("n"))
    rank = F.row_number().over(Window.partitionBy(reference).orderBy(F.desc("n"), prediction))
    return wrong.where("n > 0").withColumn("rank", rank).where(F.col("rank") <= k).select(reference, "rank", prediction, "n")


def confusion_example_rows(df: DataFrame, reference: str, prediction: str, data: str) -> DataFrame:
    """``(key, example)`` by ``<reference>-<prediction>``: a row per example, repeats included, so that no group is gathered."""
    key = F.concat_ws("-", F.col(reference).cast("string"), F.col(prediction).cast("string"))
    return df.select(key.alias("key"), F.explode(data).alias("example") if isinstance(df.schema[data].dataType, T.ArrayType) else F.col(data).alias("example"))


def confusion_examples(df: DataFrame, reference: str, prediction: str, data: str) -> DataFrame:
    """``(key, examples)``: all examples of each key, in order; for large groups use :func:`confusion_example_rows`.  A null is no example."""
    rows = confusion_example_rows(df, reference, prediction, data)
    return rows.groupBy("key").agg(F.array_sort(F.collect_list("example")).alias("examples"))


# ---- frequencies and merges


def top_frequent(df: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` commonest values; ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def repeated_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def sum_maps(df: DataFrame, counts: str, by: list[str] = ()) -> DataFrame:
    """Key-wise sums of a map column, per group: ``(*by, key, value)``."""
    return df.select(*by, F.explode(counts)).groupBy(*by, "key").agg(F.sum("value").alias("value"))


def merge_maps(df: DataFrame, column: str, order: str, by: list[str] = ()) -> DataFrame:
    """Key-wise the value of the last row in ``order``: ``(*by, key, value)``."""
    return df.select(*by, order, F.explode(column)).groupBy(*by, "key").agg(F.max_by("value", order).alias("value"))


def merge_set_maps(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Key-wise unions of a map of arrays: ``(*by, key, values)``."""
    flat = df.select(*by, F.explode(column)).select(*by, "key", F.explode("value").alias("x"))
    return flat.groupBy(*by, "key").agg(F.array_sort(F.collect_set("x")).alias("values"))


def merge_list_maps(df: DataFrame, column: str, order: str, by: list[str] = ()) -> DataFrame:
    """Key-wise the lists of a map of arrays one after the other, in ``order``, repeats kept: ``(*by, key, values)``."""
    flat = df.select(*by, order, F.explode(column)).where("value is not null")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v"))))
    return flat.groupBy(*by, "key").agg(parts.alias("p")).select(*by, "key", F.flatten(F.transform("p", lambda x: x["v"])).alias("values"))


def groups(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(key, first, values)``: the values of each key in ``order``; ``first`` is the least order, to sort groups by first occurrence."""
    pairs = F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    grouped = df.groupBy(key).agg(F.min(order).alias("first"), F.array_sort(pairs).alias("p"))
    return grouped.select(key, "first", F.transform("p", lambda p: p["v"]).alias("values"))


def first_occurrences(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A row per key: the one with the least ``order``.  Combines before the shuffle, unlike a ranking window."""
    rest = [c for c in df.columns if c not in keys and c != order]
    least = F.min(F.struct(order, *rest)).alias("__r")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in [order, *rest]]).select(*df.columns)


def longest_only(df: DataFrame, column: str) -> DataFrame:
    """Strings that are not contained, as whole words, in a longer one.

    Candidates meet through the first word of the shorter string, so there is no product of all strings with all.
    """
    s = df.select(F.col(column).alias("s")).where("s is not null").distinct()
    words = s.select("s", F.explode(F.array_distinct(F.split("s", r"\s+"))).alias("w"))
    short = s.select(F.col("s").alias("t"), F.split("s", r"\s+")[0].alias("w"))
    inside = F.concat(F.lit(" "), F.col("s"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("t"), F.lit(" "))) & (F.char_length("s") > F.char_length("t"))
    covered = short.join(words, "w").where(inside).select("t").distinct()
    return s.join(covered, F.col("s") == F.col("t"), "left_anti").withColumnRenamed("s", column)
