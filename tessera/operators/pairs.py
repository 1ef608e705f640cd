"""Pairs of rows: joins on values, ordered products, greedy alignment, fuzzy lookup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import edit_similarity, normalized_edit_distance


def join_by_value(a: DataFrame, b: DataFrame, keep_unmatched: bool = False, unique: bool = True) -> DataFrame:
    """``(key_a, key_b)`` of two ``(key, value)`` tables with equal values.  With ``unique`` a value that ``b`` repeats is an error."""
    if unique and b.groupBy("value").count().where("count > 1").head(1):
        raise ValueError("a value has several keys")
    right = b.select(F.col("key").alias("key_b"), "value")
    return a.select(F.col("key").alias("key_a"), "value").join(right, "value", "left" if keep_unmatched else "inner").select("key_a", "key_b")


def ordered_pairs(df: DataFrame, value: str, by: list[str], both_ways: bool = False, with_self: bool = False) -> DataFrame:
    """``(*by, a, b)``: pairs of a group's values with ``a`` before ``b`` (or all).  The result is quadratic in a group by nature:
    use it on groups that are small by their meaning."""
    w = Window.partitionBy(*by).orderBy(value)
    n = df.select(*by, F.col(value).alias("v"), F.row_number().over(w).alias("i"))
    x, y = n.select(*by, F.col("v").alias("a"), F.col("i").alias("i")), n.select(*by, F.col("v").alias("b"), F.col("i").alias("j"))
    i, j = F.col("i"), F.col("j")
    test = (F.lit(True) if with_self else i != j) if both_ways else (i <= j if with_self else i < j)
    return x.join(y, list(by)).where(test).select(*by, "a", "b")


def best_per_source(pairs: DataFrame, source: str, target: str, score: str, descending: bool = True, ties: bool = True) -> DataFrame:
    """The best scored pair of each source; all of equal score with ``ties``, else that of the least target."""
    order = F.desc(score) if descending else F.asc(score)
    rank = F.rank() if ties else F.row_number()
    w = Window.partitionBy(source).orderBy(order, *([] if ties else [F.col(target)]))
    return pairs.withColumn("__r", rank.over(w)).where(F.col("__r") == 1).drop("__r")


def greedy_alignment(pairs: DataFrame, source: str, target: str, score: str, block: list[str], descending: bool = True, quota: int = 1) -> DataFrame:
    """Pairs taken from the best down, each source once and each target ``quota`` times at most; ties by source, then target.

    Greedy choice is sequential; blocks, of which pairs are independent, are aligned side by side.
    """
    schema = pairs.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, source, target], ascending=[not descending, True, True], kind="stable")
        used, left, keep = set(), {}, []
        for s, t in zip(pdf[source], pdf[target], strict=True):
            ok = s not in used and left.setdefault(t, quota) > 0
            keep.append(ok)
            if ok:
                used.add(s)
                left[t] -= 1
        return pdf[keep]

    return pairs.groupBy(*block).applyInPandas(run, schema)


def edit_distance_join(a: DataFrame, b: DataFrame, left: str, right: str, least: float, first_letter: bool = False) -> DataFrame:
    """``a`` and ``b`` rows whose strings are similar by at least ``least`` (1 - distance / longer length).

    Candidates meet in blocks of length bands, which loses no pair (the lengths of a pair differ by at most ``1 - least`` of the
    longer); with ``first_letter``, which is for data where that is known to hold, only strings of the same first letter meet.
    """
    import math

    # bands of lengths growing by 1 / least: a partner is in the same band or the next
    step = math.log(1 / least) if least < 1 else math.log(2)
    band = lambda c: F.floor(F.log(F.greatest(F.char_length(c), F.lit(1)).cast("double")) / step + 1e-9).cast("int")
    letter = lambda c: [F.lower(F.substring(c, 1, 1)).alias("__f")] if first_letter else []
    x = a.withColumn("__b", band(F.col(left))).select("*", *letter(F.col(left)))
    y = b.withColumn("__b", F.explode(F.array(band(F.col(right)) - 1, band(F.col(right)), band(F.col(right)) + 1))).select("*", *letter(F.col(right)))
    n = F.greatest(F.char_length(left), F.char_length(right))
    most = F.floor((1 - least) * n + 1e-9).cast("int")
    close = (F.abs(F.char_length(left) - F.char_length(right)) <= most) & (F.levenshtein(F.col(left), F.col(right)) <= most)
    met = x.join(y, ["__b", *(["__f"] if first_letter else [])]).where(close)
    return met.withColumn("similarity", 1 - normalized_edit_distance(F.col(left), F.col(right))).drop("__b", "__f")


def top_similar(values: DataFrame, column: str, query: str, k: int, above: float | None = None) -> DataFrame:
    """The ``k`` values most similar to a string; ties by the greater value."""
    scored = values.withColumn("score", edit_similarity(F.col(column), F.lit(query)))
    if above is not None:
        scored = scored.where(F.col("score") > above)
    return scored.orderBy(F.desc("score"), F.desc(column)).limit(k)


def lookup(queries: DataFrame, table: DataFrame, query: str, key: str, value: str, least: float = 0.5) -> DataFrame:
    """``(query, key, value, score)``: the row with the equal key, else that with the most similar one (ties by key)."""
    exact = queries.join(table.select(F.col(key).alias(query), F.col(key).alias("key"), F.col(value).alias("value")), query).select(query, "key", "value", F.lit(1.0).alias("score"))
    rest = queries.join(table.select(F.col(key).alias(query)), query, "left_anti")
    near = edit_distance_join(rest.select(query), table.select(F.col(key).alias("key"), F.col(value).alias("value")), query, "key", least, first_letter=False)
    w = Window.partitionBy(query).orderBy(F.desc("similarity"), "key")
    best = near.withColumn("r", F.row_number().over(w)).where("r = 1").select(query, "key", "value", F.col("similarity").alias("score"))
    return exact.unionByName(best)


def theta_join(a: DataFrame, b: DataFrame, left: str, op: str, right: str, also: Column | None = None, ranges: int = 64) -> DataFrame:
    """Rows of ``a`` and ``b`` with ``left op right`` (``<``, ``<=``, ``>`` or ``>=``) and ``also``; null meets nothing.

    The values of ``right`` are cut into ranges.  A row of ``a`` meets the range its value lies in and those beyond it, so that the
    rows meet in a join by range, which any number of tasks share, and not in a nested loop.  The result itself may be quadratic.
    """
    cuts = sorted(set(b.where(F.col(right).isNotNull()).approxQuantile(right, [k / ranges for k in range(1, ranges)], 0.01)))
    place = lambda c: F.aggregate(F.array(*map(F.lit, cuts)).cast("array<double>"), F.lit(0), lambda n, x: n + (F.col(c).cast("double") >= x).cast("int"))
    own = place(left)
    span = F.sequence(own, F.lit(len(cuts))) if op in ("<", "<=") else F.sequence(F.lit(0), own)
    test = {"<": F.col(left) < F.col(right), "<=": F.col(left) <= F.col(right), ">": F.col(left) > F.col(right), ">=": F.col(left) >= F.col(right)}[op]
    x = a.where(F.col(left).isNotNull()).withColumn("__range", F.explode(span))
    y = b.where(F.col(right).isNotNull()).withColumn("__range", place(right))
    met = x.join(y, "__range").where(test if also is None else test & also)
    return met.drop("__range")


def product(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """All pairs of rows with equal keys."""
    return a.join(b, on)


def where_conflict(a: Column, b: Column, groups: list[list[str]]) -> Column:
    """Two strings hold different words of one group of words that exclude each other."""
    from tessera.functions.text import has_token

    out = F.lit(False)
    for words in groups:
        has = lambda s, ws=words: F.filter(F.array(*[F.when(has_token(s, [w]), w) for w in ws]), lambda x: x.isNotNull())
        out = out | ((F.size(has(a)) > 0) & (F.size(has(b)) > 0) & ~F.arrays_overlap(has(a), has(b)))
    return out
