"""Sequence algorithms on array columns.  One pass over each array in the JVM where a fold can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def prefix_sums(a: Column) -> Column:
    """Running sums; nulls count as 0."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + F.coalesce(x.cast("double"), F.lit(0.0))).alias("s"), F.concat(acc["out"], F.array(acc["s"] + F.coalesce(x.cast("double"), F.lit(0.0)))).alias("out")), lambda acc: acc["out"])


def max_subarray_sum(a: Column) -> Column:
    """``struct<total, start, stop>`` of the non-empty stretch with the greatest sum (the first of equals); null for an empty array."""
    fields = lambda best, bs, be, cur, cs, i: F.struct(best.alias("best"), bs.alias("bs"), be.alias("be"), cur.alias("cur"), cs.alias("cs"), i.alias("i"))
    none = F.lit(None).cast("double")
    start = fields(none, F.lit(0), F.lit(0), none, F.lit(0), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        x = x.cast("double")
        fresh = acc["cur"].isNull() | (acc["cur"] < 0)
        cur, cs = F.when(fresh, x).otherwise(acc["cur"] + x), F.when(fresh, acc["i"]).otherwise(acc["cs"])
        better = acc["best"].isNull() | (cur > acc["best"])
        return fields(
            F.when(better, cur).otherwise(acc["best"]), F.when(better, cs).otherwise(acc["bs"]), F.when(better, acc["i"] + 1).otherwise(acc["be"]), cur, cs, acc["i"] + 1
        )

    return F.aggregate(a, start, step, lambda acc: F.when(acc["best"].isNotNull(), F.struct(acc["best"].alias("total"), acc["bs"].alias("start"), acc["be"].alias("stop"))))


def max_subarray_product(a: Column) -> Column:
    """The greatest product of a non-empty stretch; null for an empty array."""
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("best"), none.alias("hi"), none.alias("lo"))

    def step(acc: Column, x: Column) -> Column:
        x = x.cast("double")
        hi, lo = F.greatest(x, acc["hi"] * x, acc["lo"] * x), F.least(x, acc["hi"] * x, acc["lo"] * x)
        return F.struct(F.greatest(acc["best"], hi).alias("best"), hi.alias("hi"), lo.alias("lo"))

    return F.aggregate(a, start, step, lambda acc: acc["best"])


def longest_increasing_run(a: Column) -> Column:
    """``struct<length, start>`` of the longest strictly increasing stretch (the first of equals)."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("n"), none.alias("last"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        x = x.cast("double")
        n = F.when(x > acc["last"], acc["n"] + 1).otherwise(1)
        return F.struct(
            F.greatest(acc["best"], n).alias("best"), F.when(n > acc["best"], acc["i"] - n + 1).otherwise(acc["at"]).alias("at"), n.alias("n"), x.alias("last"), (acc["i"] + 1).alias("i")
        )

    return F.aggregate(a, start, step, lambda acc: F.struct(acc["best"].alias("length"), acc["at"].alias("start")))


def product_except_self(a: Column) -> Column:
    """For each element the product of all others; exact with zeros, unlike a quotient of the whole product."""
    zeros = F.size(F.filter(a, lambda x: x == 0))
    rest = F.aggregate(F.filter(a, lambda x: x != 0), F.lit(1.0), lambda p, x: p * x.cast("double"))
    return F.transform(a, lambda x: F.when(x == 0, F.when(zeros == 1, rest).otherwise(0.0)).otherwise(F.when(zeros > 0, 0.0).otherwise(rest / x)))


def equilibrium_indexes(a: Column) -> Column:
    """Positions (from 0) with equal sums on both sides."""
    sums = prefix_sums(a)
    total = F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0.0))
    return F.filter(F.transform(a, lambda x, i: F.when(F.element_at(sums, i + 1) - x == total - F.element_at(sums, i + 1), i)), lambda i: i.isNotNull())


def subarrays_with_sum(a: Column, k: float) -> Column:
    """All ``struct<start, stop>`` whose elements add up to ``k``."""
    sums = F.concat(F.array(F.lit(0.0)), prefix_sums(a))
    pairs = F.flatten(F.transform(sums, lambda x, i: F.transform(F.filter(F.transform(sums, lambda y, j: F.when((j > i) & (y - x == k), j)), lambda j: j.isNotNull()), lambda j: F.struct(i.alias("start"), j.alias("stop")))))
    return pairs


def has_subarray_divisible_by(a: Column, k: int, least: int = 2) -> Column:
    """Some stretch of at least ``least`` elements adds up to a multiple of ``k``."""
    sums = F.transform(F.concat(F.array(F.lit(0.0)), prefix_sums(a)), lambda s: F.pmod(s.cast("bigint"), F.lit(k)))
    return F.exists(F.transform(sums, lambda x, i: F.exists(F.slice(sums, i + 1 + least, F.greatest(F.size(sums) - i - least, F.lit(0))), lambda y: x == y)), lambda b: b)


def next_larger(a: Column) -> Column:
    """For each position that of the next strictly larger element, or -1."""
    n = F.size(a)
    return F.transform(
        a, lambda x, i: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: (j > i) & (F.element_at(a, j + 1) > x))), F.lit(-1))
    )


def padded(a: Column, size: int) -> Column:
    """At least ``size`` long, the last element repeated."""
    return F.concat(a, F.array_repeat(F.element_at(a, -1), F.greatest(F.lit(0), F.lit(size) - F.size(a))))


def position(a: Column, x: Column) -> Column:
    """The first position (from 0) of a value, or -1."""
    return F.coalesce(F.array_position(a, x) - 1, F.lit(-1))


def last_non_null(a: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(F.transform(a, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())), F.lit(-1))


def halves(a: Column) -> Column:
    middle = F.floor(F.size(a) / 2).cast("int")
    return F.struct(F.slice(a, F.lit(1), middle).alias("first"), F.slice(a, middle + 1, F.size(a) - middle).alias("second"))


def largest_concatenation(a: Column) -> Column:
    """Strings in the order whose concatenation is greatest, joined."""
    return F.array_join(F.array_sort(a, lambda x, y: F.when(F.concat(x, y) > F.concat(y, x), -1).when(F.concat(x, y) < F.concat(y, x), 1).otherwise(0)), "")


def anagram_key(s: Column) -> Column:
    return F.array_join(F.array_sort(F.split(s, "")), "")


def distinct(a: Column) -> Column:
    """Without repetitions, in order of first occurrence."""
    return F.array_distinct(a)


def all_equal(a: Column, value: Column | None = None) -> Column:
    return F.forall(a, lambda x: x.eqNullSafe(F.element_at(a, 1) if value is None else value))


# ---- what a fold cannot express: vectorised functions


def _pairs(f: Callable, out: T.DataType) -> Callable[[Column, Column], Column]:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    return lambda a, b: F.pandas_udf(run, out)(a, b)


def _lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _common_run(a: list, b: list) -> list:
    best, stop, row = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else 0
            if row[j] > best:
                best, stop = row[j], i
    return a[stop - best : stop]


lcs_length = _pairs(_lcs, T.LongType())
longest_common_run = _pairs(_common_run, T.ArrayType(T.StringType()))


def knapsack(capacity: int, weights: Column, values: Column) -> Column:
    """The greatest value of items within the capacity, each taken once at most."""

    def best(w: list, v: list) -> float:
        top = [0.0] * (capacity + 1)
        for wi, vi in zip(w, v, strict=True):
            wi = int(wi)
            for c in range(capacity, wi - 1, -1):
                top[c] = max(top[c], top[c - wi] + float(vi))
        return top[capacity]

    return _pairs(best, T.DoubleType())(weights, values)


def fewest_workers(capacities: Column, load: Column) -> Column:
    """The least number of workers, any number of each capacity, that add up to the load exactly; -1 if none do."""

    def run(c: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for each, total in zip(c, n, strict=True):
            need = [0] + [1 << 30] * int(total)
            for x in range(1, int(total) + 1):
                need[x] = min([need[x - int(k)] + 1 for k in each if 0 < k <= x], default=1 << 30)
            out.append(need[-1] if need[-1] < 1 << 30 else -1)
        return pd.Series(out, dtype="int64")

    return F.pandas_udf(run, T.LongType())(capacities, load)


def balanced(s: Column, left: str = "(", right: str = ")", remove: bool = True) -> Column:
    """Brackets made to match, by removing as few as possible or by adding as few as possible."""

    def fix(text: str) -> str:
        out, opened = [], []
        for ch in text:
            if ch == left:
                opened.append(len(out))
            elif ch == right:
                if opened:
                    opened.pop()
                elif remove:
                    continue
                else:
                    out.append(left)
            out.append(ch)
        if remove:
            drop = set(opened)
            return "".join(c for i, c in enumerate(out) if i not in drop)
        return "".join(out) + right * len(opened)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fix(t))

    return F.pandas_udf(run, T.StringType())(s)


def next_permutation(a: Column) -> Column:
    """The next arrangement in lexicographic order; the first after the last."""

    def step(x: list) -> list:
        i = len(x) - 2
        while i >= 0 and x[i] >= x[i + 1]:
            i -= 1
        if i >= 0:
            j = max(k for k in range(i + 1, len(x)) if x[k] > x[i])
            x[i], x[j] = x[j], x[i]
        return x[: i + 1] + x[i + 1 :][::-1]

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else step(list(r)) for r in rows], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.LongType()))(a)
