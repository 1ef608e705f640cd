"""Unions, zips, explosions and chunks of ordered rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.aggregate import exploded


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_distinct(tables: list[DataFrame], order: str, keys: list[str] | None = None) -> DataFrame:
    """The first occurrence of each row (or key) over the tables in turn, each in ``order``."""
    numbered = union_all(*[t.withColumn("__t", F.lit(i)) for i, t in enumerate(tables)])
    keys = keys or [c for c in tables[0].columns if c != order]
    rest = [c for c in numbered.columns if c not in (*keys, "__t", order)]
    least = numbered.groupBy(*keys).agg(F.min(F.struct("__t", order, *rest)).alias("__r"))
    return least.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in [order, *rest]])


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame, counted: bool = False) -> DataFrame:
    return a.exceptAll(b) if counted else a.subtract(b)


def zip_rows(tables: list[DataFrame], pos: str, longest: bool = False, fill_previous: bool = True) -> DataFrame:
    """Rows of the tables with equal ``pos`` side by side; with ``longest`` missing ones are filled by the last before them."""
    out = reduce(lambda a, b: a.join(b, pos, "full" if longest else "inner"), tables)
    if longest and fill_previous:
        w = Window.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in out.columns if c != pos})
    return out


def explode_columns(df: DataFrame, columns: list[str], how: str = "product") -> DataFrame:
    """A row per combination of elements (``product``), per position (``zip``) or per position with the last element repeated
    (``longest``)."""
    if how != "longest":
        return exploded(df, columns, how)
    size = F.greatest(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    filled = {c: F.concat(F.col(c), F.array_repeat(F.try_element_at(F.col(c), F.lit(-1)), size - F.size(c))) for c in columns}
    return exploded(df.withColumns(filled), columns, "zip")


def chunks(df: DataFrame, order: list[str], size: int, by: list[str] = ()) -> DataFrame:
    """``df`` with ``chunk``: runs of ``size`` rows."""
    from tessera.operators.windows import positions

    return positions(df, list(by), order, "chunk").withColumn("chunk", F.floor(F.col("chunk") / size).cast("bigint"))


def weighted_chunks(df: DataFrame, order: list[str], weight: str, capacity: float, by: list[str]) -> DataFrame:
    """``df`` with ``chunk``: a row opens a new chunk when it would take the weight above the capacity; one that is above it
    alone is a chunk of its own.  Each group is folded in order by one task."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, chunk, held = [], 0, 0.0
        for i, w in enumerate(pdf[weight].fillna(0).tolist()):
            if i and held + w > capacity:
                chunk, held = chunk + 1, 0.0
            held += w
            out.append(chunk)
        return pdf.assign(chunk=out)

    return df.groupBy(*by).applyInPandas(run, f"{fields}, chunk bigint")


def splits(df: DataFrame, order: list[str], n: int, by: list[str] = ()) -> DataFrame:
    """``df`` with ``split``: near-equal contiguous parts, larger ones first."""
    return df.withColumn("split", F.ntile(n).over(Window.partitionBy(*by).orderBy(*order)) - 1)


def part(df: DataFrame, order: list[str], n: int, k: int) -> DataFrame:
    """The k-th (from 0) of ``n`` contiguous parts."""
    return splits(df, order, n).where(F.col("split") == k).drop("split")


def distribute(df: DataFrame, weight: str, total: float, by: list[str], order: list[str] = (), cumulative: bool = False) -> DataFrame:
    """``df`` with ``share``: the total in proportion to the weights; running, and ending exactly at the total, with ``cumulative``."""
    whole = F.sum(weight).over(Window.partitionBy(*by))
    held = F.sum(weight).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) if cumulative else F.col(weight)
    return df.withColumn("share", F.try_divide(held * total, whole))


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, values, name, value)


def transposed(df: DataFrame, order: str) -> DataFrame:
    """One row with an array per column, in ``order`` (for tables known to be small)."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])))
    return df.agg(rows.alias("r")).select(*[F.col("r").getField(c).alias(c) for c in df.columns])


def unique_names(df: DataFrame, name: str, order: list[str], sep: str = "_") -> DataFrame:
    """Names made unique: the second and later ones get a number."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(sep), (n - 1).cast("string"))))


def overlay(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The row of the first table that has the key."""
    from tessera.operators.diff import latest

    ranked = union_all(*[t.withColumn("__p", F.lit(-i)) for i, t in enumerate(tables)])
    return latest(ranked, keys, ["__p"]).drop("__p").select(*tables[0].columns)


def table_function(f: Callable, schema: str):
    """A table function from one that gives the rows of its arguments as tuples."""

    class Rows:
        def eval(self, *args):
            yield from f(*args)

    return F.udtf(Rows, returnType=schema)


def apply_table_function(df: DataFrame, function, *columns: str) -> DataFrame:
    """Each row with the rows a table function makes of its columns (a lateral join); rows without any are dropped."""
    return df.lateralJoin(function(*[F.col(c).outer() for c in columns]))


def fold_column(c: Column) -> Column:
    """Array of arrays to array."""
    return F.flatten(c)
