"""Differences between two copies of a dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], left_name: str = "left", right_name: str = "right") -> DataFrame:
    """``(*keys, diff, left_value, right_value)``: one row per key missing in a copy and per field that differs.

    Both copies are unpivoted to key-field-value cells, one more cell per row standing for its presence.  The cells are
    counted by copy with opposite signs; what cancels is equal and is dropped by one aggregation, which combines before it
    shuffles, so a key that makes up a third of a copy costs one row per task.

    ``diff`` is ``missing_in_<name>``, the name of a field, or ``count`` where the copies hold a key a different number of
    times (as multisets; the value columns then hold the counts).  Null equals null and differs from any value, in keys
    too.  Values are compared as strings.  Empty copies and other columns, whatever their names, are fine; the output names
    ``diff``, ``left_value`` and ``right_value`` must not be among the keys.
    """
    if clash := {"diff", "left_value", "right_value"} & set(keys):
        raise ValueError(f"key names are taken: {sorted(clash)}")
    names = [f"__k{i}" for i in range(len(keys))]
    one = lambda df, side: df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(f).cast("string").alias(f"__f{i}") for i, f in enumerate(fields)], F.lit(side).alias("side"))
    return _differences(one(left, 0).unionByName(one(right, 1)), keys, fields, left_name, right_name)


def compare_sides(df: DataFrame, right: Column, keys: list[str], fields: list[str], left_name: str = "left", right_name: str = "right") -> DataFrame:
    """:func:`compare_copies` of two copies that stand in one table, read once: rows where ``right`` is true are the right copy, where
    it is false the left one, and where it is null neither."""
    if clash := {"diff", "left_value", "right_value"} & set(keys):
        raise ValueError(f"key names are taken: {sorted(clash)}")
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    rows = df.select(*names, *[F.col(f).cast("string").alias(f"__f{i}") for i, f in enumerate(fields)], right.cast("int").alias("side")).where("side is not null")
    return _differences(rows, keys, fields, left_name, right_name)


def _differences(rows: DataFrame, keys: list[str], fields: list[str], left_name: str, right_name: str) -> DataFrame:
    names = [f"__k{i}" for i in range(len(keys))]
    cell = [F.struct(F.lit(-1).alias("field"), F.lit(None).cast("string").alias("value"))]
    cell += [F.struct(F.lit(i).alias("field"), F.col(f"__f{i}").alias("value")) for i in range(len(fields))]
    cells = rows.select(*names, F.inline(F.array(*cell)), "side")

    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    open_cells = cells.groupBy(*names, "field", "value").agg(count(0).alias("l"), count(1).alias("r")).where("l <> r")
    # the presence cell of a key that is missing, or that the copies repeat differently, speaks for all its fields
    presence = F.max(F.when(F.col("field") == -1, F.struct("l", "r")))
    value = lambda n: F.max(F.when(F.col(n) > 0, F.col("value")))
    by_field = open_cells.groupBy(*names, "field").agg(presence.alias("p"), value("l").alias("lv"), value("r").alias("rv"))
    whole = by_field.groupBy(*names).agg(F.max("p").alias("p"), F.collect_list(F.when(F.col("field") >= 0, F.struct("field", "lv", "rv"))).alias("cells"))
    lacks = F.when(F.col("p.r") == 0, f"missing_in_{right_name}").when(F.col("p.l") == 0, f"missing_in_{left_name}").otherwise("count")
    counts = [F.when(lacks == "count", F.col(f"p.{s}").cast("string")) for s in "lr"]
    found = F.when(F.col("p").isNotNull(), F.array(F.struct(lacks.alias("diff"), counts[0].alias("left_value"), counts[1].alias("right_value")))).otherwise(
        F.transform("cells", lambda c: F.struct(_named(c["field"], fields).alias("diff"), c["lv"].alias("left_value"), c["rv"].alias("right_value")))
    )
    return whole.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.inline(found))


def _named(index: Column, names: list[str]) -> Column:
    if not names:
        return F.lit(None).cast("string")
    return reduce(lambda out, i: out.when(index == i, names[i]), range(1, len(names)), F.when(index == 0, names[0]))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key; null order values come first, ties fall to the other columns' order.

    Combines before it shuffles, unlike a ranking window: a hot key costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[F.col(c) for c in order + rest])
    return df.groupBy(*keys).agg(F.max(row).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in order + rest])
