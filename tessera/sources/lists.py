"""Lists kept in a table ``(list_key, idx, value)``: positional reads and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def element(t: DataFrame, key: str, index: int) -> DataFrame:
    """The element at an index; negative ones count from the end."""
    rows = t.where(F.col("list_key") == key)
    if index >= 0:
        return rows.where(F.col("idx") == index)
    return rows.orderBy(F.desc("idx")).limit(-index).orderBy("idx").limit(1) if -index <= rows.count() else rows.limit(0)


def append(t: DataFrame, items: DataFrame, order: str) -> DataFrame:
    """``items`` ``(list_key, <order>, value)`` at the ends of their lists."""
    size = t.groupBy("list_key").agg((F.max("idx") + 1).alias("__n"))
    pos = F.row_number().over(Window.partitionBy("list_key").orderBy(order)) - 1
    new = items.withColumn("__p", pos).join(size, "list_key", "left").select("list_key", (F.coalesce("__n", F.lit(0)) + F.col("__p")).cast(t.schema["idx"].dataType).alias("idx"), "value")
    return t.unionByName(new)


def insert(t: DataFrame, key: str, index: int, value) -> DataFrame:
    own = F.col("list_key") == key
    moved = t.withColumn("idx", F.when(own & (F.col("idx") >= index), F.col("idx") + 1).otherwise(F.col("idx")))
    return moved.unionByName(t.sparkSession.createDataFrame([(key, index, value)], t.schema))


def remove(t: DataFrame, key: str, index: int) -> tuple[DataFrame, DataFrame]:
    """The table without the element, and the element."""
    own = F.col("list_key") == key
    gone = element(t, key, index)
    if index < 0:
        at = gone.first()
        if at is None:
            return t, gone
        index = at["idx"]
    rest = t.where(~(own & (F.col("idx") == index)))
    return rest.withColumn("idx", F.when(own & (F.col("idx") > index), F.col("idx") - 1).otherwise(F.col("idx"))), gone


def index_of(t: DataFrame, value: Column, start: int = 0, stop: int | None = None) -> DataFrame:
    """``(list_key, idx)``: the first position of a value within a range."""
    rows = t.where((F.col("value") == value) & (F.col("idx") >= start))
    if stop is not None:
        rows = rows.where(F.col("idx") < stop)
    return rows.groupBy("list_key").agg(F.min("idx").alias("idx"))


def count_of(t: DataFrame, value: Column) -> DataFrame:
    return t.where(F.col("value") == value).groupBy("list_key").agg(F.count("*").alias("n"))


def sort(t: DataFrame, by: Column | None = None, reverse: bool = False) -> DataFrame:
    """Lists sorted; equal elements keep their order."""
    by = F.col("value") if by is None else by
    w = Window.partitionBy("list_key").orderBy(by.desc() if reverse else by.asc(), "idx")
    return t.withColumn("idx", (F.row_number().over(w) - 1).cast(t.schema["idx"].dataType))


def reverse(t: DataFrame) -> DataFrame:
    return t.withColumn("idx", F.max("idx").over(Window.partitionBy("list_key")) - F.col("idx"))
