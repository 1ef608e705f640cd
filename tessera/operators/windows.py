"""Ordered rows: changes, rolling statistics, runs, and neighbours in time.

Every function takes the columns that partition the rows.  Without any, one task gets all rows: give a partition where there
is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def pct_change(df: DataFrame, columns: list[str], by: list[str], order: list[str], percent: bool = False, suffix: str = "_pct") -> DataFrame:
    """Row-over-row relative change; null for the first row and after a 0."""
    w = _ordered(by, order)
    for c in columns:
        change = F.try_divide(F.col(c), F.lag(c).over(w)) - 1
        df = df.withColumn(f"{c}{suffix}", change * 100 if percent else change)
    return df


def first_last_change(df: DataFrame, columns: list[str], by: list[str], order: str, percent: bool = False) -> DataFrame:
    """Relative change from the first to the last row of each partition, without sorting it."""
    change = lambda c: F.try_divide(F.max_by(c, order), F.min_by(c, order)) - 1
    return df.groupBy(*by).agg(*[(change(c) * 100 if percent else change(c)).alias(f"{c}_change") for c in columns])


#: Rolling statistics; the median is exact and keeps a window's rows.
STATS = {
    "min": lambda c, w: F.min(c).over(w), "max": lambda c, w: F.max(c).over(w), "mean": lambda c, w: F.avg(c).over(w), "std": lambda c, w: F.stddev_samp(c).over(w),
    "sum": lambda c, w: F.sum(c).over(w), "median": lambda c, w: F.percentile(c, 0.5).over(w),
}


def rolling(df: DataFrame, columns: list[str], sizes: list[int], by: list[str], order: list[str], stats: tuple[str, ...] = ("min", "max", "median", "mean", "std"), partial: bool = False) -> DataFrame:
    """``{column}_{stat}_{size}`` over the last ``size`` rows; null until the window is full, unless ``partial``."""
    w = _ordered(by, order)
    out = df.withColumn("__n", F.row_number().over(w))
    added = {}
    for c in columns:
        for size in sizes:
            frame = w.rowsBetween(-(size - 1), 0)
            for s in stats:
                value = STATS[s](c, frame)
                added[f"{c}_{s}_{size}"] = value if partial else F.when(F.col("__n") >= size, value)
    return out.withColumns(added).drop("__n")


def moving_average(df: DataFrame, column: str, size: int, by: list[str], order: list[str]) -> DataFrame:
    return rolling(df, [column], [size], by, order, ("mean",), partial=True)


def shift(df: DataFrame, columns: list[str], n: int, by: list[str], order: list[str]) -> DataFrame:
    """Columns moved down by ``n`` rows (up for negative ``n``)."""
    w = _ordered(by, order)
    return df.withColumns({c: F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w) for c in columns})


def windows(df: DataFrame, column: str, past: int, future: int, by: list[str], order: list[str], before_past: int = 0, step: int = 1, partial: bool = False) -> DataFrame:
    """``(*by, pos, past, future, before_past)``: sliding windows as arrays; ``pos`` numbers the row a window's past ends with.

    Windows begin every ``step`` rows from the first full past; the future must be full, or not empty with ``partial``.
    """
    w = _ordered(by, order)
    listed = lambda a, b: F.collect_list(column).over(w.rowsBetween(a, b))
    out = df.select(
        *by,
        F.row_number().over(w).alias("pos"),
        listed(-(past - 1), 0).alias("past"),
        listed(1, future).alias("future"),
        (listed(-(past - 1) - before_past, -past) if before_past else F.array()).alias("before_past"),
    )
    enough = (F.size("future") > 0) if partial else (F.size("future") == future)
    return out.where((F.size("past") == past) & enough & (F.size("before_past") == before_past) & ((F.col("pos") - past - before_past) % step == 0))


def weekly_change(df: DataFrame, date: str, value: str, end: str, days_back: int, weeks: int = 1, by: list[str] = ()) -> DataFrame:
    """``(*by, week_end, first, last, change)`` of ranges of ``weeks`` weeks counted back from ``end``; empty ranges are left out."""
    ago = F.datediff(F.lit(end).cast("date"), F.col(date).cast("date"))
    rows = df.where((ago >= 0) & (ago < days_back)).withColumn("__k", F.floor(ago / (7 * weeks)).cast("int"))
    grouped = rows.groupBy(*by, "__k").agg(F.min_by(value, date).alias("first"), F.max_by(value, date).alias("last"))
    week_end = F.date_sub(F.lit(end).cast("date"), F.col("__k") * (7 * weeks))
    return grouped.select(*by, week_end.alias("week_end"), "first", "last", (F.try_divide("last", "first") - 1).alias("change"))


def next_larger(df: DataFrame, value: str, by: list[str], order: list[str], out: str = "steps_to_larger") -> DataFrame:
    """How many rows ahead the next strictly larger value stands; -1 if none does.  One pass with a stack per partition."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        values, steps, stack = pdf[value].tolist(), [-1] * len(pdf), []
        for i, v in enumerate(values):
            while stack and v > values[stack[-1]]:
                j = stack.pop()
                steps[j] = i - j
            stack.append(i)
        pdf[out] = steps
        return pdf

    return df.groupBy(*by).applyInPandas(run, f"{fields}, `{out}` bigint")


def records(df: DataFrame, value: str, by: list[str], order: list[str], backward: bool = True) -> DataFrame:
    """Rows above all that follow them (or, forward, all that precede them)."""
    w = _ordered(by, order)
    frame = w.rowsBetween(1, Window.unboundedFollowing) if backward else w.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__m", F.max(value).over(frame)).where(F.col("__m").isNull() | (F.col(value) > F.col("__m"))).drop("__m")


def side_max(df: DataFrame, value: str, pos: str, by: list[str], right: bool = True, out: str = "max_pos") -> DataFrame:
    """The position of the greatest value from here on (the last of equals), or up to here (the first of equals)."""
    w = _ordered(by, [pos])
    if right:
        return df.withColumn(out, F.max(F.struct(value, pos)).over(w.rowsBetween(0, Window.unboundedFollowing))[pos])
    best = F.max(F.struct(F.col(value), (-F.col(pos)).alias("p"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, -best["p"])


def longest_run(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """``(*by, length, start)``: the longest strictly increasing stretch of rows, the first of equals; ``start`` counts from 0."""
    w = _ordered(by, order)
    marked = df.select(*by, F.row_number().over(w).alias("__i"), (F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False))).alias("__up"))
    islands = marked.withColumn("__g", F.sum((~F.col("__up")).cast("int")).over(Window.partitionBy(*by).orderBy("__i")))
    runs = islands.groupBy(*by, "__g").agg(F.count("*").alias("__n"), (F.min("__i") - 1).alias("__s"))
    best = runs.groupBy(*by).agg(F.max(F.struct("__n", (-F.col("__s")).alias("__s"))).alias("__m"))
    return best.select(*by, F.col("__m.__n").alias("length"), (-F.col("__m.__s")).alias("start"))


def running(df: DataFrame, value: str, by: list[str], order: list[str], out: str = "running") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(_ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def positions(df: DataFrame, by: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """``df`` with each row's place, from 0, in the ``order`` of its group; nulls of ``by`` are a group.

    A ranking window would give a group to one task.  Rows are dealt by ranges of group and order instead, so that a group of a
    third of all rows lies in several ranges; a place is that within the range and the number of rows of the group in earlier
    ranges, of which there is one count per range.
    """
    from tessera.staging import parallelism, stage

    ranged = stage(df.repartitionByRange(parallelism(df.sparkSession), *by, *order).withColumn("__p", F.spark_partition_id()), "positions")
    counts = ranged.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "__p"]
    offset = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    local = ranged.withColumn("__l", F.row_number().over(Window.partitionBy("__p", *by).orderBy(*order)) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return local.join(offset, same).select(*df.columns, (F.col("__b") + F.col("__l")).alias(out))


def prefix_sums_2d(df: DataFrame, row: str, column: str, value: str, by: list[str] = (), out: str = "total") -> DataFrame:
    """The sum of all cells up to a cell's row and column, for a table of cells ``(row, column, value)``; a missing cell has no sum."""
    keys = [*by, "__m"]
    cells = df.withColumn("__m", F.lit(0)).groupBy(*keys, row, column).agg(F.sum(value).alias(value))
    # every column of every row, so that sums go on over missing cells; a row of a matrix is as wide as the matrix
    wide = cells.groupBy(*keys).agg(F.collect_set(column).alias("__c"))
    full = cells.select(*keys, row).distinct().join(wide, keys).select(*keys, row, F.explode("__c").alias(column))
    along, down = Window.partitionBy(*keys, row).orderBy(column), Window.partitionBy(*keys, column).orderBy(row)
    summed = full.join(cells, [*keys, row, column], "left").withColumn("__s", F.sum(F.coalesce(value, F.lit(0))).over(along))
    return summed.withColumn(out, F.sum("__s").over(down)).where(F.col(value).isNotNull()).drop("__s", "__m")


def global_running(df: DataFrame, value: str, order: str, out: str = "running", parts: int | None = None) -> DataFrame:
    """A running sum over all rows without a single task: range-partitioned prefix sums, shifted by the sums of earlier ranges."""
    from tessera.staging import parallelism, stage

    parts = parts or parallelism(df.sparkSession)
    ranged = stage(df.repartitionByRange(parts, order).withColumn("__p", F.spark_partition_id()), "running")
    totals = ranged.groupBy("__p").agg(F.sum(value).alias("__t"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = totals.select("__p", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__b"))
    local = F.sum(value).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__s", local).join(base, "__p").withColumn(out, F.col("__s") + F.col("__b")).drop("__p", "__s", "__b")


def local_extremes(df: DataFrame, value: str, by: list[str], order: list[str], largest: bool = True) -> DataFrame:
    """Rows above (or below) both neighbours; ends have one neighbour."""
    w = _ordered(by, order)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    v = F.col(value)
    test = (lambda x: v > x) if largest else (lambda x: v < x)
    return df.withColumn("__k", F.coalesce(test(a), F.lit(True)) & F.coalesce(test(b), F.lit(True))).where("__k").drop("__k")


def sessions(df: DataFrame, time: str, by: list[str], gap_seconds: int) -> DataFrame:
    """``(*by, start, end, n)``: rows no more than the gap apart belong together."""
    w = _ordered(by, [time])
    fresh = F.coalesce(F.unix_micros(F.col(time)) - F.unix_micros(F.lag(time).over(w)) > gap_seconds * 1_000_000, F.lit(True))
    numbered = df.withColumn("__f", fresh.cast("int")).withColumn("__s", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__s").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).drop("__s")


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], backward: bool = True) -> DataFrame:
    """``left`` with the values of ``right``'s last row at or before its time (or the first at or after it), in one shuffle."""
    flag = 1 if backward else 0
    both = left.select(*by, time, *[c for c in left.columns if c not in by and c != time], *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values], F.lit(flag).alias("__left"))
    other = right.select(*by, time, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in by and c != time], *[F.col(v).alias(f"__{v}") for v in values], F.lit(1 - flag).alias("__left"))
    rows = both.withColumn("__l", F.lit(True)).unionByName(other.withColumn("__l", F.lit(False)))
    w = Window.partitionBy(*by).orderBy(time, "__left")
    frame = w.rowsBetween(Window.unboundedPreceding, 0) if backward else w.rowsBetween(0, Window.unboundedFollowing)
    pick = F.last if backward else F.first
    state = pick(F.when(~F.col("__l"), F.struct(*[F.col(f"__{v}").alias(v) for v in values])), ignorenulls=True).over(frame)
    return rows.withColumn("__s", state).where("__l").select(*left.columns, *[F.col(f"__s.{v}").alias(v) for v in values])


def bins(value: Column, edges: list[float], labels: list[str] | None = None, right_closed: bool = False) -> Column:
    """The label of the bin of a number; open at both ends.  Default labels are the bins' lower edges, ``-inf`` first."""
    names = labels or ["-inf", *[f"{e:g}" for e in edges]]
    out = F.lit(names[-1])
    for edge, name in zip(reversed(edges), reversed(names[:-1]), strict=True):
        out = F.when(value <= edge if right_closed else value < edge, name).otherwise(out)
    return F.when(value.isNotNull(), out)
