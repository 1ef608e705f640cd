"""Named queues and operation logs, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.windows import positions


def read_queue(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of JSON lines as a stream; what was taken is in the query's checkpoint."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def put(items: DataFrame, path: str) -> None:
    items.write.mode("append").json(path)


def fifo(log: DataFrame, queue: str = "queue_id", order: list[str] = ("seq",)) -> DataFrame:
    """``log`` with ``pos``: the place of each item in its queue, from 0.  A long queue is spread over tasks."""
    return positions(log, [queue], list(order))


def peek(log: DataFrame, index: int, queue: str = "queue_id", order: list[str] = ("seq",)) -> DataFrame:
    """The item at an index of each queue, from the end for negative ones.  A task keeps no more rows of a queue than the index asks for."""
    w = Window.partitionBy(queue).orderBy(*[F.desc(c) if index < 0 else F.asc(c) for c in order])
    place = -index if index < 0 else index + 1
    # the limit is pushed below the shuffle, the equality is not
    return log.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= place).where(F.col("__r") == place).drop("__r")


def replay(operations: DataFrame, queue: str = "queue_id", op: str = "op", op_id: str = "operation_id", order: list[str] = ("ts",)) -> DataFrame:
    """What is in each queue after an operation log (``put``, ``get``, ``clear``, ``delete``): ``(queue, operation_id, payload)``.

    Operations seen before are skipped.  A FIFO queue's state follows from counts: with ``B`` the balance of puts and gets since the
    last clear, floored at 0 where gets find nothing, the rest is its last ``B`` puts; so no state is carried from row to row.
    """
    from tessera.operators.aggregate import first_occurrences

    once = first_occurrences(operations, [op_id], order[0])
    w = Window.partitionBy(queue).orderBy(*order, op_id)
    live = once.withColumn("__c", F.sum(F.col(op).isin("clear", "delete").cast("int")).over(w))
    live = live.withColumn("__last", F.max("__c").over(Window.partitionBy(queue))).where((F.col("__c") == F.col("__last")) & F.col(op).isin("put", "get"))
    step = F.when(F.col(op) == "put", 1).otherwise(-1)
    run = live.withColumn("__s", F.sum(step).over(w))
    end = run.groupBy(queue).agg((F.max_by("__s", F.struct(*order, op_id)) - F.least(F.min("__s"), F.lit(0))).alias("__b"))
    puts = live.where(F.col(op) == "put").withColumn("__r", F.row_number().over(Window.partitionBy(queue).orderBy(*[F.desc(c) for c in [*order, op_id]])))
    return puts.join(end, queue).where(F.col("__r") <= F.col("__b")).select(*operations.columns)


def stats(log: DataFrame, queue: str = "queue_id") -> DataFrame:
    return log.groupBy(queue).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """A stream without repeated keys within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)
