"""Namespaced key-value tables kept as a log of puts: ``namespace, key, value_json``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.diff import latest

DEFAULT = "_default"


class KeyValue:
    """A view of the current values of a table ``(namespace, key, value)``; changes give new views."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @staticmethod
    def from_log(log: DataFrame, key: str, value: str, order: list[str]) -> KeyValue:
        """The last put of each key; a null namespace is ``_default``."""
        named = log.select(F.coalesce("namespace", F.lit(DEFAULT)).alias("namespace"), F.col(key).alias("key"), *order, F.col(value).alias("value"))
        return KeyValue(latest(named, ["namespace", "key"], order).select("namespace", "key", "value"))

    def _in(self, namespace: str | None) -> DataFrame:
        return self.rows.where(F.col("namespace") == (DEFAULT if namespace is None else namespace))

    def get(self, key: str, namespace: str | None = None) -> str | None:
        row = self._in(namespace).where(F.col("key") == key).first()
        return row["value"] if row else None

    def get_many(self, keys: DataFrame) -> DataFrame:
        """The values of ``(namespace, key)`` rows; missing keys and null values are left out."""
        wanted = keys.select(F.coalesce("namespace", F.lit(DEFAULT)).alias("namespace"), "key").distinct()
        return self.rows.join(wanted, ["namespace", "key"], "left_semi").where("value is not null")

    def put_many(self, items: DataFrame, order: str | None = None) -> KeyValue:
        """Upsert ``(namespace, key, value)``; of a key that is put twice the last by ``order`` stays, or, as rows have no order of their
        own, the greater value."""
        new = items.select(F.coalesce("namespace", F.lit(DEFAULT)).alias("namespace"), "key", "value", *([F.col(order).alias("__o")] if order else []))
        last = F.max("value") if order is None else F.max_by("value", F.struct("__o", "value"))
        new = new.groupBy("namespace", "key").agg(last.alias("value"))
        return KeyValue(self.rows.join(new, ["namespace", "key"], "left_anti").unionByName(new))

    def delete(self, keys: DataFrame) -> KeyValue:
        gone = keys.select(F.coalesce("namespace", F.lit(DEFAULT)).alias("namespace"), "key")
        return KeyValue(self.rows.join(gone, ["namespace", "key"], "left_anti"))

    def exists(self, key: str, namespace: str | None = None) -> bool:
        return bool(self._in(namespace).where(F.col("key") == key).head(1))

    def keys(self, namespace: str | None = None) -> DataFrame:
        return self._in(namespace).select("key")

    def clear(self, namespace: str | None = None) -> KeyValue:
        return KeyValue(self.rows.where(F.col("namespace") != (DEFAULT if namespace is None else namespace)))

    def size(self, namespace: str | None = None) -> int:
        return self._in(namespace).count()

    def namespaces(self) -> DataFrame:
        return self.rows.select("namespace").distinct()

    def stats(self) -> DataFrame:
        return self.rows.groupBy("namespace").agg(F.count("*").alias("n"))
