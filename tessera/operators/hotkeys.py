"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.diff import latest
from tessera.staging import parallelism

_BLOCKS = "block int, keys array<string>, sums array<array<bigint>>"


def dense_sums(df: DataFrame, key: Column, measures: dict[str, Column]) -> DataFrame:
    """``(key, *measures)``: sums of integer measures per string key, null being a key of its own.

    Each input split, of equal size whatever its keys, dictionary-encodes its keys and adds its rows into dense
    arrays with ``bincount``.  The arrays go out cut into blocks by the key's hash, and a second stage adds blocks together.
    What is shuffled is a row per split and block: a key that holds a third of all rows costs the same as any other.
    Null measures count as 0.  An empty table gives no rows.
    """
    blocks, names = parallelism(df.sparkSession), list(measures)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str | None, int] = {}
        sums = np.zeros((len(names), 1024), np.int64)
        for batch in batches:
            d = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            local = np.array([codes.setdefault(k, len(codes)) for k in d.dictionary.to_pylist()], np.int64)
            while len(codes) > sums.shape[1]:
                sums = np.concatenate([sums, np.zeros_like(sums)], 1)
            if not len(local):
                continue
            index = d.indices.to_numpy()
            for m in range(len(names)):
                values = pc.fill_null(batch.column(1 + m), 0).to_numpy()
                if len(values) and (values == values[0]).all():
                    total = np.bincount(index, minlength=len(local)).astype(np.int64) * values[0]
                else:
                    total = np.zeros(len(local), np.int64)
                    np.add.at(total, index, values)
                sums[m, local] += total
        yield from _blocks(list(codes), sums)

    def _blocks(keys: list, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        hashed = np.array([_stable_hash(k) % blocks for k in keys], np.int64)
        for b in np.unique(hashed):
            at = np.flatnonzero(hashed == b)
            row = [[int(b)], [[keys[i] for i in at]], [sums[:, at].tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _arrow_blocks().types, strict=True)], schema=_arrow_blocks())

    def add(table: pa.Table) -> pa.Table:
        codes: dict[str | None, int] = {}
        parts = []
        for keys, sums in zip(table["keys"].to_pylist(), table["sums"].to_pylist(), strict=True):
            parts.append((np.array([codes.setdefault(k, len(codes)) for k in keys], np.int64), np.array(sums, np.int64)))
        total = np.zeros((len(names), len(codes)), np.int64)
        for at, sums in parts:
            total[:, at] += sums
        return pa.table([pa.array(list(codes), pa.string()), *[pa.array(t) for t in total]], names=["key", *names])

    rows = df.select(key.cast("string").alias("key"), *[m.cast("bigint").alias(n) for n, m in measures.items()])
    schema = ", ".join(["key string", *[f"`{n}` bigint" for n in names]])
    return rows.mapInArrow(split, _BLOCKS).groupBy("block").applyInArrow(add, schema)


def _arrow_blocks() -> pa.Schema:
    return pa.schema([("block", pa.int32()), ("keys", pa.list_(pa.string())), ("sums", pa.list_(pa.list_(pa.int64())))])


def _stable_hash(key: str | None) -> int:
    import zlib

    return 0 if key is None else zlib.crc32(key.encode("utf-8", "surrogatepass"))


def newest_rows(df: DataFrame, group: str, key: str, order: list[str]) -> DataFrame:
    """``df``'s newest row per group and key.  Null groups and keys are values of their own; see :func:`latest` for ties."""
    return latest(df, [group, key], order)


def group_summary(df: DataFrame, group: str, key: str) -> DataFrame:
    """``(group, n_rows, n_keys)``: rows and distinct keys per group; a null key counts as no key.

    The rows of a pair of group and key are combined first; the pairs, of which even a hot group has no more than distinct
    keys, are then spread evenly and summed by :func:`dense_sums`.
    """
    pairs = df.groupBy(F.col(group).cast("string").alias("g"), F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    return dense_sums(pairs, F.col("g"), {"n_rows": F.col("n"), "n_keys": F.col("k").isNotNull().cast("bigint")}).withColumnRenamed("key", group)
