"""Vector similarity: pairwise measures and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def kernel(a: Column, b: Column, kind: str, gamma: float | None = None, degree: int = 3, coef0: float = 1.0) -> Column:
    """``laplacian``, ``polynomial``, ``rbf`` or ``sigmoid``; ``gamma`` is one over the dimension by default."""
    g = F.lit(gamma) if gamma is not None else F.lit(1.0) / F.size(a)
    return {
        "laplacian": lambda: F.exp(-g * l1(a, b)), "rbf": lambda: F.exp(-g * F.pow(l2(a, b), F.lit(2.0))),
        "polynomial": lambda: F.pow(g * dot(a, b) + coef0, F.lit(float(degree))), "sigmoid": lambda: F.tanh(g * dot(a, b) + coef0),
    }[kind]()


MEASURES = {"cos": cosine, "dot": dot, "l2": l2, "l1": l1}

#: Query vectors compared with a batch at a time: what a task holds beside its batch.
BLOCK = 2048


def nearest(data: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, measure: str = "cos", exclude_self: bool = True) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` best rows for each query, by falling score, ties by id.

    Queries are a stated set: they go to the tasks in blocks of ``BLOCK`` vectors, each block meets every batch of the data as
    one matrix product, and a task sends ``k`` candidates per query and batch on.  Distances count as scores with a minus.
    Null vectors are left out; vectors must have equal lengths.
    """
    blocks = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    rows = data.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    total = blocks.count()
    parts = max(1, -(-total // BLOCK))
    found = None
    for part in range(parts):
        block = blocks if parts == 1 else blocks.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)
        local = block.toArrow()
        q_ids = local.column("q").to_numpy()
        q = np.array(local.column("v").to_pylist(), np.float64).reshape(len(q_ids), -1)
        one = rows.mapInArrow(_against(q_ids, q, k, measure, exclude_self), "q bigint, id bigint, score double")
        found = one if found is None else found.unionAll(one)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "id", "score", "rank")


def _against(q_ids: np.ndarray, q: np.ndarray, k: int, measure: str, exclude_self: bool):
    def scores(x: np.ndarray) -> np.ndarray:
        if measure == "dot":
            return q @ x.T
        if measure == "cos":
            size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
            return np.divide(q @ x.T, size, out=np.full((len(q), len(x)), -np.inf), where=size > 0)
        if measure == "l2":
            return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0))
        return -np.stack([np.abs(x - v).sum(1) for v in q]) if len(q) else np.zeros((0, len(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids) or not len(q):
                continue
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
            s = np.round(scores(x), 12)
            if exclude_self:
                s[q_ids[:, None] == ids[None, :]] = -np.inf
            for i in range(len(q)):
                keep = s[i] >= np.partition(s[i], -k)[-k] if len(ids) > k else np.ones(len(ids), bool)
                at = np.flatnonzero(keep & np.isfinite(s[i]))
                at = at[np.lexsort((ids[at], -s[i][at]))[:k]]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q_ids[i])), pa.array(ids[at]), pa.array(s[i][at])], ["q", "id", "score"])

    return run
