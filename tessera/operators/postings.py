"""Many text queries against many texts: the best of each query, exactly, by products of blocks.

Texts are packed once into blocks of postings in the shared folder.  A task holds some queries and reads every block: terms that
many of its queries and many of the block's texts have are multiplied as dense matrices, the others posting by posting, so that
nothing is shuffled but the queries, and a task keeps about ``k`` rows a query, whatever its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.staging import stage

#: Texts and words of a block at most, a longer text being a block of its own; queries of a task that meet a block at once at most,
#: and those that are worth a task.
TEXTS, WORDS, QUERIES, LEAST = 4096, 1 << 20, 2048, 256
#: Share of a block's pairs from which on a term is multiplied as a column of a matrix; columns at once; pairs worked on at once.
DENSE, COLUMNS, PAIRS = 0.002, 1024, 1 << 21
#: Scores of which one is over the other by less than this share of a query's best may be equal when they are rounded to 9 digits.
ROUNDED = 1.1e-9
#: Stands for a null id.
_NO_ID = -(1 << 63)

PACKED = "n bigint, words bigint, ids binary, sizes binary, lengths binary, codes binary, counts binary, terms array<string>, dfs array<bigint>"
FOUND = "q bigint, id bigint, raw double, n int, rank bigint"


def packed(docs: DataFrame, id_col: str, text: Column, stem: bool = False) -> DataFrame:
    """The words of all rows with a text, staged in blocks: of each row the different terms, in order, and how often it has each."""
    rows = docs.where(text.isNotNull()).select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"), tokens(text, stem).alias("w"))
    return stage(rows.mapInArrow(_pack, PACKED), "texts", **{"parquet.block.size": 8 << 20})


def vocabulary(blocks: DataFrame) -> tuple[DataFrame, int, float]:
    """``(term, df)``, the number of rows and their mean length, as :func:`tessera.operators.search.vocabulary` has them."""
    whole = blocks.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    each = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
    n = whole["n"] or 0
    return stage(each.withColumnRenamed("terms", "term"), "terms"), n, (whole["words"] / n if n else 0.0) or 1.0


def best(blocks: DataFrame, asked: DataFrame, k: int, bm25: tuple[float, float, float] | None = None) -> DataFrame:
    """``(q, id, raw, n, rank)``: of each row of ``asked`` ``(q, terms, weights)`` the ``k`` rows of :func:`packed` with the largest sums
    over 0, ties by id; ``n`` is the number of the query's terms, which must be different ones.

    Without ``bm25`` the weights of shared terms are summed as they are, and must be small whole numbers.  With ``bm25`` ``(k1, b,
    mean length)`` each weight is multiplied by what the term's count and the text's length make of it, and rows come that may be
    among the ``k`` best once sums are divided by the best one and rounded to 9 digits.
    """
    asked = stage(asked, "asked")
    total, cores = asked.count(), asked.sparkSession.sparkContext.defaultParallelism
    # each task reads all blocks: few tasks, and as many on each core
    parts = max(1, -(-total // QUERIES), min(2 * cores, -(-total // LEAST)))
    parts = parts if parts <= cores else -(-parts // cores) * cores
    found = asked.repartition(parts).mapInArrow(_against(blocks._staged_at, k, bm25), FOUND)
    return found.withColumn("id", F.nullif("id", F.lit(_NO_ID)))


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _pieces(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows with ``most`` in all, or one row with more."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words in order, and the place of each word among them."""
    found = words.dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), place[found.indices.to_numpy()]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PACKED.split(", ")]
    for batch in batches:
        all_ids, lists = batch.column(0).to_numpy(), batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        each = -(-len(all_ids) // max(1, -(-len(all_ids) // TEXTS)))
        for first in range(0, len(all_ids), each or 1):
            for piece in _pieces(np.diff(offsets[first : first + each + 1]), WORDS):
                at = offsets[first + piece.start : first + piece.stop + 1]
                ids, lengths = all_ids[first + piece.start : first + piece.stop], np.diff(at)
                terms, code = _coded(lists.values.slice(at[0], at[-1] - at[0]))
                v = max(1, len(terms))
                key, counts = np.unique(np.repeat(np.arange(len(ids)), lengths) * v + code, return_counts=True)
                doc, code = np.divmod(key, v)
                sizes, dfs = np.bincount(doc, minlength=len(ids)), np.bincount(code, minlength=len(terms))
                binary = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((ids, np.int64), (sizes, np.int32), (lengths, np.int32), (code, np.int32), (counts, np.int32))]
                listed = [pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), x) for x in (terms, pa.array(dfs, pa.int64()))]
                yield pa.record_batch([pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), *binary, *listed], names=names)


def _blocks(path: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Each block's terms, and its ids, sizes, lengths, codes and counts."""
    system, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    arrays = {"ids": np.int64, "sizes": np.int32, "lengths": np.int32, "codes": np.int32, "counts": np.int32}
    for name in sorted(x.path for x in system.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet")):
        with system.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=1, columns=["terms", *arrays], use_threads=False):
                for i in range(len(batch)):
                    yield batch.column("terms")[i].values, [np.frombuffer(batch.column(x)[i].as_buffer(), kind) for x, kind in arrays.items()]


def _against(path: str, k: int, bm25: tuple[float, float, float] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := [b for b in batches if len(b)]:
            asked = pa.Table.from_batches(rows).combine_chunks()
            for at in range(0, len(asked), QUERIES):
                some = asked.slice(at, QUERIES)
                search = _Search(some.column("q").combine_chunks(), some.column("terms").combine_chunks(), some.column("weights").combine_chunks(), k, bm25)
                for terms, block in _blocks(path):
                    search.meet(terms, *block)
                yield from search.found()

    return run


class _Search:
    """Some queries, and the best rows of each so far."""

    def __init__(self, q: pa.Array, terms: pa.Array, weights: pa.Array, k: int, bm25: tuple[float, float, float] | None) -> None:
        self.q, self.k, self.bm25, self.n = q, k, bm25, len(q)
        self.sizes = terms.value_lengths().to_numpy().astype(np.int64)
        self.vocabulary, self.term = _coded(terms.flatten())
        self.v = max(1, len(self.vocabulary))
        self.row = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(self.row * self.v + self.term)
        self.term, self.weight = self.term[order], weights.flatten().to_numpy().astype(np.float64)[order]
        self.key = self.row * self.v + self.term
        self.qf = np.bincount(self.term, minlength=self.v)
        # a sum of m products in single precision is off by less than m + 8 half units in the last place of what it can be at most
        reach = np.bincount(self.row, np.abs(self.weight), minlength=self.n) * (bm25[0] + 1 if bm25 else 0)
        self.margin, self.near = (self.sizes + 8) * 2.0**-24 * reach, ROUNDED * reach
        negative = np.bincount(self.row, self.weight < 0, minlength=self.n) > 0
        self.floor = np.where(negative, -2 * self.margin, np.finfo(np.float32).tiny)
        # of each query the k-th best sum so far, and its id
        self.least, self.last = np.full(self.n, -np.inf), np.full(self.n, np.iinfo(np.int64).max)
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.first = 0, True

    def meet(self, terms: pa.Array, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        place = pc.fill_null(pc.index_in(terms, value_set=self.vocabulary), -1).to_numpy()
        # both vocabularies are in order, so a text's terms stay so: equal texts get equal sums in whatever block
        term = place[codes]
        known = term >= 0
        term, doc = term[known], np.repeat(np.arange(len(ids)), sizes)[known]
        if not len(term):
            return
        if self.bm25:
            k1, b, average = self.bm25
            tf = counts[known].astype(np.float64)
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / average))
        else:
            weight = np.ones(len(term))
        sums = self._sums(len(ids), term, doc, weight)
        bound = self.least
        if self.first and len(ids) >= self.k:
            bound, self.first = np.partition(sums, len(ids) - self.k, axis=1)[:, len(ids) - self.k].astype(np.float64), False
        if not self.bm25:
            # whole numbers: what only equals the k-th must have a lesser id
            bound = np.where(ids.min() > self.last, bound + 1, bound)
        bound = np.nextafter(np.maximum(bound - 2 * self.margin - self.near, self.floor).astype(np.float32), np.float32(-np.inf))
        if not self.bm25:
            bound = np.maximum(bound, np.float32(0.5))
        rows, own = max(1, 2 * PAIRS // len(ids)), np.bincount(doc, minlength=len(ids))
        for lo in range(0, self.n, rows):
            row, at = np.divmod(np.flatnonzero(sums[lo : lo + rows] >= bound[lo : lo + rows, None]), len(ids))
            row += lo
            raw = self._exact(row, at, own, term, weight) if self.bm25 else sums[row, at].astype(np.float64)
            over = raw > 0
            self.pool.append((row[over], ids[at[over]], raw[over]))
            self.waiting += int(over.sum())
            if self.waiting > max(PAIRS, self.n * self.k):
                self._prune()
        if self.waiting > self.n * self.k // 8:
            self._prune()

    def _sums(self, n: int, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each query and row, in single precision."""
        df = np.bincount(term, minlength=self.v)
        work = self.qf * df
        dense = np.flatnonzero(work > DENSE * self.n * n)
        sums = None
        for at in range(0, len(dense), COLUMNS):
            columns = np.full(self.v, -1)
            columns[dense[at : at + COLUMNS]] = np.arange(len(dense[at : at + COLUMNS]))
            one, two = (self._matrix(h, columns[t], r, w, min(COLUMNS, len(dense) - at)) for h, t, r, w in ((self.n, self.term, self.row, self.weight), (n, term, doc, weight)))
            sums = one @ two.T if sums is None else np.add(sums, one @ two.T, out=sums)
        if sums is None:
            sums = np.zeros((self.n, n), np.float32)
        work[dense] = 0
        # the others: each posting of the queries with each of the block's
        ours, theirs = np.flatnonzero(work[self.term]), np.flatnonzero(work[term])
        theirs = theirs[np.argsort(term[theirs], kind="stable")]
        df[work == 0] = 0
        start, flat = np.cumsum(df) - df, sums.reshape(-1)
        doc, weight, mine = doc[theirs], weight[theirs].astype(np.float32), self.weight.astype(np.float32)
        for piece in _pieces(df[self.term[ours]], PAIRS):
            x = ours[piece]
            t = self.term[x]
            index = _runs(start[t], df[t])
            np.add.at(flat, np.repeat(self.row[x] * n, df[t]) + doc[index], np.repeat(mine[x], df[t]) * weight[index])
        return sums

    @staticmethod
    def _matrix(height: int, column: np.ndarray, row: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
        out, there = np.zeros((height, width), np.float32), column >= 0
        out[row[there], column[there]] = weight[there]
        return out

    def _exact(self, row: np.ndarray, at: np.ndarray, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The sums of rows ``at`` for the queries ``row``, in double precision and in the order of terms."""
        start, out = np.cumsum(sizes) - sizes, np.zeros(len(row))
        for piece in _pieces(sizes[at], PAIRS):
            count = sizes[at[piece]]
            index = _runs(start[at[piece]], count)
            key = np.repeat(row[piece] * self.v, count) + term[index]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[piece] = np.bincount(np.repeat(np.arange(len(count)), count), np.where(self.key[place] == key, self.weight[place], 0.0) * weight[index], minlength=len(count))
        return out

    def _prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keep what may be among the ``k`` best: row, id, sum and place."""
        row, ids, raw = (np.concatenate(x) for x in zip(*self.pool, strict=True))
        order = np.lexsort((ids, -raw, row))
        row, ids, raw = row[order], ids[order], raw[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = np.flatnonzero(place == self.k - 1)
        self.least[row[last]], self.last[row[last]] = raw[last], ids[last]
        keep = place < self.k
        if self.bm25:
            # of equal sums, the k least ids
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (raw[1:] != raw[:-1])]) if len(row) else np.zeros(0, np.int64)
            run = np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)]))
            keep |= (raw >= (self.least - self.near)[row]) & (run < self.k)
        kept = row[keep], ids[keep], raw[keep]
        self.pool, self.waiting = [kept], 0
        return *kept, place[keep]

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.pool:
            row, ids, raw, place = self._prune()
            yield pa.record_batch([self.q.take(pa.array(row)), *(pa.array(x) for x in (ids, raw, self.sizes[row].astype(np.int32), place + 1))], names=["q", "id", "raw", "n", "rank"])
