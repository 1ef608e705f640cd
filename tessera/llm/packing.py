"""Filling containers of permitted capacities with texts of varying length."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.tokens import VOCABULARY, encoder

#: Items that are packed together at a time: a task's memory is bounded, whatever the size of its split.
ITEMS = 1 << 16


class Left:
    """The items that are still to be placed, by size: one bit per size that is there."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        self.bits = 0
        for size in sizes:
            self.count[size] = self.count.get(size, 0) + 1
            self.bits |= 1 << size

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.bits &= ~(1 << size)

    def fill(self, room: int, most: int = 12) -> int:
        """How much of a room the items would fill, the largest that fits first."""
        used: dict[int, int] = {}
        filled = 0
        for _ in range(most):
            fits = self.bits & ((1 << (room - filled + 1)) - 1)
            while fits:
                size = fits.bit_length() - 1
                if used.get(size, 0) < self.count[size]:
                    break
                fits &= ~(1 << size)
            if not fits:
                break
            used[size] = used.get(size, 0) + 1
            filled += size
        return filled


def best_fit(sizes: list[int], capacities: tuple[int, ...], opened: int | None) -> tuple[list[int], list[int]]:
    """Bins of items given from the largest down: ``(bin of each item, content of each bin)``.

    An item goes to the open bin with the least room that holds it.  Where none does, a bin is opened: of the least permitted
    capacity from ``opened`` up that holds the item, or, without ``opened``, of the capacity that costs least.  The cost of a
    capacity is the places a token takes once the bin is cut down to what the items left would fill it with.  Rooms are found
    with one bit per room in an integer.
    """
    rooms: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    free = 0
    content: list[int] = []
    room_of: list[int] = []
    out: list[int] = []
    left = Left(sizes) if opened is None else None
    for size in sizes:
        if left:
            left.take(size)
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free &= ~(1 << room)
        else:
            b = len(content)
            content.append(0)
            room_of.append(0)
            if left:
                best = None
                for c in capacities[bisect_left(capacities, size) :]:
                    total = size + left.fill(c - size)
                    cost = capacities[bisect_left(capacities, total)] / total
                    if best is None or cost <= best:
                        best, room = cost, c
            else:
                room = capacities[max(bisect_left(capacities, size), bisect_left(capacities, opened))]
        content[b] += size
        room -= size
        room_of[b] = room
        out.append(b)
        if room:
            rooms[room].append(b)
            free |= 1 << room
    return out, content


def pack(sizes: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """``(bin of each item, capacity of each bin)``: a capacity chosen at each opening, or one for all openings where that leaves less
    unused space in the end.

    Each bin ends with the least permitted capacity that holds its content.  Items above the largest capacity are an error.
    """
    order = np.argsort(-sizes, kind="stable")
    given = sizes[order].tolist()
    best = None
    for opened in (None, *capacities[::-1]):
        bins, content = best_fit(given, capacities, opened)
        capacity = np.array(capacities)[np.searchsorted(capacities, content)]
        if best is None or capacity.sum() < best[2].sum():
            best = (bins, content, capacity)
    out = np.empty(len(sizes), np.int64)
    out[order] = best[0]
    return out, best[2]


PLACED = "id bigint, piece int, n_pieces int, bin bigint, capacity int, at int, n_tokens int"


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, piece, n_pieces, bin, capacity, at, n_tokens)``: where the tokens of each text go.

    ``bin`` is unique over the table, ``capacity`` one of ``capacities``, ``at`` the first token's place in the bin.  A text is
    split only if it exceeds the largest capacity: into full pieces and a rest.  Every task packs what it reads, up to
    ``ITEMS`` texts at a time, so nothing is shuffled; each such run leaves no more than a few part-filled bins, which
    are cut down to their contents.

    Null, empty texts have no tokens and go to no bin: they give a row with null bin, capacity and at.  Ids may be null or
    repeated.  Other columns are not read; an empty table gives no rows.
    """
    capacities = tuple(sorted(set(capacities)))
    top = capacities[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode = encoder(vocabulary).encode_ordinary
        bins = task << 36
        ids: list = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal bins
            n = np.array(sizes, np.int64)
            pieces = np.maximum(-(-n // top), 1)
            owner = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(n[owner] - piece * top, top)
            some = np.flatnonzero(size)
            place, capacity = pack(size[some], capacities)
            order = np.argsort(place, kind="stable")
            run_start = np.searchsorted(place[order], place[order])
            total = np.cumsum(size[some][order]) - size[some][order]
            at = np.empty(len(some), np.int64)
            at[order] = total - total[run_start] if len(some) else total
            full = {name: np.zeros(len(size), np.int64) for name in ("bin", "capacity", "at")}
            full["bin"][some], full["at"][some] = place + bins, at
            full["capacity"][some] = capacity[place] if len(some) else 0
            bins += len(capacity)
            none = size == 0
            columns = [
                pa.array(ids, pa.int64()).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(pieces[owner], pa.int32()), pa.array(full["bin"], pa.int64(), mask=none),
                pa.array(full["capacity"], pa.int32(), mask=none), pa.array(full["at"], pa.int32(), mask=none), pa.array(size, pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["id", "piece", "n_pieces", "bin", "capacity", "at", "n_tokens"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            sizes += [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            if len(sizes) >= ITEMS:
                yield flush()
                ids, sizes = [], []
        if sizes:
            yield flush()

    return df.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{text_col}` as text").mapInArrow(run, PLACED)
