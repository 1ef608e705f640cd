"""Cutting oversized texts at natural boundaries, by lexical cohesion."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Sizes in code points. A cut is looked for in the last ``1 - least`` of a piece's room; cohesion is measured on
    ``block`` sentences on either side of a boundary."""

    size: int = 1200
    overlap: int = 120
    least: float = 0.5
    block: int = 3


#: The ends of sentences (with closing quotes and brackets), lines and paragraphs, each with the blanks that follow.
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*\s*|\s*\n\s*")
_WORD = re.compile(r"[^\W_]+")
#: Kana and kanji, which are written without blanks.
_JAPANESE = "々ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaffｦ-ﾟ\U00020000-\U0003134f"
_RUN = re.compile(f"([{_JAPANESE}]+)|[^\\W_{_JAPANESE}]+")
_ANY_JAPANESE = re.compile(f"[{_JAPANESE}]")
_BLANK = re.compile(r"\s+")


def boundaries(text: str) -> list[int]:
    """Where a sentence, line or paragraph begins (the start and the end of the text are none)."""
    return [m.end() for m in _SENTENCE.finditer(text) if 0 < m.end() < len(text)]


def words(text: str) -> list[str]:
    """The runs of letters and digits; of a run of kana and kanji its pairs of neighbouring characters."""
    if not _ANY_JAPANESE.search(text):
        return _WORD.findall(text)
    out = []
    for m in _RUN.finditer(text):
        run = m[0]
        out += [run[i : i + 2] for i in range(len(run) - 1)] if m[1] and len(run) > 1 else [run]
    return out


def depths(text: str, cuts: list[int], block: int) -> list[float]:
    """How deep the valley of lexical similarity is at each boundary.

    The similarity at a boundary is the cosine of the counts of :func:`words` of the ``block`` sentences before and after it.  The depth
    is the sum of the climbs to the nearest peaks on both sides.
    """
    edges = [0, *cuts, len(text)]
    bags = [Counter(words(text[a:b].lower())) for a, b in zip(edges, edges[1:], strict=False)]
    left: Counter = Counter()
    right: Counter = Counter()
    for bag in bags[1 : 1 + block]:
        right.update(bag)
    similar = []
    for i in range(len(cuts)):
        left.update(bags[i])
        if i >= block:
            left.subtract(bags[i - block])
        if i:
            right.subtract(bags[i])
            if i + block < len(bags):
                right.update(bags[i + block])
        few, many = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(n * many[w] for w, n in few.items() if n and w in many)
        norm = sum(n * n for n in left.values()) * sum(n * n for n in right.values())
        similar.append(dot / norm**0.5 if norm else 0.0)
        if i % 64 == 63:  # words that left a window leave its table
            left, right = +left, +right
    # from a boundary the climb goes on while the similarity does not fall
    before, after = similar[:], similar[:]
    for i in range(1, len(similar)):
        if similar[i - 1] >= similar[i]:
            before[i] = before[i - 1]
    for i in range(len(similar) - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            after[i] = after[i + 1]
    return [x + y - 2 * s for x, y, s in zip(before, after, similar, strict=True)]


def cut(text: str, limits: Limits) -> list[tuple[int, int]]:
    """``(start, stop)`` of the pieces, in order; each begins with the overlap with the one before.

    A text within the limit is one piece.  In the window of each piece the boundary with the deepest valley is taken (the later
    one of equals); without a boundary in the window the last earlier one, then the last blank, then the limit itself.
    """
    if len(text) <= limits.size:
        return [(0, len(text))]
    cuts = boundaries(text)
    depth = depths(text, cuts, limits.block)
    out: list[tuple[int, int]] = []
    start = done = first = 0
    while len(text) - start > limits.size:
        top = start + limits.size
        low = max(done + 1, start + int(limits.size * limits.least))
        while first < len(cuts) and cuts[first] <= done:
            first += 1
        stop = earlier = last = 0
        best = -1.0
        i = first
        while i < len(cuts) and cuts[i] <= top:
            if cuts[i] >= low:
                if depth[i] >= best:
                    best, stop = depth[i], cuts[i]
            elif cuts[i] > done + limits.overlap:
                earlier = cuts[i]
            i += 1
        if not stop:
            stop = earlier
        if not stop:
            for m in _BLANK.finditer(text, done + 1, top):
                last = m.end()
            stop = last if done < last <= top else top
        out.append((start, stop))
        done = stop
        start = _opening(text, out[-1], cuts, limits.overlap)
    out.append((start, len(text)))
    return out


def _opening(text: str, piece: tuple[int, int], cuts: list[int], overlap: int) -> int:
    """Where the next piece begins: a sentence or else a word within the last ``overlap`` code points of ``piece``."""
    start, stop = piece
    low = max(start + 1, stop - overlap)
    i = bisect_left(cuts, low)
    if i < len(cuts) and cuts[i] < stop:
        return cuts[i]
    m = _BLANK.search(text, low - 1, stop)
    return m.end() if m and m.end() < stop else low


PIECES = "id bigint, piece int, start int, stop int, overlap int, text string"


def split_texts(df: DataFrame, id_col: str, text_col: str, limits: Limits | None = None, only_oversized: bool = False) -> DataFrame:
    """``(id, piece, start, stop, overlap, text)``: each text of ``df`` in pieces of at most ``limits.size`` code points.

    Pieces are numbered from 0; ``overlap`` code points at the head of a piece repeat the end of the one before, so that the
    pieces without them, put together, are the text.  Each text is cut in the task that read it: nothing is shuffled.

    Texts within the limit are one piece (left out with ``only_oversized``), empty ones too; a null text gives no piece.
    Null and repeated ids are kept as they are.  Other columns are not read.  An empty table gives no rows.
    """
    limits = limits or Limits()
    if not 0 <= limits.overlap < limits.size * limits.least:
        raise ValueError("the overlap must be smaller than the least share of a piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = 0
                for k, (start, stop) in enumerate(cut(text, limits)):
                    rows.append((i, k, start, stop, before - start if k else 0, text[start:stop]))
                    before = stop
                if len(rows) > 5000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    if only_oversized:
        rows = rows.where(F.char_length("text") > limits.size)
    return rows.mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    names = ["id", "piece", "start", "stop", "overlap", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
