"""What only code can read: quoted splits, call texts, tag patterns, weighted distances, small searches.

All are vectorised functions over Arrow batches.
"""

from __future__ import annotations

import ast
import heapq
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _each(f: Callable, out: T.DataType) -> Callable[..., Column]:
    """A function of plain values as a function of columns; a null argument gives null."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, out)(*columns)


# ---- quoted splits and calls

_CLOSE = {"(": ")", "[": "]", "{": "}"}


def split_outside(text: str, sep: str, escape: str = "\\", quotes: str = "\"'", keep_quotes: bool = True) -> list[str]:
    """Split at separators that stand outside quotes and brackets and are not escaped."""
    out, part, wait, at = [], "", [], 0
    while at < len(text):
        c = text[at]
        if c == escape and at + 1 < len(text):
            part += text[at : at + 2] if wait or text[at + 1] != sep[0] else text[at + 1]
            at += 2
            continue
        if wait and c == wait[-1]:
            wait.pop()
        elif c in quotes and not (wait and wait[-1] in quotes):
            wait.append(c)
        elif c in _CLOSE and not (wait and wait[-1] in quotes):
            wait.append(_CLOSE[c])
        elif not wait and text.startswith(sep, at):
            out.append(part)
            part, at = "", at + len(sep)
            continue
        part += c
        at += 1
    out.append(part)
    return out if keep_quotes else [p.strip()[1:-1] if len(p.strip()) > 1 and p.strip()[0] in quotes and p.strip()[0] == p.strip()[-1] else p for p in out]


def split_quoted(s: Column, sep: str = ",", keep_quotes: bool = True) -> Column:
    return _each(lambda x: split_outside(x, sep, keep_quotes=keep_quotes), STRINGS)(s)


def split_calls(s: Column, sep: str = ";") -> Column:
    """The calls of a text such as ``f(1; 2); g('a;b')``."""
    return _each(lambda x: [p.strip() for p in split_outside(x, sep) if p.strip()], STRINGS)(s)


def _call(text: str) -> str | None:
    try:
        node = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    if not isinstance(node, ast.Call):
        return None
    read = lambda n: n.value if isinstance(n, ast.Constant) else ast.unparse(n)
    return json.dumps({"name": ast.unparse(node.func), "args": [read(a) for a in node.args], "kwargs": {k.arg or "**": read(k.value) for k in node.keywords}}, default=str)


def parse_call(s: Column) -> Column:
    """``struct<name, args, kwargs>`` of a call; null where the text is none."""
    return F.from_json(_each(_call, T.StringType())(s), "name string, args array<string>, kwargs map<string,string>")


def same_calls(a: Column, b: Column, sep: str = ";") -> Column:
    """Two texts make the same calls, in order, however they are spelled."""
    return _each(lambda x, y: [_call(p) or p for p in map(str.strip, split_outside(x, sep)) if p] == [_call(p) or p for p in map(str.strip, split_outside(y, sep)) if p], T.BooleanType())(a, b)


# ---- XML


def from_xml(s: Column, schema: str) -> Column:
    return F.from_xml(s, schema)


def to_xml(value: Column, root: str = "row") -> Column:
    return F.to_xml(value, {"rowTag": root})


# ---- entities by the pattern of their tags


def entities(df: DataFrame, text: str, tagger: Callable[[str], list[tuple[str, str]]], pattern: str, letters: dict[str, str], out: str = "entities") -> DataFrame:
    """``df`` with the token runs whose tags match a pattern.  ``tagger`` gives ``(token, tag)`` pairs; ``letters`` turns tags into the
    letters of the pattern, others being ``.``; e.g. ``A*N+`` with ``{"ADJ": "A", "NOUN": "N"}``."""
    compiled = re.compile(pattern)

    def found(x: str) -> list[str]:
        tagged = tagger(x)
        tags = "".join(letters.get(t, ".") for _, t in tagged)
        return [" ".join(w for w, _ in tagged[m.start() : m.end()]) for m in compiled.finditer(tags) if m.end() > m.start()]

    return df.withColumn(out, _each(found, STRINGS)(F.col(text)))


def batched(df: DataFrame, f: Callable[[list[str]], list[list[str]]], text: str, out: str, schema: str = "array<string>") -> DataFrame:
    """``df`` with a column a function of whole batches of texts computes (a recogniser with a batch interface)."""
    fields = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema), f"`{out}` {schema}"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: f(frame[text].tolist())})

    return df.mapInPandas(run, fields)


# ---- distances with weights


def weighted_similarity(a: Column, b: Column, same_start: float = 1.0, same_first_token: float = 1.0, contained: float = 1.0, short: float = 1.0, short_length: int = 3) -> Column:
    """1 - normalised edit distance, the distance multiplied by a weight for each case that holds: equal first letters, equal first
    tokens, one string containing the other, a string of at most ``short_length`` characters."""
    from tessera.functions.text import normalized_edit_distance

    first = lambda s: F.substring_index(s, " ", 1)
    d = normalized_edit_distance(a, b)
    cases = [
        (F.substring(a, 1, 1) == F.substring(b, 1, 1), same_start), (first(a) == first(b), same_first_token), (F.contains(a, b) | F.contains(b, a), contained),
        (F.least(F.char_length(a), F.char_length(b)) <= short_length, short),
    ]
    for test, weight in cases:
        if weight != 1.0:
            d = d * F.when(test, weight).otherwise(1.0)
    return 1 - F.least(d, F.lit(1.0))


# ---- small searches within a row


def word_in_grid(grid: Column, word: Column) -> Column:
    """The word lies on a path of neighbouring cells of the grid (an array of strings), no cell used twice."""

    def search(rows: list[str], w: str) -> bool:
        cells = {(i, j): c for i, row in enumerate(rows) for j, c in enumerate(row)}
        todo = [((p,), 1) for p, c in cells.items() if w and c == w[0]]
        while todo:
            path, n = todo.pop()
            if n == len(w):
                return True
            i, j = path[-1]
            todo += [((*path, q), n + 1) for q in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if q not in path and cells.get(q) == w[n]]
        return not w

    return _each(lambda g, w: search(list(g), w), T.BooleanType())(grid, word)


def shortest_tour(distances: Column) -> Column:
    """The length of the shortest round trip through all points of a square matrix; null where there is none or beyond 15 points."""

    def tour(m: list[list[float]]) -> float | None:
        n = len(m)
        if not 0 < n <= 15:
            return None
        best = {(1, 0): 0.0}
        for mask in range(1, 1 << n, 2):
            for last in range(n):
                d = best.get((mask, last))
                if d is None:
                    continue
                for k in range(n):
                    if not mask >> k & 1 and m[last][k] is not None:
                        key = (mask | 1 << k, k)
                        best[key] = min(best.get(key, float("inf")), d + m[last][k])
        ends = [best[((1 << n) - 1, k)] + (m[k][0] or 0.0) for k in range(n) if ((1 << n) - 1, k) in best and (m[k][0] is not None or n == 1)]
        return min(ends, default=None)

    return _each(lambda m: tour([list(r) for r in m]), T.DoubleType())(distances)


def cheapest_merges(sizes: Column) -> Column:
    """The least total cost of merging all parts two at a time, a merge costing the sum of its parts."""

    def cost(parts: list[float]) -> float:
        heap, total = list(map(float, parts)), 0.0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            total += x
            heapq.heappush(heap, x)
        return total

    return _each(lambda p: cost(list(p)), T.DoubleType())(sizes)


def permutations(df: DataFrame, array: str, out: str = "permutation", most: int | None = None) -> DataFrame:
    """A row per arrangement of an array, made one batch after the other.  With ``most``, an array of more elements is an error."""
    from itertools import batched
    from itertools import permutations as arrangements

    import pyarrow as pa

    kind = df.schema[array].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values in enumerate(batch.column(array)):
                if not values.is_valid:
                    continue
                size = len(values.values)
                if most is not None and size > most:
                    raise ValueError(f"an array of {size} elements, more than {most}")
                row = batch.slice(i, 1)
                for orders in batched(arrangements(range(size)), 1000):
                    at = pa.array([j for order in orders for j in order], pa.int64())
                    ends = pa.array(range(0, size * len(orders) + 1, size) if size else [0] * (len(orders) + 1), pa.int32())
                    made = pa.ListArray.from_arrays(ends, values.values.take(at))
                    rows = row.take(pa.array([0] * len(orders), pa.int64()))
                    if out in rows.schema.names:
                        rows = rows.drop_columns([out])
                    yield pa.RecordBatch.from_arrays([*rows.columns, made], [*rows.schema.names, out])

    fields = [*[f for f in df.schema if f.name != out], T.StructField(out, kind)]
    return df.mapInArrow(run, T.StructType(fields))


def busiest(df: DataFrame, by: list[str], order: list[str], arrival: str, load: str, servers: int) -> DataFrame:
    """``(*by, server, n)`` of the servers that took most requests: request ``i`` goes to server ``i`` modulo their number or the next
    free one, and is dropped when none is free.  A group is simulated in order by one task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        until, n = [float("-inf")] * servers, [0] * servers
        for i, (t, w) in enumerate(zip(pdf[arrival], pdf[load], strict=True)):
            for k in range(servers):
                s = (i + k) % servers
                if until[s] <= t:
                    until[s], n[s] = t + w, n[s] + 1
                    break
        top = [s for s in range(servers) if n[s] == max(n)]
        return pd.DataFrame({**{b: [k] * len(top) for b, k in zip(by, key, strict=True)}, "server": top, "n": [n[s] for s in top]})

    keys = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    return df.groupBy(*by).applyInPandas(run, f"{keys}, server bigint, n bigint")


# ---- trees as text


def encode_tree(children: dict, root: str, null: str = "#", sep: str = "\x1f") -> str:
    """A binary tree ``{node: (left, right)}`` in preorder, with a mark for missing children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(null if node is None else node)
        if node is not None:
            left, right = children.get(node, (None, None))
            todo += [right, left]
    return sep.join(out)


def tree_depth(encoding: Column, null: str = "#", sep: str = "\x1f") -> Column:
    """The depth of an encoded tree."""

    def depth(text: str) -> int:
        best, open_at = 0, [1]
        for x in text.split(sep):
            level = open_at.pop()
            if x != null:
                best = max(best, level)
                open_at += [level + 1, level + 1]
        return best

    return _each(depth, T.LongType())(encoding)
