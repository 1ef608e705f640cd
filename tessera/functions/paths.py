"""Plain forms of file paths."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain_segments(path: str) -> list[str]:
    """The segments of a path in NFC: either separator, no ``.`` or empty segments, ``..`` resolved, drive letters in lower case.

    A ``..`` above the first segment is kept, so that such a path lies below no root.
    """
    out: list[str] = []
    for segment in unicodedata.normalize("NFC", path).replace("\\", "/").split("/"):
        if segment in ("", "."):
            continue
        if segment == ".." and out and out[-1] != "..":
            out.pop()
            continue
        out.append(segment)
    if out and len(out[0]) == 2 and out[0][1] == ":" and out[0][0].isalpha():
        out[0] = out[0].lower()
    return out


def below(path: str | None, root: str | None) -> str | None:
    """The path below ``root`` joined by ``/``; null where the path is not strictly below it."""
    if path is None or root is None:
        return None
    segments, top = plain_segments(path), plain_segments(root)
    if len(segments) <= len(top) or segments[: len(top)] != top:
        return None
    return "/".join(segments[len(top) :])


def _below(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for path, root in batches:
        yield pd.Series([below(p, r) for p, r in zip(path, root, strict=True)], dtype=object)


def path_below(path: str, root: str) -> Column:
    """Column form of :func:`below` (Unicode forms have no built-in expression)."""
    return F.pandas_udf(_below, T.StringType())(path, root)


def plain_path(path: Column) -> Column:
    """Path with ``/`` between its segments, without ``.`` or empty ones; stays in built-in expressions."""
    segments = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.filter(segments, lambda s: ~s.isin("", ".")), "/")
