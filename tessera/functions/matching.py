"""Distances of strings with weights, spelling by sound, protected regions and other matching of strings."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import normalized_edit_distance

# ---- spelling by sound

# What is replaced by what, one after the other, so that spellings that sound alike in English fall together.
SOUNDS = {
    "the": "de", "ich": "ik", "key": "ki", "ore": "or", "sch": "sc", "syd": "si", "buy": "bai", "guy": "gai", "kro": "kra", "cro": "kra", "lob": "lab", "cha": "tra", "che": "tre",
    "ah": "a", "ar": "a", "gh": "g", "ee": "i", "kw": "w", "nn": "n", "ng": "n", "kn": "n", "or": "o", "sp": "p", "ze": "s", "ce": "s", "sh": "s", "oo": "u", "ho": "fo", "en": "in",
    "em": "in", "ev": "iv", "ga": "ka", "ro": "no", "ci": "si", "e": "a", "p": "b", "t": "d", "v": "f", "y": "i", "c": "k", "g": "k", "q": "k", "m": "n", "l": "n", "x": "s", "z": "s",
}


def by_sound(s: Column, table: dict[str, str] | None = None) -> Column:
    """A string in a spelling by sound: every entry of the table replaced throughout, in the table's order."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), (SOUNDS if table is None else table).items(), s)


# ---- weighted distances


@dataclass(frozen=True)
class Conflict:
    """Strings of which one holds any of ``first`` and the other any of ``second`` at its end (or start), and neither any of both, are
    ``weight`` times as far apart.  With ``within`` they may stand anywhere in so many characters of that end."""

    first: tuple[str, ...]
    second: tuple[str, ...]
    weight: float
    within: int | None = None


@dataclass(frozen=True)
class Weights:
    """How a normalised edit distance of ``a`` and ``b`` is weighted.  A weight that is not given does not apply.

    * ``free_if_empty``: sides (``"a"``, ``"b"``) whose being empty makes no distance.  ``least``, ``least_a``, ``least_b``: no distance
      where both, or that side, are shorter.
    * ``start``: a common start of ``start_size`` characters, blanks aside, of strings neither of which holds the other: in proportion
      to how similar the starts are, above ``start_similarity`` and with ``start_equal`` first characters equal; fully, and for equal
      starts only, where ``start_similarity`` is null.
    * ``heads`` / ``inside`` / ``token``: by side, the first that holds: the side begins the other, stands in it, its first token does.
      Not below ``inside_size`` characters.
    * ``starts``, ``ends``: conflicts, the first that holds in either order.
    * ``short``: both have at most ``short_size`` characters, and the same first one with ``short_same_start``.
    """

    free_if_empty: tuple[str, ...] = ()
    least: int = 0
    least_a: int = 0
    least_b: int = 0
    start: float | None = None
    start_size: int = 3
    start_equal: int = 2
    start_similarity: float | None = 0.55
    heads: tuple[float | None, float | None] = (None, None)
    inside: tuple[float | None, float | None] = (None, None)
    token: tuple[float | None, float | None] = (None, None)
    inside_size: int = 3
    starts: tuple[Conflict, ...] = ()
    ends: tuple[Conflict, ...] = ()
    short: float | None = None
    short_size: int = 3
    short_same_start: bool = True


def _conflict(a: Column, b: Column, conflicts: tuple[Conflict, ...], at_start: bool) -> Column:
    def holds(s: Column, words: tuple[str, ...], c: Conflict) -> Column:
        n = max([c.within or 0, *map(len, c.first + c.second)])
        part = F.substring(s, 1, n) if at_start else F.right(s, F.lit(n))
        tests = [part.contains(w) if c.within is not None else s.startswith(w) if at_start else s.endswith(w) for w in words]
        return reduce(lambda x, y: x | y, tests)

    def one_way(x: Column, y: Column, c: Conflict) -> Column:
        return holds(x, c.first, c) & ~holds(y, c.first, c) & holds(y, c.second, c) & ~holds(x, c.second, c)

    out = F.lit(1.0)
    for x, y in ((b, a), (a, b)):
        for c in reversed(conflicts):
            out = F.when(one_way(x, y, c), c.weight).otherwise(out)
    return out


def weighted_distance(a: Column, b: Column, weights: Weights) -> Column:
    """The normalised edit distance under :class:`Weights`; null if a string is."""
    w, len_a, len_b = weights, F.char_length(a), F.char_length(b)
    factor = F.lit(1.0)
    if w.start is not None:
        head = lambda s: F.substring(F.replace(s, F.lit(" "), F.lit("")), 1, w.start_size)
        apart = ~a.contains(b) & ~b.contains(a) & (len_a > w.start_size) & (len_b > w.start_size)
        if w.start_similarity is None:
            factor = factor * F.when(apart & (head(a) == head(b)), w.start).otherwise(1.0)
        else:
            alike = 1 - normalized_edit_distance(head(a), head(b))
            near = apart & (F.substring(a, 1, w.start_equal) == F.substring(b, 1, w.start_equal)) & (alike > w.start_similarity)
            factor = factor * F.when(near, 1 - (1 - w.start) * alike).otherwise(1.0)
    for k, (x, y) in enumerate(((a, b), (b, a))):
        first = F.regexp_extract(x, r"^\s*(\S*)", 1)
        cases = [(w.heads[k], y.startswith(x)), (w.inside[k], y.contains(x)), (w.token[k], (F.char_length(first) >= w.inside_size) & y.contains(first))]
        chosen = F.lit(1.0)
        for weight, test in reversed(cases):
            if weight is not None:
                chosen = F.when(test, weight).otherwise(chosen)
        factor = factor * F.when(F.least(len_a, len_b) >= w.inside_size, chosen).otherwise(1.0)
    factor = factor * _conflict(a, b, w.starts, True) * _conflict(a, b, w.ends, False)
    if w.short is not None:
        test = (len_a <= w.short_size) & (len_b <= w.short_size)
        factor = factor * F.when(test & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) if w.short_same_start else test, w.short).otherwise(1.0)
    too_short = ((len_a < w.least) & (len_b < w.least)) | (len_a < w.least_a) | (len_b < w.least_b)
    empty = lambda side: F.lit(0.0 if side in w.free_if_empty else 1.0)
    known = a.isNotNull() & b.isNotNull()
    return F.when(known & (len_a == 0) & (len_b == 0), 0.0).when(known & (len_a == 0), empty("a")).when(known & (len_b == 0), empty("b")).when(known & too_short, 0.0).when(known, normalized_edit_distance(a, b) * factor)


def without_shared_tokens(a: Column, b: Column, keep_parts: bool = False) -> tuple[Column, Column]:
    """Both strings without the tokens they share; with ``keep_parts`` but for those that are part of another token of either."""
    x, y = F.split(a, r"(?U)\s+"), F.split(b, r"(?U)\s+")
    shared = F.array_intersect(x, y)
    if keep_parts:
        other = F.array_distinct(F.concat(x, y))
        shared = F.filter(shared, lambda t: ~F.exists(other, lambda o: (o != t) & o.contains(t)))
    left = lambda w: F.array_join(F.filter(w, lambda t: ~F.array_contains(shared, t)), " ")
    return left(x), left(y)


# ---- markers, groups, protected regions


def strip(s: Column, left: bool = True, right: bool = True, chars: str | None = None) -> Column:
    """Without blanks, or the given characters, at the chosen ends."""
    trim = F.lit(chars) if chars is not None else None
    s = F.ltrim(s, trim) if left and trim is not None else F.regexp_replace(s, r"(?U)^\s+", "") if left else s
    return F.rtrim(s, trim) if right and trim is not None else F.regexp_replace(s, r"(?U)\s+$", "") if right else s


def index_pair(s: Column, first: str, second: str, start: int = 0, fallback: str | None = None) -> Column:
    """``struct<start, stop>``: where the first marker ends and the next second one begins (from 0).  Where a marker is missing: null,
    the end of the string (``end``), or an empty range (``empty``; at the end without the first)."""
    n = F.char_length(s)
    at = F.locate(first, s, start + 1)
    begin = F.when(at > 0, at - 1 + len(first))
    after = F.call_function("locate", F.lit(second), s, F.coalesce(begin, n) + 1)
    if fallback is None:
        return F.when((at > 0) & (after > 0), F.struct(begin.alias("start"), (after - 1).alias("stop")))
    missing = n if fallback == "end" else F.coalesce(begin, n)
    return F.when(s.isNotNull(), F.struct(F.coalesce(begin, n).alias("start"), F.when((at > 0) & (after > 0), after - 1).otherwise(missing).alias("stop")))


def tail_pattern(pattern: str) -> str:
    """A pattern that hits the last place only where another does."""
    return rf"{pattern}(?!.*{pattern})"


def matched_groups(s: Column, pattern: str, first: int = 0, start: int = 0) -> Column:
    """The numbers (from 0, of the groups from ``first`` on) of a pattern's alternatives that hit the string, ascending."""
    rest = F.substring(s, start + 1, 2**31 - 1)
    hits = [F.when(F.exists(F.regexp_extract_all(rest, F.lit(pattern), F.lit(k + 1)), lambda x: x != ""), k - first) for k in range(first, re.compile(pattern).groups)]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


_MASK = ""


def protected(s: Column, pattern: str, f: Callable[[Column], Column], restore: int = 0) -> Column:
    """``f`` of a string in which the hits of a pattern are masked by one character each; then they come back, in order, as their
    ``restore``-th group (0 for all of it).  ``f`` must keep the masks and their order."""
    hits = F.regexp_extract_all(s, F.lit(pattern), F.lit(restore))
    pieces = F.split(f(F.regexp_replace(s, pattern, _MASK)), _MASK)
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, F.coalesce(F.get(hits, i - 1), F.lit(""))).otherwise(""), p)), "")


def random_string(n: int, seed: int | None = None) -> Column:
    """A random string of letters and digits."""
    return F.randstr(n) if seed is None else F.randstr(n, seed)
