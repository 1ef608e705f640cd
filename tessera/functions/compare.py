"""Comparison directives: a pattern with leading marks that say how it is compared."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the marks
CONTAINS, STARTS, ENDS, LOWER, HIGHER, REGEX, ANY_CASE, NULL_PASSES, NEGATE = "*", "^", "$", "<", ">", "@", "/", "?", "!~"


@dataclass(frozen=True)
class Directive:
    pattern: str
    method: str = "exact"
    regex: bool = False
    any_case: bool = False
    null_passes: bool = False
    negated: bool = False

    def column(self, source: Column) -> Column:
        """The comparison; a null source gives ``null_passes``, which is never negated."""
        p, s = self.pattern, source
        if self.regex:
            if self.method in ("lower", "higher"):
                raise ValueError("a regular expression has no order")
            body = {"exact": f"^(?:{p})\\z", "starts": f"^(?:{p})", "ends": f"(?:{p})$", "contains": p}[self.method]
            result = s.rlike(("(?iU)" if self.any_case else "(?U)") + body)
        else:
            if self.any_case:
                s, p = F.lower(s), p.lower()
            result = {
                "exact": lambda: s == p, "contains": lambda: s.contains(p), "starts": lambda: s.startswith(p),
                "ends": lambda: s.endswith(p), "lower": lambda: s < p, "higher": lambda: s > p,
            }[self.method]()
        return F.coalesce(~result if self.negated else result, F.lit(self.null_passes))


def parse(text: str, separator: str = " ") -> Directive:
    """Read the marks before the pattern: each negation toggles, the last method counts, one separator may follow the marks.

    A pattern that is no valid regular expression is compared as plain text.
    """
    methods = {CONTAINS: "contains", STARTS: "starts", ENDS: "ends", LOWER: "lower", HIGHER: "higher"}
    method, regex, any_case, null_passes, negated, at = "exact", False, False, False, False, 0
    for at, c in enumerate(text + "\0"):  # noqa: B007
        if c in NEGATE:
            negated = not negated
        elif c in methods:
            method = methods[c]
        elif c == REGEX:
            regex = True
        elif c == ANY_CASE:
            any_case = True
        elif c == NULL_PASSES:
            null_passes = True
        else:
            break
    rest = text[at:]
    if at and rest.startswith(separator):
        rest = rest[len(separator) :]
    if regex:
        try:
            re.compile(rest)
        except re.error:
            regex = False
    return Directive(rest, method, regex, any_case, null_passes, negated)


def matches(source: Column, directive: str) -> Column:
    """Compare by a directive, e.g. ``!*/error`` (does not contain, any case)."""
    return parse(directive).column(source)
