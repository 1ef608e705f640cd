"""String functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- tests


def starts_with_any(s: Column, targets: list[str]) -> Column:
    return _any([s.startswith(t) for t in targets])


def ends_with_any(s: Column, targets: list[str]) -> Column:
    return _any([s.endswith(t) for t in targets])


def contains_any(s: Column, targets: list[str], ignore_empty: bool = True) -> Column:
    return _any([s.contains(t) for t in targets if t or not ignore_empty])


def contains_all(s: Column, targets: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [s.contains(t) for t in targets], F.lit(True))


def contains_any_all(s: Column, groups: list[list[str]]) -> Column:
    """One of the groups is there in full."""
    return _any([contains_all(s, g) for g in groups])


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def whole_word(word: str, ignore_case: bool = False, extra: str = "_") -> str:
    """A pattern for the word between ends, blanks, punctuation or the ``extra`` characters."""
    side = rf"[^\p{{L}}\p{{N}}_]|[{re.escape(extra)}]" if extra else r"[^\p{L}\p{N}_]"
    return f"{'(?i)' if ignore_case else ''}(?:^|(?<={side})){_quote(word)}(?:$|(?={side}))"


def _quote(text: str) -> str:
    return re.sub(r"([\\.^$*+?()\[\]{}|&~#\-])", r"\\\1", text)


def contains_whole_word(s: Column, word: str, ignore_case: bool = False, extra: str = "_") -> Column:
    return s.rlike(whole_word(word, ignore_case, extra))


def contains_between_spaces(s: Column, word: str) -> Column:
    """The word stands between spaces or the ends."""
    return F.concat(F.lit(" "), s, F.lit(" ")).contains(f" {word} ")


# ---- positions and cuts


def find_all(s: Column, target: str) -> Column:
    """All start positions (from 0), overlapping ones too."""
    n = len(target)
    last = F.char_length(s) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.substring(s, i + 1, F.lit(n)) == target)


def cut_before_first(s: Column, target: str, keep: bool = True, strip: bool = True, empty_if_absent: bool = False) -> Column:
    """What follows the first target (with it, if kept)."""
    at = F.instr(s, target)
    rest = F.substring(s, at + (0 if keep else len(target)), F.char_length(s))
    return F.when(at > 0, F.ltrim(rest) if strip else rest).otherwise(F.lit("") if empty_if_absent else s)


def cut_after_last(s: Column, target: str, keep: bool = False, strip: bool = True, empty_if_absent: bool = False) -> Column:
    """What precedes the last target (with it, if kept)."""
    tail = F.char_length(F.substring_index(s, target, -1))
    head = F.substring(s, F.lit(1), F.char_length(s) - tail - (0 if keep else len(target)))
    return F.when(F.instr(s, target) > 0, F.rtrim(head) if strip else head).otherwise(F.lit("") if empty_if_absent else s)


def extract_between(s: Column, start: str, end: str, keep_start: bool = False, keep_end: bool = False, start_optional: bool = False, end_optional: bool = False) -> Column:
    """The text from the first ``start`` to the next ``end``; null where a marker is missing, unless it is optional."""
    a = F.instr(s, start)
    begin = F.when(a > 0, a + len(start)).when(F.lit(start_optional), 1)
    rest = F.substring(s, begin, F.char_length(s))
    b = F.instr(rest, end)
    body = F.when(b > 0, F.substring(rest, F.lit(1), b - 1 + (len(end) if keep_end else 0))).when(F.lit(end_optional), rest)
    return F.concat(F.when((a > 0) & F.lit(keep_start), start).otherwise(""), body)


def extract_all_between(s: Column, start: str, end: str) -> Column:
    """All shortest texts between the markers."""
    return F.regexp_extract_all(s, F.lit(f"(?s){_quote(start)}(.*?){_quote(end)}"), F.lit(1))


def remove_first_line(s: Column, empty_if_single: bool = True) -> Column:
    return F.when(F.instr(s, "\n") > 0, F.ltrim(F.regexp_replace(s, r"^[^\n]*\n", ""))).otherwise(F.lit("") if empty_if_single else s)


def remove_last_line(s: Column, empty_if_single: bool = True) -> Column:
    return F.when(F.instr(s, "\n") > 0, F.rtrim(F.regexp_replace(s, r"\n[^\n]*$", ""))).otherwise(F.lit("") if empty_if_single else s)


# ---- splitting and joining


def split_first(s: Column, sep: str) -> Column:
    """In two at the first separator: an array of one or two."""
    return F.split(s, _quote(sep), 2)


def split_last(s: Column, sep: str) -> Column:
    tail = F.substring_index(s, sep, -1)
    head = F.substring(s, F.lit(1), F.char_length(s) - F.char_length(tail) - len(sep))
    return F.when(F.instr(s, sep) > 0, F.array(head, tail)).otherwise(F.array(s))


def split_any(s: Column, seps: list[str], most: int = -1, strip: bool = False, drop_empty: bool = False, pad_to: int | None = None, pad: str | None = None) -> Column:
    """Split at any of the separators, optionally stripped, without empty parts, or padded to a length."""
    parts = F.split(s, "|".join(map(_quote, sorted(seps, key=len, reverse=True))), most)
    if strip:
        parts = F.transform(parts, lambda p: F.trim(p))
    if drop_empty:
        parts = F.filter(parts, lambda p: p != "")
    if pad_to is not None:
        filler = F.lit(pad).cast("string") if pad is not None else F.element_at(parts, -1)
        parts = F.concat(parts, F.array_repeat(filler, F.greatest(F.lit(0), F.lit(pad_to) - F.size(parts))))
    return parts


def join(parts: list[Column], sep: str = "", last_sep: str | None = None) -> Column:
    """Join what is neither null nor empty, the last two by ``last_sep``."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    if last_sep is None:
        return F.array_join(kept, sep)
    n = F.size(kept)
    head = F.array_join(F.slice(kept, F.lit(1), F.greatest(n - 1, F.lit(0))), sep)
    return F.when(n >= 2, F.concat(head, F.lit(last_sep), F.element_at(kept, -1))).otherwise(F.array_join(kept, sep))


# ---- regular expressions


def extract_all(s: Column, pattern: str, start: int = 0) -> Column:
    """All matches, from a position (from 0) on."""
    return F.regexp_extract_all(F.substring(s, start + 1, 2**31 - 1), F.lit(pattern), F.lit(0))


def last_match(s: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.lit(-1))


def extract_groups(s: Column, pattern: str) -> Column:
    """For each match the array of its groups."""
    n = re.compile(pattern).groups
    groups = [F.regexp_extract_all(s, F.lit(pattern), F.lit(k)) for k in range(1, n + 1)]
    return F.transform(F.arrays_zip(*groups), lambda m: F.array(*[m[str(k)] for k in range(n)]))


def replace_first(s: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(s, f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{_literal(to)}${re.compile(pattern).groups + 2}")


def replace_last(s: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(s, f"(?s)^(.*)(?:{pattern})", f"$1{_literal(to)}")


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def remove_all(s: Column, *patterns: str) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, s)


def replace_whole_word(s: Column, old: str, new: str) -> Column:
    return F.regexp_replace(s, whole_word(old, extra="_\"'"), _literal(new))


def remove_whole_word(s: Column, word: str, space_after: bool = False) -> Column:
    return F.regexp_replace(s, whole_word(word, extra="_\"'") + (" ?" if space_after else ""), "")


# ---- prefixes and suffixes


def add_prefix(s: Column, prefix: str, sep: str = "_", once: bool = False) -> Column:
    full = F.concat(F.lit(prefix + sep), s)
    return F.when(s.startswith(prefix + sep), s).otherwise(full) if once else full


def add_suffix(s: Column, suffix: str, sep: str = "_", once: bool = False) -> Column:
    full = F.concat(s, F.lit(sep + suffix))
    return F.when(s.endswith(sep + suffix), s).otherwise(full) if once else full


def remove_any_prefix(s: Column, prefixes: list[str]) -> Column:
    """Without the first of the prefixes that it has."""
    return F.regexp_replace(s, f"^(?:{'|'.join(map(_quote, prefixes))})", "")


def remove_any_suffix(s: Column, suffixes: list[str]) -> Column:
    return F.regexp_replace(s, f"(?:{'|'.join(map(_quote, suffixes))})$", "")


def replace_prefix(s: Column, old: str, new: str, sep: str = "_") -> Column:
    return F.regexp_replace(s, f"^{_quote(old + sep)}", _literal(new + sep if new else ""))


def replace_suffix(s: Column, old: str, new: str, sep: str = "_") -> Column:
    return F.regexp_replace(s, f"{_quote(sep + old)}$", _literal(sep + new if new else ""))


def remove_affixes(s: Column, prefixes: list[str] = (), suffixes: list[str] = (), sep: str = " ") -> Column:
    """Without the longest prefix and the longest suffix, each cut off by the separator."""
    longest = lambda xs: "|".join(map(_quote, sorted(xs, key=len, reverse=True)))
    if prefixes:
        s = F.regexp_replace(s, f"^(?:{longest(prefixes)}){_quote(sep)}", "")
    return F.regexp_replace(s, f"{_quote(sep)}(?:{longest(suffixes)})$", "") if suffixes else s


def remove_prefix_tokens(s: Column, tokens: list[str]) -> Column:
    """Without any of the tokens at the head, again and again."""
    return F.regexp_replace(s, rf"^(?:(?:{'|'.join(map(_quote, tokens))})(?:\s+|$))+", "")


def remove_suffix_tokens(s: Column, tokens: list[str]) -> Column:
    return F.regexp_replace(s, rf"(?:(?:^|\s+)(?:{'|'.join(map(_quote, tokens))}))+$", "")


def remove_shared_prefix(columns: list[Column], prefixes: list[str], sep: str = " ") -> list[Column]:
    """Without the first prefix that all the strings of a row share."""
    return _shared(columns, [p + sep for p in prefixes], "startswith", lambda c, p: F.substring(c, len(p) + 1, 2**31 - 1))


def remove_shared_suffix(columns: list[Column], suffixes: list[str], sep: str = " ") -> list[Column]:
    return _shared(columns, [sep + x for x in suffixes], "endswith", lambda c, p: F.substring(c, F.lit(1), F.char_length(c) - len(p)))


def _shared(columns: list[Column], affixes: list[str], test: str, cut) -> list[Column]:
    out = []
    for c in columns:
        value = c
        for p in reversed(affixes):
            value = F.when(reduce(lambda a, b: a & b, [getattr(x, test)(p) for x in columns]), cut(c, p)).otherwise(value)
        out.append(value)
    return out


# ---- letters, case, names


def count_upper(s: Column) -> Column:
    return F.char_length(F.regexp_replace(s, r"\P{Lu}", ""))


def count_lower(s: Column) -> Column:
    return F.char_length(F.regexp_replace(s, r"\P{Ll}", ""))


def camel_to_snake(s: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"(.)(\p{Lu}\p{Ll}+)", "$1_$2"), r"([\p{Ll}\d])(\p{Lu})", "$1_$2"))


def snake_to_camel(s: Column) -> Column:
    return F.regexp_replace(F.initcap(F.translate(s, "_", " ")), " ", "")


def domain_of(name: Column, sep: str = ".") -> Column:
    return F.substring_index(name, sep, 1)


def trailing_brackets(s: Column) -> Column:
    """The bracketed parts at the end, in order."""
    return F.regexp_extract_all(F.regexp_extract(s, r"((?:\s*(?:\([^()]*\)|\[[^\[\]]*\]))+)\s*$", 1), F.lit(r"\([^()]*\)|\[[^\[\]]*\]"), F.lit(0))


def without_trailing_brackets(s: Column) -> Column:
    return F.regexp_replace(s, r"(?:\s*(?:\([^()]*\)|\[[^\[\]]*\]))+\s*$", "")


def add_to_numbers(s: Column, by: int = 1, which: str = "last") -> Column:
    """Add to the ``first``, ``last`` or ``all`` of the numbers in a string."""
    pieces = F.split(F.regexp_replace(s, r"(\d+)", "\u0001$1\u0001"), "\u0001")
    n = F.size(pieces)

    def changed(p: Column, i: Column) -> Column:
        number = (p.try_cast("bigint") + by).cast("string")
        hit = {"all": F.lit(True), "first": i == 1, "last": i == n - 2}[which]
        return F.when((i % 2 == 1) & hit, number).otherwise(p)

    return F.array_join(F.transform(pieces, changed), "")


def next_number(s: Column) -> Column:
    """The trailing number of a name plus one."""
    return F.regexp_extract(s, r"(\d+)$", 1).try_cast("bigint") + 1


def spaced_key(key: Column, space: str | None = None, suffix: str | None = None, sep: str = "/") -> Column:
    return F.concat_ws(sep, F.lit(space), key, F.lit(suffix))


def split_spaced_key(key: Column, sep: str = "/", default: str | None = None) -> Column:
    """``struct<space, item>``; a key without separator is a space with the default item."""
    space = F.substring_index(key, sep, -1)
    head = F.substring(key, F.lit(1), F.char_length(key) - F.char_length(space) - len(sep))
    both = F.instr(key, sep) > 0
    return F.struct(F.when(both, head).otherwise(key).alias("space"), F.when(both, space).otherwise(F.lit(default)).alias("item"))


# ---- markup and templates


def unescape_xml(s: Column) -> Column:
    # fixed values: the five entities, the ampersand last
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def xml_element(tag: str, content: Column, sep: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}>{sep}"), content, F.lit(f"{sep}</{tag}>"))


def unwrap_xml(s: Column) -> Column:
    """The content of the outermost element."""
    return F.regexp_replace(F.regexp_replace(F.trim(s), r"^<[^>]*>\s*", ""), r"\s*</[^>]*>$", "")


def strip_tags(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[^>]*>", " "), r"(?U)\s+", " "))


_HOLES = {"brace": r"\{(\w+)\}", "double_brace": r"\{\{\s*(\w+)\s*\}\}", "dollar": r"\$\{?(\w+)\}?"}


def template_names(template: str, style: str = "brace") -> list[str]:
    return list(dict.fromkeys(re.findall(_HOLES[style], template)))


def render(template: str, columns: list[str], style: str = "brace", safe: bool = False) -> Column:
    """A template filled from the columns of that name; a hole without a column is an error, or is left with ``safe``."""
    if (missing := set(template_names(template, style)) - set(columns)) and not safe:
        raise ValueError(f"the table has no columns {sorted(missing)}")
    parts, at = [], 0
    for m in re.finditer(_HOLES[style], template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(F.col(m[1]).cast("string"), F.lit("")) if m[1] in columns else F.lit(m[0]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def key_value(key: Column, value: Column, style: str = "yaml") -> Column:
    if style == "xml":
        return F.concat(F.lit("<"), key, F.lit(">"), value, F.lit("</"), key, F.lit(">"))
    if style == "json":
        return F.to_json(F.create_map(key, value))
    return F.concat(key, F.lit(": "), value)


def function_names(calls: Column) -> Column:
    """The names called in a text such as ``a.f(1); g(h(2))``, in order."""
    return F.regexp_extract_all(calls, F.lit(r"([A-Za-z_][\w.]*)\s*\("), F.lit(1))
