"""Tokens, stems, edit distance, punctuation and the detection of changing content, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- tokens and stems

_BLANKS = r"(?U)\s+"


def tokens(text: Column, stem: bool = False) -> Column:
    """Lower-case words: split at blanks, everything but letters and digits deleted, empty ones left out."""
    # one pass over the text: deleting before the split gives the same words as deleting within each
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}\s]+", ""), _BLANKS), lambda w: w != "")
    return stems(words) if stem else words


def plain_tokens(text: Column) -> Column:
    """Lower-case words as they stand between blanks, punctuation kept."""
    return F.filter(F.split(F.lower(text), _BLANKS), lambda w: w != "")


# Porter's suffix stripping (M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980).  A word is [C](VC){m}[V].
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1 = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}{_V}{_C}"  # m > 0, m > 1
_IS_1 = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"  # m = 1
_VOWEL = f"^(?:{_C})?[aeiouy]"  # *v*
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"  # *o, of a stem with m = 1

# The suffixes of the paper's steps 2, 3 and 4, and what they become.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stems(words: Column) -> Column:
    """The Porter stems of an array of lower-case words.  Words of one or two letters, and those that are not all ``a`` to ``z``,
    stay as they are."""
    # one pass over the array per step: within a pass a word is bound once, so the expression stays small
    only_words = lambda step: lambda w: F.when(w.rlike("^[a-z]{3,}$"), step(w)).otherwise(w)
    steps = _plurals, _participles, _final_y, _replaced(_STEP_2, _M0), _replaced(_STEP_3, _M0), _stripped, _final_e
    return reduce(lambda all_words, step: F.transform(all_words, only_words(step)), steps, words)


def stem_word(word: Column) -> Column:
    """The Porter stem of one lower-case word; see :func:`stems`."""
    return F.element_at(stems(F.array(word)), 1)


def _head(word: Column, cut: int) -> Column:
    return F.substring(word, F.lit(1), F.char_length(word) - cut)


def _plurals(w: Column) -> Column:  # step 1a
    return F.when(w.rlike("(?:ss|i)es$"), _head(w, 2)).when(w.rlike("[^s]s$"), _head(w, 1)).otherwise(w)


def _participles(w: Column) -> Column:  # step 1b
    cut = F.regexp_replace(w, "(?:ed|ing)$", "")
    mended = F.when(cut.rlike("(?:at|bl|iz)$") | cut.rlike(_CVC), F.concat(cut, F.lit("e"))).when(cut.rlike(r"([^aeiouylsz])\1$"), _head(cut, 1)).otherwise(cut)
    return F.when(w.endswith("eed"), F.when(_head(w, 3).rlike(_M0), _head(w, 1)).otherwise(w)).when(w.rlike("(?:ed|ing)$") & cut.rlike(_VOWEL), mended).otherwise(w)


def _final_y(w: Column) -> Column:  # step 1c
    return F.when(w.endswith("y") & _head(w, 1).rlike(_VOWEL), F.concat(_head(w, 1), F.lit("i"))).otherwise(w)


def _replaced(table: dict[str, str], measure: str) -> Callable[[Column], Column]:  # steps 2 and 3
    # the leftmost match of suffixes at the end is the longest one
    pattern = f"({'|'.join(table)})$"
    new = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def step(w: Column) -> Column:
        stem, suffix = F.regexp_replace(w, pattern, ""), F.regexp_extract(w, pattern, 1)
        return F.when((suffix != "") & stem.rlike(measure), F.concat(stem, F.try_element_at(new, suffix))).otherwise(w)

    return step


def _stripped(w: Column) -> Column:  # step 4
    pattern = f"(?:{'|'.join(_STEP_4)})$"
    stem = F.regexp_replace(w, pattern, "")
    return F.when(w.rlike(pattern) & stem.rlike(_M1) & (~w.endswith("ion") | stem.rlike("[st]$")), stem).otherwise(w)


def _final_e(w: Column) -> Column:  # step 5
    stem = _head(w, 1)
    without = F.when(w.endswith("e") & (stem.rlike(_M1) | (stem.rlike(_IS_1) & ~stem.rlike(_CVC))), stem).otherwise(w)
    return F.when(without.endswith("ll") & without.rlike(_M1), _head(without, 1)).otherwise(without)


def overlap_tokens(a: Column, b: Column) -> Column:
    """How many different blank-separated tokens two strings share."""
    return F.size(F.array_intersect(F.split(a, _BLANKS), F.split(b, _BLANKS)))


def equal_in_tokens(a: Column, b: Column) -> Column:
    """Equal, or equal as bags of blank-separated tokens."""
    return (a == b) | (F.array_sort(F.split(F.trim(a), _BLANKS)) == F.array_sort(F.split(F.trim(b), _BLANKS)))


def common_tokens_removed(a: Column, b: Column) -> Column:
    """``a`` without the tokens it shares with ``b``, in order."""
    other = F.split(b, _BLANKS)
    return F.array_join(F.filter(F.split(a, _BLANKS), lambda t: ~F.array_contains(other, t)), " ")


# ---- edit distance


def normalized_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty strings."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def edit_similarity(a: Column, b: Column, sorted_tokens: bool = False, prepare: Callable[[Column], Column] | None = None) -> Column:
    """1 - normalised edit distance, after ``prepare``; with ``sorted_tokens`` the better of the strings as they stand and with
    their tokens in order."""
    if prepare:
        a, b = prepare(a), prepare(b)
    plain = 1 - normalized_edit_distance(a, b)
    if not sorted_tokens:
        return plain
    in_order = lambda s: F.array_join(F.array_sort(F.split(F.trim(s), _BLANKS)), " ")
    return F.greatest(plain, 1 - normalized_edit_distance(in_order(a), in_order(b)))


# ---- punctuation and sanitising

_PUNCT = r"!-/:-@\[-`{-~"


def remove_punctuation(text: Column, keep: str = "") -> Column:
    """Without ASCII punctuation but for ``keep``; blanks collapsed and trimmed."""
    kept = f"(?![{''.join(chr(92) + c for c in keep)}])" if keep else ""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"{kept}[{_PUNCT}]", " "), _BLANKS, " "))


def contains_punctuation(text: Column, exclude: str = "") -> Column:
    kept = f"(?![{''.join(chr(92) + c for c in exclude)}])" if exclude else ""
    return text.rlike(f"{kept}[{_PUNCT}]")


def remove_acronym_periods(text: Column) -> Column:
    """``c. n. n.`` and ``c.n.n.`` become ``cnn``."""
    marked = F.regexp_replace(text, r"(?<![\p{L}\p{N}])(\p{L})\.\s*(?=\p{L}\.)", "$1")
    return F.regexp_replace(marked, r"(?<![\p{L}\p{N}])(\p{L}{2,})\.(?!\p{L})", "$1")


def remove_accents(text: Column) -> Column:
    """Latin letters without their diacritics (precomposed forms)."""
    # fixed values: letters with diacritics, and what they are without
    with_marks = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
    without = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
    return F.translate(F.regexp_replace(text, r"\p{Mn}", ""), with_marks, without)


SANITIZERS: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "trim": F.trim,
    "collapse_blanks": lambda s: F.trim(F.regexp_replace(s, _BLANKS, " ")),
    "no_blanks": lambda s: F.regexp_replace(s, _BLANKS, ""),
    "no_punctuation": remove_punctuation,
    "no_punctuation_but_hyphen": lambda s: remove_punctuation(s, "-"),
    "no_punctuation_but_hyphen_and_underscore": lambda s: remove_punctuation(s, "-_"),
    "acronyms": remove_acronym_periods,
    "no_accents": remove_accents,
    "sorted_tokens": lambda s: F.array_join(F.array_sort(F.split(F.trim(s), _BLANKS)), " "),
    "stems": lambda s: F.array_join(tokens(s, stem=True), " "),
}


def sanitize(text: Column, *steps: str) -> Column:
    """The named steps of ``SANITIZERS``, in order."""
    return reduce(lambda s, step: SANITIZERS[step](s), steps, text)


# ---- content that changes from view to view

# The names and units that make a text changing, by category, each with its forms.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
UNITS = {
    "travel_count": ["traveler", "guest", "adult", "child", "infant", "passenger", "person", "room", "night", "day", "seat", "bag"],
    "shopping_count": ["item", "product", "result", "match", "review", "rating", "star", "order", "listing"],
    "general_count": [
        "message", "notification", "comment", "reply", "like", "view", "follower", "following", "post", "photo", "video", "file", "download", "update", "hour", "minute", "second",
        "week", "month", "year",
    ],
}
#: Forms of a unit that are not the unit and the unit with ``s``.
IRREGULAR = {
    "child": ["child", "children"], "person": ["person", "persons", "people"], "bag": ["bag", "bags", "baggage"], "match": ["match", "matches"], "reply": ["reply", "replies"],
    "following": ["following"], "minute": ["minute", "minutes", "min", "mins"], "second": ["second", "seconds", "sec", "secs"],
}
SIGNS, SIGNS_WITHOUT_CENTS, CURRENCIES = ["$", "€", "£", "₹"], ["¥"], ["USD", "EUR", "GBP"]
DISTANCES = ["mi", "km", "miles", "kilometers"]

# Grammar: a number, an amount (thousands by comma), one of some words; a word pattern stands between word ends.
_NUMBER, _SHORT, _AMOUNT, _CENTS = r"\d+", r"\d{1,2}", r"\d+(?:,\d{3})*", r"\.\d{2}"


def _one_of(words: list[str]) -> str:
    import re

    return "(?:" + "|".join(map(re.escape, words)) + ")"


def _forms(*units: str) -> list[str]:
    return [form for u in units for form in IRREGULAR.get(u, [u, u + "s"])]


def _word(*parts: str) -> str:
    return r"\b" + "".join(parts) + r"\b"


def _date_patterns() -> list[str]:
    day, month = ([name[:3] for name in names] for names in (WEEKDAYS, MONTHS))
    numeric = lambda sep: _word(_SHORT, sep, _SHORT, sep, r"\d{2,4}")
    named = [_word(_one_of(names)) for names in (day, WEEKDAYS, month, MONTHS)]
    return [*named, numeric("/"), numeric("-"), _word(r"\d{4}-\d{2}-\d{2}"), numeric(r"\."), _word(_SHORT, r"\s+", _one_of(month)), _word(_one_of(month), r"\s+", _SHORT)]


def _time_patterns() -> list[str]:
    minutes, half = r":\d{2}", r"\s*(?:AM|PM)"
    return [_word(_SHORT, tail) for tail in (minutes + half, minutes + minutes, minutes, half)]


def _money_patterns() -> list[str]:
    signed = [_one_of(SIGNS) + _AMOUNT + f"(?:{_CENTS})?" + r"\b", _one_of(SIGNS_WITHOUT_CENTS) + _AMOUNT + r"\b"]
    return [*signed, _word(_AMOUNT, _CENTS), _word(_one_of(CURRENCIES), r"\s*", _AMOUNT, f"(?:{_CENTS})?")]


def _span_patterns() -> list[str]:
    return [_word(_NUMBER, r"\s*[-–—]\s*", _NUMBER), _word(_NUMBER, r"\s+to\s+", _NUMBER), _word(_NUMBER, r"\s*-\s*", _NUMBER, r"\s*", _one_of(_forms("night", "day", "hour")))]


def _share_patterns() -> list[str]:
    part = _NUMBER + r"(?:\.\d+)?"
    return [r"\b" + part + "%", _word(part, r"\s*percent"), _word(_NUMBER, r"%\s*off")]


def _relative_patterns() -> list[str]:
    soon, ago = ["min", "minute", "minutes", "hour", "hours"], ["min", "minute", "minutes", "hour", "hours", "day", "days"]
    return [
        _word(_NUMBER, r"\s*", _one_of(DISTANCES), r"\s+away"), _word(r"in\s+", _NUMBER, r"\s*", _one_of(soon)), _word(_NUMBER, r"\s*", _one_of(ago), r"\s+ago"),
        _word(r"(?:last|next)\s+", _NUMBER, r"\s*", _one_of(_forms("day", "week", "month"))),
    ]


DYNAMIC: dict[str, list[str]] = {
    "date": _date_patterns(),
    "time": _time_patterns(),
    **{category: [_word(_NUMBER, r"\s+", _one_of(_forms(u))) for u in units] for category, units in UNITS.items()},
    "currency": _money_patterns(),
    "range": _span_patterns(),
    "percentage": _share_patterns(),
    "misc": _relative_patterns(),
}


def dynamic_pattern(*categories: str) -> str:
    """One pattern for all of the categories (all there are by default); unknown ones match nothing."""
    chosen: list[str] = []
    for c in categories or DYNAMIC:
        # a count is one pattern for all units: the number is read once
        chosen += [_word(_NUMBER, r"\s+", _one_of(_forms(*UNITS[c])))] if c in UNITS else DYNAMIC.get(c, [])
    # what begins at a word boundary is tried at word boundaries only
    inner = [p.removeprefix(r"\b") for p in chosen if p.startswith(r"\b")]
    parts = [r"\b(?:" + "|".join(inner) + ")"] * bool(inner) + [p for p in chosen if not p.startswith(r"\b")]
    return "(?i)(?:" + "|".join(parts) + ")" if parts else r"[^\s\S]"


def contains_dynamic(text: Column, *categories: str) -> Column:
    return text.rlike(dynamic_pattern(*categories))


def contains_date(text: Column) -> Column:
    return contains_dynamic(text, "date")


def contains_time(text: Column) -> Column:
    return contains_dynamic(text, "time")


def contains_count_with_unit(text: Column) -> Column:
    return contains_dynamic(text, "travel_count", "shopping_count", "general_count")


def contains_currency(text: Column) -> Column:
    return contains_dynamic(text, "currency")


def contains_numeric_range(text: Column) -> Column:
    return contains_dynamic(text, "range")


def contains_percentage(text: Column) -> Column:
    return contains_dynamic(text, "percentage")


def dynamic_matches(text: Column) -> Column:
    """``array<struct<category, text>>`` of every hit of every pattern, in the order of the patterns."""
    def named(category: str) -> Callable[[Column], Column]:
        return lambda m: F.struct(F.lit(category).alias("category"), m.alias("text"))

    return F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)), named(c)) for c, patterns in DYNAMIC.items() for p in patterns])


# ---- words that agree or conflict


def has_token(text: Column, words: list[str], inflected: bool = True) -> Column:
    """Any of the words stands in the text as a word, in any of its regular endings with ``inflected``."""
    return text.rlike(token_pattern(words, inflected))


def token_pattern(words: list[str], inflected: bool = True) -> str:
    import re

    ending = "(?:s|es|ed|d|ing)?" if inflected else ""
    return r"(?iU)(?<!\w)(?:" + "|".join(r"\s*".join(map(re.escape, w.split())) for w in words) + f"){ending}(?!\\w)"


def keeps_tokens(a: Column, b: Column, words: list[str]) -> Column:
    """At least one of the words is not dropped from ``a`` to ``b``."""
    return reduce(lambda x, y: x | y, [~(has_token(a, [w]) & ~has_token(b, [w])) for w in words])


def sets_conflict(a: Column, b: Column, allow_add: bool = False, allow_drop: bool = False) -> Column:
    """The arrays, as sets, differ in more than the allowed ways: ``b`` may add to ``a``, or drop from it."""
    added, dropped = F.size(F.array_except(b, a)) > 0, F.size(F.array_except(a, b)) > 0
    if allow_add and allow_drop:
        return added & dropped & ~F.arrays_overlap(a, b)
    return dropped if allow_add else added if allow_drop else added | dropped


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def one_contains_the_other(a: Column, b: Column) -> Column:
    """One of the sets is a proper subset of the other."""
    return is_subset(a, b) != is_subset(b, a)


def numbers_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def numbers_conflict(a: Column, b: Column, allow_add: bool = False, allow_drop: bool = False) -> Column:
    return sets_conflict(numbers_in(a), numbers_in(b), allow_add, allow_drop)


def readability(text: Column, known_words: Column) -> Column:
    """The share of the text's words (cut at case changes, ``_`` and ``-``) that are in the array ``known_words``; 0 without words."""
    cut = F.regexp_replace(F.regexp_replace(text, r"([\p{Ll}\d])(\p{Lu})", "$1 $2"), r"[^\p{L}]+", " ")
    words = F.filter(F.split(F.lower(F.trim(cut)), " "), lambda w: F.char_length(w) > 1)
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.array_contains(known_words, w))), F.size(words)), F.lit(0.0))
