"""Queries through the string, text, date and number functions: many columns each, one per function or option."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import arrays, dates, maths, parsing, strings, text


def _lit(*parts) -> Column:
    """Columns (by a leading ``$``) and literals joined."""
    return F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])


def _part(spark: SparkSession, sf_dir: str, columns: dict[str, Column]) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in columns.items()])


@query(
    r"""SELECT p_partkey, starts_with(p_name, 'cold') OR starts_with(p_name, 'small') AS starts, ends_with(p_name, 'bolt') OR ends_with(p_name, 'ring') AS ends,
    (contains(p_name, 'cold') AND contains(p_name, 'bolt')) OR (contains(p_name, 'red') AND contains(p_name, 'ring')) AS any_all, contains(' ' || p_name || ' ', ' bolt ') AS between_spaces,
    length(regexp_replace(p_brand, '[^a-z]', '', 'g')) AS n_lower FROM part"""
)
def string_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return _part(spark, sf_dir, {
        "starts": strings.starts_with_any(n, ["cold", "small"]), "ends": strings.ends_with_any(n, ["bolt", "ring"]), "any_all": strings.contains_any_all(n, [["cold", "bolt"], ["red", "ring"]]),
        "between_spaces": strings.contains_between_spaces(n, "bolt"), "n_lower": strings.count_lower(F.col("p_brand")).cast("bigint"),
    })


@query(
    r"""SELECT p_partkey, regexp_replace(p_name, ' [^ ]*$', '') AS before_last, p_brand AS without_first_line, p_name AS without_last_line, p_brand AS inside, '<' || p_brand || '>' AS inside_with_marks,
    p_brand AS open_end, [p_name, p_brand] AS all_inside, [p_name, p_brand, p_type] AS parts, [p_name, p_brand] AS stripped, [p_name, p_brand, p_brand, p_brand] AS padded,
    p_name || ' and ' || p_brand AS joined, p_name || ', ' || p_type || ' and ' || p_brand AS three, p_name || '-' || p_brand AS two FROM part"""
)
def string_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    marked, lines = _lit("$p_name", "<", "$p_brand", ">"), _lit("$p_name", "\n", "$p_brand")
    return _part(spark, sf_dir, {
        "before_last": strings.cut_after_last(n, " "), "without_first_line": strings.remove_first_line(lines), "without_last_line": strings.remove_last_line(lines),
        "inside": strings.extract_between(marked, "<", ">"), "inside_with_marks": strings.extract_between(marked, "<", ">", True, True), "open_end": strings.extract_between(_lit("$p_name", "<", "$p_brand"), "<", ">", end_optional=True),
        "all_inside": strings.extract_all_between(_lit("[", "$p_name", "] [", "$p_brand", "]"), "[", "]"), "parts": strings.split_any(_lit("$p_name", ",", "$p_brand", ";", "$p_type"), [",", ";"]),
        "stripped": strings.split_any(_lit("$p_name", " ,, ", "$p_brand", ","), [","], strip=True, drop_empty=True), "padded": strings.split_any(_lit("$p_name", ",", "$p_brand"), [","], pad_to=4),
        "joined": strings.join([n, F.lit(""), b], ", ", " and "), "three": strings.join([n, t, b], ", ", " and "), "two": strings.join([n, F.lit(None).cast("string"), b], "-"),
    })


@query(
    r"""SELECT p_partkey, regexp_extract(p_brand, '[0-9]$') AS last_digit, regexp_replace(p_name, '[aeiou]', '_') AS first_vowel, regexp_replace(p_name, '^(.*)[aeiou]', '\1_') AS last_vowel,
    [[p_type, p_brand]] AS groups, regexp_replace(p_name, '[aeiout]', '', 'g') AS removed, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'bolt' THEN 'nut' ELSE w END), ' ') AS nut,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'bolt' THEN '' ELSE w END), ' ') AS no_bolt FROM part"""
)
def string_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b = F.col("p_name"), F.col("p_brand")
    return _part(spark, sf_dir, {
        "last_digit": strings.last_match(b, r"\d"), "first_vowel": strings.replace_first(n, "[aeiou]", "_"), "last_vowel": strings.replace_last(n, "[aeiou]", "_"),
        "groups": strings.extract_groups(_lit("$p_type", "=", "$p_brand", ";"), r"([A-Z]+)=([^;]+);"), "removed": strings.remove_all(n, "[aeiou]", "t"),
        "nut": strings.replace_whole_word(n, "bolt", "nut"), "no_bolt": strings.remove_whole_word(n, "bolt"),
    })


@query(
    r"""SELECT p_partkey, p_name || '_x' AS suffixed, p_name || '_x' AS suffixed_once, 'a-' || p_name AS prefixed_once, regexp_replace(p_name, '( bolt| ring)$', '') AS no_suffix, 'b_' || p_name AS new_prefix, p_name || '_b' AS new_suffix,
    regexp_replace(regexp_replace(p_name, '^(cold|red) ', ''), ' bolt$', '') AS no_affixes, p_name AS no_head, p_name AS no_tail, [p_name, p_brand] AS no_shared_head, [p_name, p_brand] AS no_shared_tail,
    ['p ' || p_name, p_brand] AS not_shared FROM part"""
)
def string_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    both = lambda f, pattern, x: F.array(*f([_lit(*[p.replace("*", "$p_name") for p in pattern]), _lit(*[p.replace("*", "$p_brand") for p in pattern])], x))
    return _part(spark, sf_dir, {
        "suffixed": strings.add_suffix(n, "x"), "suffixed_once": strings.add_suffix(_lit("$p_name", "_x"), "x", once=True), "prefixed_once": strings.add_prefix(_lit("a-", "$p_name"), "a", "-", once=True),
        "no_suffix": strings.remove_any_suffix(n, [" bolt", " ring"]), "new_prefix": strings.replace_prefix(_lit("a_", "$p_name"), "a", "b"), "new_suffix": strings.replace_suffix(_lit("$p_name", "_a"), "a", "b"),
        "no_affixes": strings.remove_affixes(n, ["cold", "red"], ["bolt"]), "no_head": strings.remove_prefix_tokens(_lit("the a the ", "$p_name"), ["the", "a"]), "no_tail": strings.remove_suffix_tokens(_lit("$p_name", " x y x"), ["x", "y"]),
        "no_shared_head": both(strings.remove_shared_prefix, ["p ", "*"], ["q", "p"]), "no_shared_tail": both(strings.remove_shared_suffix, ["*", " p"], ["p"]),
        "not_shared": F.array(*strings.remove_shared_prefix([_lit("p ", "$p_name"), F.col("p_brand")], ["p"])),
    })


@query(
    r"""SELECT p_partkey, 'some_' || lower(p_brand) AS snake, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') AS camel, ['(' || p_brand || ')', '[' || p_type || ']'] AS brackets, p_name AS no_brackets,
    'Brand#' || (CAST(p_brand[7:] AS BIGINT) + 1) AS plus_one, (p_partkey + 2) || '-' || (CAST(p_brand[7:] AS BIGINT) + 2) AS plus_two, (p_partkey + 1) || '-' || p_brand[7:] AS first_plus_one, 'space/' || p_name || '/end' AS key, p_name || '/' || p_brand AS space, p_type AS item,
    p_name AS space_alone, 'main' AS item_alone, ['f', 'g.h'] AS called, '<' || p_name || '&>' AS unescaped, '<a>' || p_name || '</a>' AS element, p_name AS unwrapped, p_name || ' ' || p_brand AS no_tags,
    p_name || ': ' || p_brand AS yaml, '<' || p_type || '>' || p_name || '</' || p_type || '>' AS xml, '{"' || p_type || '":"' || p_name || '"}' AS json, 'x ' || p_name || ' y ' || p_brand AS double_braces,
    'x ' || p_name || ' y {{other}}' AS safe, 'x ' || p_brand AS dollar FROM part"""
)
def string_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    bracketed, numbers = _lit("$p_name", " (", "$p_brand", ") [", "$p_type", "]"), F.concat_ws("-", "p_partkey", F.substring(b, 7, 10))
    two, one = strings.split_spaced_key(_lit("$p_name", "/", "$p_brand", "/", "$p_type")), strings.split_spaced_key(n, default="main")
    return _part(spark, sf_dir, {
        "snake": strings.camel_to_snake(_lit("some", "$p_brand")), "camel": strings.snake_to_camel(F.replace(n, F.lit(" "), F.lit("_"))), "brackets": strings.trailing_brackets(bracketed),
        "no_brackets": strings.without_trailing_brackets(bracketed), "plus_one": strings.add_to_numbers(b), "plus_two": strings.add_to_numbers(numbers, 2, "all"), "first_plus_one": strings.add_to_numbers(numbers, 1, "first"),
        "key": strings.spaced_key(n, "space", "end"), "space": two["space"], "item": two["item"], "space_alone": one["space"], "item_alone": one["item"],
        "called": strings.function_names(_lit("f(", "$p_name", "); g.h(1)")), "unescaped": strings.unescape_xml(_lit("&lt;", "$p_name", "&amp;&gt;")), "element": strings.xml_element("a", n),
        "unwrapped": strings.unwrap_xml(_lit("<a b='1'> ", "$p_name", " </a>")), "no_tags": strings.strip_tags(_lit("<p>", "$p_name", "</p><b>", "$p_brand", "</b>")), "yaml": strings.key_value(n, b),
        "xml": strings.key_value(t, n, "xml"), "json": strings.key_value(t, n, "json"), "double_braces": strings.render("x {{ p_name }} y {{p_brand}}", ["p_name", "p_brand"], "double_brace"),
        "safe": strings.render("x {{p_name}} y {{other}}", ["p_name"], "double_brace", safe=True), "dollar": strings.render("x ${p_brand}", ["p_brand"], "dollar"),
    })


@query(
    r"""SELECT p_partkey, ['a', '"' || p_name || ',x"', p_brand] AS fields, ['f(1; ' || p_name || ')', 'g()'] AS calls, 'f.g' AS name, [p_name, '2'] AS args, p_brand AS value, true AS same, false AS other,
    p_brand AS xml_value, [p_name] AS entities FROM part"""
)
def string_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted fields, calls, XML and entities by the pattern of their tags."""
    n = F.col("p_name")
    call = parsing.parse_call(F.concat(F.lit("f.g('"), n, F.lit("', 2, k='"), F.col("p_brand"), F.lit("')")))
    spelled = lambda quote: F.concat(F.lit(f"f({quote}"), n, F.lit(f"{quote});  g( 1)"))
    tagged = parsing.entities(table(spark, sf_dir, "part").withColumn("said", F.concat(F.lit("the "), n)), "said", lambda x: [(w, "DET" if w == "the" else "NOUN" if i == 2 else "ADJ") for i, w in enumerate(x.split())], "A*N+", {"ADJ": "A", "NOUN": "N"})
    return tagged.select(
        "p_partkey", parsing.split_quoted(F.concat(F.lit('a,"'), n, F.lit(',x",'), F.col("p_brand"))).alias("fields"), parsing.split_calls(F.concat(F.lit("f(1; "), n, F.lit("); g()"))).alias("calls"),
        call["name"].alias("name"), call["args"].alias("args"), call["kwargs"]["k"].alias("value"), parsing.same_calls(spelled("'"), spelled('"')).alias("same"), parsing.same_calls(spelled("'"), F.lit("f()")).alias("other"),
        parsing.from_xml(F.concat(F.lit("<r><v>"), F.col("p_brand"), F.lit("</v></r>")), "v string")["v"].alias("xml_value"), "entities",
    )


@query(
    r"""SELECT o_orderkey, regexp_replace(CAST(CAST(round(x * u) / u AS DECIMAL(24, 6)) AS VARCHAR), '\.?0+$', '') || l AS short, total // 3 + CASE WHEN total % 3 > 0 THEN 1 ELSE 0 END AS first_part, total // 3 AS last_part FROM (
    SELECT o_orderkey, total, x, l, power(10.0, greatest(3 - (floor(log10(x) + 1e-12) + 1), 0)) AS u FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS total,
    CASE WHEN floor(o_totalprice) >= 1000000 THEN floor(o_totalprice) / 1000000 WHEN floor(o_totalprice) >= 1000 THEN floor(o_totalprice) / 1000 ELSE floor(o_totalprice) END AS x,
    CASE WHEN floor(o_totalprice) >= 1000000 THEN 'M' WHEN floor(o_totalprice) >= 1000 THEN 'K' ELSE '' END AS l FROM orders))"""
)
def math_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", maths.short_number(total).alias("short"), maths.part_of(total, 3, F.lit(0)).alias("first_part"), maths.part_of(total, 3, F.lit(2)).alias("last_part"))


@query(
    r"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS read, [CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 1, CAST(o_orderdate AS DATE) + 2] AS three, [CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) - 1] AS back,
    [CAST(o_orderdate AS DATE) - 4, CAST(o_orderdate AS DATE) - 7] AS batch_starts, [CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) - 5] AS batch_ends,
    CAST(floor((DATE '2000-12-31' - CAST(o_orderdate AS DATE)) / 14.0) AS BIGINT) AS fortnight, 'a_' || strftime(o_orderdate, '%Y%m%d%H%M') || '.txt' AS minute FROM orders"""
)
def date_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    batches = dates.batches_back(day, 8, 5)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.to_date(F.date_format(day, "MM/dd/yyyy")).alias("read"), dates.days_from(day, 3).alias("three"), dates.days_from(day, -2).alias("back"), batches["start"].alias("batch_starts"), batches["end"].alias("batch_ends"),
        dates.week_range(day, "2000-12-31", 2).alias("fortnight"), dates.stamped(F.lit("a.txt"), F.col("o_orderdate"), "minute").alias("minute"),
    )


_WORDS = "string_split(p_name, ' ')"


@query(
    rf"""SELECT p_partkey, true AS same_bag, len(list_intersect(list_distinct({_WORDS}), ['cold', 'bolt'])) AS n_shared, array_to_string(list_filter({_WORDS}, lambda w: w NOT IN ('cold', 'bolt')), ' ') AS rest,
    p_name || ' ' || replace(p_brand, '#', ' ') AS plain, p_name || ' a-b ' || replace(p_brand, '#', ' ') AS hyphen, contains(p_brand, '#') AS marked, 'cnn ' || p_name AS acronym, 'Ete ' || p_name AS no_accents,
    array_to_string(list_sort({_WORDS}), ' ') AS in_order, len(list_intersect({_WORDS}, ['bolt', 'bolts'])) > 0 AS token, len(list_intersect({_WORDS}, ['bolt'])) = 0 AS kept,
    len(list_filter({_WORDS}, lambda w: w NOT IN ('cold', 'bolt'))) > 0 AS added, len(list_filter(['cold', 'bolt'], lambda w: NOT list_contains({_WORDS}, w))) > 0 AS dropped, len(list_filter({_WORDS}, lambda w: w NOT IN ('cold', 'bolt', 'red'))) = 0 AS subset,
    (len(list_filter({_WORDS}, lambda w: w NOT IN ('cold', 'bolt', 'red'))) = 0) <> (len(list_filter(['cold', 'bolt', 'red'], lambda w: NOT list_contains({_WORDS}, w))) = 0) AS proper,
    CAST(p_brand[7:] AS BIGINT) <> p_size AS numbers_differ, len(list_filter({_WORDS}, lambda w: w IN ('cold', 'bolt'))) / 2.0 AS readable, list_sort({_WORDS}) = list_sort(['cold', 'bolt']) AS anagram FROM part"""
)
def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, w = F.col("p_name"), F.split("p_name", " ")
    turned = F.array_join(F.reverse(w), " ")
    two, three = F.array(F.lit("cold"), F.lit("bolt")), F.array(F.lit("cold"), F.lit("bolt"), F.lit("red"))
    return _part(spark, sf_dir, {
        "same_bag": text.equal_in_tokens(n, turned), "n_shared": text.overlap_tokens(n, F.lit("cold bolt")).cast("bigint"), "rest": text.common_tokens_removed(n, F.lit("cold bolt")),
        "plain": text.remove_punctuation(_lit("$p_name", ", (", "$p_brand", ")!")), "hyphen": text.sanitize(_lit("$p_name", " a-b,  ", "$p_brand"), "no_punctuation_but_hyphen"), "marked": text.contains_punctuation(F.col("p_brand")),
        "acronym": text.remove_acronym_periods(_lit("c. n. n. ", "$p_name")), "no_accents": text.remove_accents(_lit("Été ", "$p_name")), "in_order": text.sanitize(F.upper(n), "lower", "sorted_tokens"),
        "token": text.has_token(n, ["bolt"]), "kept": text.keeps_tokens(n, F.lit("nothing"), ["bolt"]), "added": text.sets_conflict(two, w, allow_drop=True), "dropped": text.sets_conflict(two, w, allow_add=True),
        "subset": text.is_subset(w, three), "proper": text.one_contains_the_other(w, three), "numbers_differ": text.numbers_conflict(F.col("p_brand"), F.concat(F.lit("Brand#"), F.col("p_size"))),
        "readable": text.readability(n, two), "anagram": arrays.anagram_key(F.array_join(F.array_sort(w), "")) == arrays.anagram_key(F.lit("boltcold")),
    })


@query(
    r"""SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: CASE WHEN ends_with(w, 'e') AND NOT regexp_matches(w, '[^aeiou][aeiouy][^aeiouwxy]e$') AND regexp_matches(w, '[aeiouy][^aeiouy]+e$') THEN w[:-2] ELSE w END) AS stems, ['gener', 'oscil', 'relat', 'happi'] AS fixed FROM part"""
)
def text_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the plurals of part names, and of words from the algorithm's publication."""
    plural = F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.lit("s")))
    return _part(spark, sf_dir, {"stems": text.stems(plural), "fixed": text.stems(F.array(*map(F.lit, ["generalizations", "oscillators", "relational", "happy"])))})
