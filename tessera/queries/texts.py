"""String, date, nested-value and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import compare, dates, maths, nested, strings, text


@query(
    r"""SELECT p_partkey, upper(p_name[1]) AS initial, contains(p_name, 'bolt') OR contains(p_name, 'ring') AS any_of, contains(p_name, 'red') AND contains(p_name, 'ring') AS all_of,
    regexp_extract(p_name, '^[^ ]*') AS head, regexp_extract(p_name, '[^ ]*$') AS tail, 'x_' || p_name AS prefixed, regexp_replace(p_name, '^red ', '') AS without, length(regexp_replace(p_brand, '[^A-Z]', '', 'g')) AS n_upper,
    regexp_extract_all(p_name || '-' || p_brand, '[a-z]+') AS words, replace(p_type, 'E', 'e') AS swapped, regexp_matches(p_name, '(^|[^\w])red($|[^\w])') AS whole FROM part"""
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(F.substring(n, 1, 1)).alias("initial"), strings.contains_any(n, ["bolt", "ring"]).alias("any_of"), strings.contains_all(n, ["red", "ring"]).alias("all_of"),
        strings.split_first(n, " ")[0].alias("head"), F.element_at(strings.split_last(n, " "), -1).alias("tail"), strings.add_prefix(n, "x").alias("prefixed"),
        strings.remove_any_prefix(n, ["red "]).alias("without"), strings.count_upper(F.col("p_brand")).cast("bigint").alias("n_upper"),
        strings.extract_all(F.concat(n, F.lit("-"), F.col("p_brand")), "[a-z]+").alias("words"), F.replace("p_type", F.lit("E"), F.lit("e")).alias("swapped"), strings.contains_whole_word(n, "red").alias("whole"),
    )


@query(
    """SELECT c_custkey, split_part(c_name, '#', 1) AS domain, CAST(regexp_extract(c_name, '[0-9]+$') AS BIGINT) + 1 AS next, 'name: ' || c_name AS rendered,
    regexp_replace(c_name, '^Customer#', '') AS cut, position('#' IN c_name) - 1 AS at FROM customer"""
)
def string_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", strings.domain_of(n, "#").alias("domain"), strings.next_number(n).alias("next"), strings.render("name: {c_name}", ["c_name"]).alias("rendered"),
        strings.cut_before_first(n, "#", keep=False).alias("cut"), strings.find_all(n, "#")[0].cast("bigint").alias("at"),
    )


# what each category means, written out for the SQL engine
_SPELLED = {
    "date": r"\b((mon|tue|wed|thu|fri|sat|sun)|(monday|tuesday|wednesday|thursday|friday|saturday|sunday)|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|(january|february|march|april|june|july|august|september|october|november|december)"
    r"|\d\d?/\d\d?/\d{2,4}|\d\d?-\d\d?-\d{2,4}|\d\d?\.\d\d?\.\d{2,4}|\d{4}-\d\d-\d\d)\b",
    "time": r"\b\d\d?(:\d\d|(:\d\d)?\s*(am|pm))\b",
    "travel_count": r"\b\d+\s+((traveler|guest|adult|infant|passenger|room|night|day|seat|bag|person)s?|child|children|people|baggage)\b",
    "shopping_count": r"\b\d+\s+((item|product|result|review|rating|star|order|listing)s?|match|matches)\b",
    "general_count": r"\b\d+\s+((message|notification|comment|like|view|follower|post|photo|video|file|download|update|hour|minute|min|second|sec|week|month|year)s?|reply|replies|following)\b",
    "currency": r"([$€£₹]|\b(usd|eur|gbp)\s*)\d+(,\d{3})*(\.\d\d)?\b|¥\d+(,\d{3})*\b|\b\d+(,\d{3})*\.\d\d\b",
    "range": r"\b\d+(\s*[-–—]\s*|\s+to\s+)\d+\b|\b\d+\s*-\s*\d+\s*(night|day|hour)s?\b",
    "percentage": r"\b\d+(\.\d+)?(%|\s*percent\b)",
    "misc": r"\b(\d+\s*(mi|km|miles|kilometers)\s+away|in\s+\d+\s*(min|minutes?|hours?)|\d+\s*(min|minutes?|hours?|days?)\s+ago|(last|next)\s+\d+\s*(day|week|month)s?)\b",
}
# word ends in RE2 know ASCII letters only: others are made ASCII first
_ASCII = r"regexp_replace(text, '[\x{C0}-\x{24F}\x{3040}-\x{9FFF}]', 'x', 'g')"


@query(
    "SELECT doc_id, " + ", ".join(f"regexp_matches(t, '(?i){p}') AS has_{c}" for c, p in _SPELLED.items()) + f" FROM (SELECT doc_id, {_ASCII} AS t FROM documents WHERE text IS NOT NULL)"
)
def text_dynamic_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of changing content a document holds."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", *[text.contains_dynamic(F.col("text"), c).alias(f"has_{c}") for c in text.DYNAMIC])


_HITS = [
    ("currency", r"[$€£₹]\d+(?:,\d{3})*(?:\.\d\d)?\b"), ("currency", r"¥\d+(?:,\d{3})*\b"), ("currency", r"\b\d+(?:,\d{3})*\.\d\d\b"), ("currency", r"\b(?:USD|EUR|GBP)\s*\d+(?:,\d{3})*(?:\.\d\d)?\b"),
    ("percentage", r"\b\d+(?:\.\d+)?%"), ("percentage", r"\b\d+(?:\.\d+)?\s*percent\b"), ("percentage", r"\b\d+%\s*off\b"),
]


def _hits(category: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all(t, '(?i){pattern}'), lambda h: {{'category': '{category}', 'hit': h}})"


@query(
    "SELECT doc_id, h.category AS category, h.hit AS hit, count(*) AS n FROM (SELECT doc_id, unnest(" + " || ".join(_hits(*x) for x in _HITS)
    + f") AS h FROM (SELECT doc_id, {_ASCII} AS t FROM documents WHERE text IS NOT NULL)) GROUP BY ALL"
)
def text_dynamic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amounts and percentages of every document, as often as a pattern hits them."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    hits = docs.select("doc_id", F.inline(text.dynamic_matches(F.col("text")))).where(F.col("category").isin("currency", "percentage"))
    return hits.groupBy("doc_id", "category", F.col("text").alias("hit")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}]', '', 'g') <> '')) AS n_words FROM documents WHERE text IS NOT NULL"""
)
def text_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.size(text.tokens(F.col("text"))).cast("bigint").alias("n_words"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS d, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part")
def text_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(a, b).cast("bigint").alias("d"), F.round(text.edit_similarity(a, b), 6).alias("similarity"))


_DIRECTIVES = {"exact": "web_crawl", "has": "*/CRAWL", "not_start": "!^kb", "ends": "$notes", "low": "<g", "regex": "@ [a-z]+_dumps", "null": "?web_crawl"}


@query(
    """SELECT doc_id, coalesce(source = 'web_crawl', false) AS exact, coalesce(contains(lower(source), 'crawl'), false) AS has, coalesce(NOT starts_with(source, 'kb'), false) AS not_start,
    coalesce(ends_with(source, 'notes'), false) AS ends, coalesce(source < 'g', false) AS low, coalesce(regexp_full_match(source, '[a-z]+_dumps'), false) AS regex, coalesce(source = 'web_crawl', true) AS "null" FROM documents"""
)
def compare_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[compare.matches(F.col("source"), d).alias(name) for name, d in _DIRECTIVES.items()])


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%y%m%d') AS short, CAST(o_orderdate AS DATE) + 10 AS later, strftime(CAST(o_orderdate AS DATE) - 3, '%m/%d/%Y') AS earlier,
    'orders_' || strftime(o_orderdate, '%Y%m%d') || '.csv' AS path FROM orders"""
)
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    us = F.date_format("o_orderdate", "MM/dd/yyyy")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.reformat(us).alias("short"), dates.add_days(day, 10).alias("later"), dates.add_days(us, -3, "MM/dd/yyyy").alias("earlier"),
        dates.stamped(F.lit("orders.csv"), F.col("o_orderdate")).alias("path"),
    )


@query(
    """SELECT r_regionkey, CAST(unnest(generate_series(DATE '2024-02-26', DATE '2024-02-26' + r_regionkey, INTERVAL 1 DAY)) AS DATE) AS day FROM region"""
)
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    start = F.lit("2024-02-26").cast("date")
    return r.select("r_regionkey", F.explode(dates.dates(start, F.date_add(start, F.col("r_regionkey")))).alias("day"))


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(coalesce(l_extendedprice / nullif(l_discount, 0), 0), 4) AS ratio, abs(l_tax / nullif(l_discount, 0) - 1) < 0.5 AS near, abs(l_tax / nullif(l_quantity, 0)) < 0.001 AS small FROM lineitem"""
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(maths.divide(c("l_extendedprice"), c("l_discount")), 4).alias("ratio"),
        maths.is_close(c("l_tax"), c("l_discount"), 0.5).alias("near"), maths.is_negligible(c("l_tax"), c("l_quantity")).alias("small"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def nested_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", nested.json_at(F.col("props"), "k").alias("k"))


@query("SELECT event_id, upper(event_type) AS kind, round(value * 2, 4) AS doubled, user_id FROM events")
def nested_set_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values moved into structs, changed there by path, and taken out again."""
    e = table(spark, sf_dir, "events").select("event_id", F.struct("user_id", F.struct("event_type", "value").alias("what")).alias("e"))
    e = nested.transform_at(e, "e.what.event_type", F.upper)
    e = nested.set_at(e, "e.extra.doubled", F.round(nested.get_at(e, "e.what.value") * 2, 4))
    e = nested.pop_at(e, "e.what.value", "gone")
    return e.select("event_id", nested.get_at(e, "e.what.event_type").alias("kind"), nested.get_at(e, "e.extra.doubled").alias("doubled"), nested.get_at(e, "e.user_id").alias("user_id"))


@query(
    "SELECT event_id, 'event_type' AS path, event_type AS value FROM events UNION ALL SELECT event_id, 'inner.user_id', CAST(user_id AS VARCHAR) FROM events"
)
def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.struct("user_id").alias("inner"))
    return nested.unpivoted_leaves(e, ["event_id"])
