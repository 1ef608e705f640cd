"""Queries through the functions on arrays, maps and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import arrays, nested, parsing
from tessera.operators import aggregate, reshape


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_orderkey, a)``: each order's quantities, less 25, in the order of line number, price and part."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_quantity"))).alias("r"))
    return rows.select("l_orderkey", F.transform("r", lambda x: x["l_quantity"] - 25).alias("a"))


_A = "WITH q AS (SELECT l_orderkey, list(l_quantity - 25 ORDER BY l_linenumber, l_extendedprice, l_partkey) AS a FROM lineitem GROUP BY l_orderkey)"
_SPANS = "list_filter(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) + 1), lambda j: {'i': i, 'j': j}))), lambda p: p.j >= p.i)"


@query(
    f"""{_A}, s AS (SELECT l_orderkey, a, unnest({_SPANS}) AS p FROM q) SELECT l_orderkey, max(list_product(a[p.i:p.j])) + 0.0 AS best_product, bool_or(p.j > p.i AND CAST(list_sum(a[p.i:p.j]) AS BIGINT) % 7 = 0) AS by_seven,
    count(*) FILTER (list_sum(a[p.i:p.j]) = 5) AS n_fives FROM s GROUP BY l_orderkey"""
)
def seq_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all stretches of an order's quantities: the greatest product, whether a sum is a multiple of seven, how many sums are five."""
    a = F.col("a")
    return _quantities(spark, sf_dir).select(
        "l_orderkey", (arrays.max_subarray_product(a) + 0.0).alias("best_product"), arrays.has_subarray_divisible_by(a, 7).alias("by_seven"), F.size(arrays.subarrays_with_sum(a, 5)).cast("bigint").alias("n_fives")
    )


@query(
    f"""{_A} SELECT l_orderkey, list_transform(range(1, len(a) + 1), lambda i: list_sum(a[:i])) AS sums, list_transform(range(1, len(a) + 1), lambda i: coalesce(list_product(list_concat(a[:i - 1], a[i + 1:])), 1.0) + 0.0) AS others,
    list_filter(range(0, len(a)), lambda i: coalesce(list_sum(a[:i]), 0) = coalesce(list_sum(a[i + 2:]), 0)) AS balance,
    list_transform(range(1, len(a) + 1), lambda i: coalesce(list_filter(range(i, len(a)), lambda j: a[j + 1] > a[i])[1], -1)) AS next, list_concat(a, list_transform(range(0, greatest(0, 5 - len(a))), lambda i: a[-1])) AS padded,
    coalesce(list_position(a, 5.0), 0) - 1 AS fifth, len(a) - 1 AS last, a[:len(a) // 2] AS first_half, a[len(a) // 2 + 1:] AS second_half, len(list_distinct(a)) = 1 AS equal, list_distinct(a) = [1.0] AS ones FROM q"""
)
def seq_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    longs = lambda c: c.cast("array<bigint>")
    out = _quantities(spark, sf_dir).select(
        "l_orderkey", arrays.prefix_sums(a).alias("sums"), F.transform(arrays.product_except_self(a), lambda x: x + 0.0).alias("others"), longs(arrays.equilibrium_indexes(a)).alias("balance"), longs(arrays.next_larger(a)).alias("next"),
        arrays.padded(a, 5).alias("padded"), arrays.position(a, F.lit(5.0)).cast("bigint").alias("fifth"), arrays.last_non_null(a).cast("bigint").alias("last"), arrays.halves(a)["first"].alias("first_half"),
        arrays.halves(a)["second"].alias("second_half"), arrays.all_equal(a).alias("equal"), arrays.all_equal(a, F.lit(1.0)).alias("ones"),
    )
    return out.withColumn("others", F.transform("others", lambda x: F.when(x == 0, 0.0).otherwise(x)))


@query(
    """SELECT p_partkey, greatest(p_size || p_brand[7:], p_brand[7:] || p_size) AS greatest, 1 AS turned, 2 AS same, string_split(p_name, ' ') AS run, '(' || p_name || ')' AS removed, '((' || p_name || '))' AS added FROM part"""
)
def seq_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest concatenation, common subsequences and runs of words, matching brackets."""
    w, n = F.split("p_name", " "), F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", arrays.largest_concatenation(F.array(F.col("p_size").cast("string"), F.substring("p_brand", 7, 10))).alias("greatest"), arrays.lcs_length(w, F.reverse(w)).alias("turned"), arrays.lcs_length(w, F.concat(w, F.array(F.lit("x")))).alias("same"),
        arrays.longest_common_run(w, F.concat(F.array(F.lit("x")), w)).alias("run"), arrays.balanced(F.concat(F.lit("("), n, F.lit("))"))).alias("removed"), arrays.balanced(F.concat(F.lit("(("), n, F.lit(")")), remove=False).alias("added"),
    )


@query(
    f"""WITH q AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_extendedprice, l_partkey) AS w, list(l_quantity ORDER BY l_linenumber, l_extendedprice, l_partkey) AS v FROM lineitem GROUP BY l_orderkey),
    m AS (SELECT l_orderkey, w, v, unnest(range(0, CAST(power(2, len(w)) AS BIGINT))) AS mask FROM q),
    s AS (SELECT l_orderkey, list_filter(range(1, len(w) + 1), lambda i: (mask >> (i - 1)) & 1 = 1) AS picked, w, v FROM m)
    SELECT l_orderkey, max(coalesce(list_sum(list_transform(picked, lambda i: v[i])), 0)) AS best FROM s WHERE coalesce(list_sum(list_transform(picked, lambda i: w[i])), 0) <= 7 GROUP BY l_orderkey"""
)
def seq_knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest quantity of an order's lines whose line numbers add up to seven at most."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_quantity"))).alias("r"))
    return rows.select("l_orderkey", arrays.knapsack(7, rows["r"]["l_linenumber"].cast("array<bigint>"), rows["r"]["l_quantity"]).alias("best"))


_THREE = "[p_size % 3, p_partkey % 3, 1]"


@query(
    f"""WITH o AS (SELECT [1, 2, 3] AS o UNION ALL SELECT [1, 3, 2] UNION ALL SELECT [2, 1, 3] UNION ALL SELECT [2, 3, 1] UNION ALL SELECT [3, 1, 2] UNION ALL SELECT [3, 2, 1]),
    x AS (SELECT p_partkey, p_size, {_THREE} AS a, list_transform(o, lambda i: {_THREE}[i]) AS b FROM part, o)
    SELECT p_partkey, coalesce(min(b) FILTER (b > a), min(b)) AS next, count(*) AS n_orders, (SELECT min(f + (p_size - 3 * f) // 5) FROM (SELECT unnest(range(0, p_size // 3 + 1)) AS f) WHERE (p_size - 3 * f) % 5 = 0) AS workers FROM x GROUP BY p_partkey, p_size"""
)
def seq_arrangements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next arrangement of three numbers, how many there are, and the fewest workers of three and five for a part's size."""
    p = table(spark, sf_dir, "part").withColumn("a", F.array(F.col("p_size") % 3, F.col("p_partkey") % 3, F.lit(1)).cast("array<bigint>"))
    orders = parsing.permutations(p.select("p_partkey", "a"), "a").groupBy("p_partkey").agg(F.count("*").alias("n_orders"))
    found = p.select("p_partkey", arrays.next_permutation(F.col("a")).alias("next"), arrays.fewest_workers(F.array(F.lit(3), F.lit(5)), F.col("p_size")).alias("workers"))
    return found.join(orders, "p_partkey").withColumn("workers", F.when(F.col("workers") >= 0, F.col("workers")))


@query(
    """WITH x AS (SELECT p_partkey, list_sort([CAST(p_size AS DOUBLE), CAST(p_partkey % 7 AS DOUBLE), 5.0]) AS s, p_name FROM part)
    SELECT p_partkey, 2 * (s[1] + s[2]) + s[3] AS merge_cost, s[1] + s[2] + s[3] AS tour, true AS word, false AS no_word, 2 AS depth FROM x"""
)
def seq_small_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest merges, a round trip over three points, words in a grid of letters, the depth of an encoded tree."""
    size, other = F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")
    row = lambda *x: F.array(*[F.lit(None).cast("double") if c is None else c for c in x])
    matrix = F.array(row(None, size, other), row(size, None, F.lit(5.0)), row(other, F.lit(5.0), None))
    grid = F.array(F.substring("p_name", 1, 3), F.reverse(F.substring("p_name", 4, 3)))
    tree = F.lit(parsing.encode_tree({"a": ("b", "c")}, "a"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", parsing.cheapest_merges(F.array(size, other, F.lit(5.0))).alias("merge_cost"), parsing.shortest_tour(matrix).alias("tour"), parsing.word_in_grid(grid, F.substring("p_name", 1, 6)).alias("word"),
        parsing.word_in_grid(grid, F.lit("#")).alias("no_word"), parsing.tree_depth(tree).alias("depth"),
    )


# ---- maps and nested values

def _listed(m):
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


@query(
    """SELECT event_id, list_sort(['p_k_id=' || event_id, 'p_k_user=' || user_id, 'p_type=' || event_type]) AS renamed, ['id=' || event_id, 'user=' || user_id] AS stripped, ['type=' || event_type] AS some,
    list_sort([event_id || '=k_id', user_id || '=k_user', event_type || '=type']) AS turned, true AS single, false AS not_single, list_sort(['k_id=' || event_id, 'k_user=' || user_id, 'type=x', 'z=1']) AS merged, ['a=1'] AS without_nulls,
    coalesce(nullif(event_type, 'click'), 'none') AS first_of FROM events WHERE event_id <> user_id"""
)
def nested_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps: keys renamed, cut, chosen, swapped with values, merged."""
    text = lambda c: F.col(c).cast("string")
    e = table(spark, sf_dir, "events").where("event_id <> user_id").withColumn("m", F.create_map(F.lit("k_id"), text("event_id"), F.lit("k_user"), text("user_id"), F.lit("type"), F.col("event_type")))
    m, one = F.col("m"), F.create_map(F.lit("a"), F.lit("1"))
    return e.select(
        "event_id", _listed(nested.rename_keys(m, "p")).alias("renamed"), _listed(nested.keys_with_prefix(m, "k_")).alias("stripped"), _listed(nested.sub_map(m, ["type", "k_id"], ["k_id"])).alias("some"), _listed(nested.swapped(m)).alias("turned"),
        nested.has_single_key(one, "a").alias("single"), nested.has_single_key(m).alias("not_single"), _listed(nested.merged(m, F.create_map(F.lit("type"), F.lit("x"), F.lit("z"), F.lit("1")), F.lit(None).cast("map<string,string>"))).alias("merged"),
        _listed(nested.without_nulls(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string")))).alias("without_nulls"), nested.first_of(F.when(F.col("event_type") != "click", F.col("event_type")), F.lit("none")).alias("first_of"),
    )


@query("SELECT event_id, user_id, event_type AS kind, NULL AS missing, user_id AS fuzzy FROM events")
def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields removed, found by a joined name, and defaulted where there is none."""
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.struct("user_id", "event_type").alias("who_what"), "value").alias("e"))
    assert nested.has_path(e, "e.who_what.user_id") and not nested.has_path(nested.delete_at(e, "e.value"), "e.value")
    fuzzy = ".".join(nested.resolve_fuzzy(e.schema, "e_who_what_user_id"))
    return nested.delete_at(e, "e.value").select("event_id", nested.get_at(e, "e.who_what.user_id").alias("user_id"), nested.get_at(e, "e.who_what.event_type").alias("kind"), nested.get_at(e, "e.none", F.lit(None).cast("string")).alias("missing"), nested.get_at(e, fuzzy).alias("fuzzy"))


@query(
    """SELECT put_id, TRY_CAST(trim(t) AS BIGINT) AS as_long, TRY_CAST(trim(t) AS DOUBLE) AS as_double, CASE WHEN lower(trim(t)) IN ('true', 'yes', 'y', 't', '1', 'on') THEN true WHEN lower(trim(t)) IN ('false', 'no', 'n', 'f', '0', 'off') THEN false END AS as_boolean
    FROM (SELECT put_id, CASE WHEN regexp_full_match(value_json, '-?[0-9]{1,15}|true|false') THEN value_json END AS t FROM kv_store)"""
)
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the plain values of the key-value log may stand for."""
    plain = F.when(F.col("value_json").rlike(r"^(?:-?[0-9]{1,15}|true|false)\z"), F.col("value_json"))
    v = nested.to_value(plain)
    return table(spark, sf_dir, "kv_store").select("put_id", v["as_long"].alias("as_long"), v["as_double"].alias("as_double"), v["as_boolean"].alias("as_boolean"))


# ---- maps over rows


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.create_map(F.col("event_type"), F.col("value")).alias("m"), F.create_map(F.col("event_type"), F.array(F.col("event_id") % 5)).alias("s"))


@query("SELECT user_id, event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def agg_merge_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last value by type of event."""
    return aggregate.merge_maps(_maps(spark, sf_dir), "m", "event_id", ["user_id"])


@query("SELECT user_id, event_type AS key, list_sort(list(DISTINCT event_id % 5)) AS values FROM events GROUP BY ALL")
def agg_merge_set_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.merge_set_maps(_maps(spark, sf_dir), "s", ["user_id"])


@query("SELECT user_id, event_type AS key, list(event_id % 5 ORDER BY event_id) AS values FROM events GROUP BY ALL")
def agg_merge_list_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's numbers by type of event, repeats and order kept."""
    return aggregate.merge_list_maps(_maps(spark, sf_dir), "s", "event_id", ["user_id"])


@query("SELECT o_orderstatus || '-' || o_orderpriority AS key, list(o_orderkey ORDER BY o_orderkey) AS examples FROM orders GROUP BY ALL")
def agg_confusion_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.confusion_examples(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey")


@query(
    """SELECT l_returnflag, CAST(min(CAST(l_discount * 100 >= 1 AS INTEGER)) AS INTEGER) AS bmin, CAST(max(CAST(l_discount * 100 >= 1 AS INTEGER)) AS INTEGER) AS bmax, count(DISTINCT l_suppkey) AS n_suppliers, median(l_quantity) AS middle,
    round(stddev_samp(l_quantity), 6) AS spread, true AS close FROM lineitem GROUP BY l_returnflag"""
)
def agg_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named aggregates; the approximate ones are within their bounds of the exact ones."""
    lines = table(spark, sf_dir, "lineitem").withColumn("percent", F.col("l_discount") * 100)
    of = lambda target, name, alias: aggregate.Aggregation(target, name, ["l_returnflag"], alias=alias)
    (out,) = aggregate.aggregate(lines, [
        of("percent", "bmin", "bmin"), of("percent", "bmax", "bmax"), of("l_suppkey", "distinct", "n_suppliers"), of("l_quantity", "median", "middle"), of("l_quantity", "std", "spread"), of("l_orderkey", "approx_distinct", "about"),
        of("l_orderkey", "distinct", "exact"), of("l_quantity", "approx_median", "near"),
    ])
    close = (F.abs(F.col("about") / F.col("exact") - 1) < 0.2) & (F.abs(F.col("near") - F.col("middle")) <= 1)
    return out.select("l_returnflag", "bmin", "bmax", "n_suppliers", "middle", F.round("spread", 6).alias("spread"), close.alias("close"))


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS total, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.cube(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
    return out.withColumnRenamed("grouping_id", "level").withColumn("level", F.col("level").cast("bigint"))


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS total, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
)
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.rollup(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
    return out.withColumnRenamed("grouping_id", "level").withColumn("level", F.col("level").cast("bigint"))


@query("SELECT l_orderkey, flatten(list([l_partkey, l_suppkey] ORDER BY l_linenumber, l_extendedprice, l_partkey)) AS keys FROM lineitem GROUP BY l_orderkey")
def reshape_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of arrays folded."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"))).alias("r"))
    return rows.select("l_orderkey", reshape.fold_column(F.transform("r", lambda x: F.array(x["l_partkey"], x["l_suppkey"]))).alias("keys"))
