"""Aggregation, selection and reshaping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.operators import aggregate as agg
from tessera.operators import reshape, selection
from tessera.operators.aggregate import Aggregation


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, min(l_discount) AS min_discount,
    max(l_tax) AS max_tax, round(median(l_quantity), 2) AS median_qty, round(stddev_samp(l_quantity), 4) AS std_qty, count(l_orderkey) AS n, count(DISTINCT l_suppkey) AS n_suppliers
    FROM lineitem GROUP BY ALL"""
)
def agg_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many aggregates of one grouping, in one pass."""
    keys = ["l_returnflag", "l_linestatus"]
    rounded = lambda f, n: lambda c: F.round(f(c), n)
    wanted = [
        ("l_quantity", rounded(F.sum, 2), "sum_qty"), ("l_extendedprice", rounded(F.avg, 2), "avg_price"), ("l_discount", "min", "min_discount"), ("l_tax", "max", "max_tax"),
        ("l_quantity", rounded(F.median, 2), "median_qty"), ("l_quantity", rounded(F.stddev_samp, 4), "std_qty"), ("l_orderkey", "count", "n"), ("l_suppkey", "distinct", "n_suppliers"),
    ]
    (out,) = agg.aggregate(table(spark, sf_dir, "lineitem"), [Aggregation(t, f, keys, alias=a) for t, f, a in wanted])
    return out


_WORD_GROUPS = r"""WITH t AS (SELECT lang, unnest(list_distinct(string_split_regex(lower(text), '\s+'))) AS word, n_chars FROM documents WHERE text IS NOT NULL)
    SELECT lang, word, count(*) AS n, max(n_chars) AS longest FROM t WHERE word <> '' GROUP BY ALL"""


def _word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("lang", "n_chars", "doc_id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("word"))
    (out,) = agg.aggregate(docs, [Aggregation("doc_id", "count", ["lang", "word"], alias="n"), Aggregation("n_chars", "max", ["lang", "word"], alias="longest")])
    return out.where("word <> ''")


@query(_WORD_GROUPS)
def agg_exploded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and word: a key that is an array counts a row once per element."""
    return _word_groups(spark, sf_dir)


agg_exploded_keys_all = agg_exploded_keys


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS grouping_id
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"""
)
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [["l_returnflag", "l_linestatus"], ["l_returnflag"], []]
    return agg.grouping_sets(table(spark, sf_dir, "lineitem"), sets, F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count("*").alias("n"))


_PRIORITIES, _STATUS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], ["F", "O", "P"]


@query(
    """WITH c AS (SELECT a.l_linestatus AS truth, b.l_linestatus AS guess, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 GROUP BY ALL),
    m AS (SELECT truth, CAST(coalesce(sum(n) FILTER (guess = 'F'), 0) AS DOUBLE) AS "p_F", CAST(coalesce(sum(n) FILTER (guess = 'O'), 0) AS DOUBLE) AS "p_O" FROM c GROUP BY truth),
    b AS (SELECT truth, "p_F", "p_O", "p_F" + "p_O" AS total, (CASE truth WHEN 'F' THEN "p_F" ELSE "p_O" END) / ("p_F" + "p_O") AS recall FROM m)
    SELECT truth, "p_F", "p_O", total, round(recall, 6) AS recall FROM b
    UNION ALL SELECT 'Total', sum("p_F"), sum("p_O"), sum(total), NULL FROM b
    UNION ALL SELECT 'Precision', round(sum("p_F") FILTER (truth = 'F') / sum("p_F"), 6), round(sum("p_O") FILTER (truth = 'O') / sum("p_O"), 6), NULL, NULL FROM b"""
)
def agg_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of lines against that of their order's first line."""
    lines = table(spark, sf_dir, "lineitem")
    first = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_linestatus").alias("guess"))
    both = lines.select("l_orderkey", F.col("l_linestatus").alias("truth")).join(first, "l_orderkey")
    out = agg.confusion_matrix(both, "truth", "guess", ["F", "O"])
    precise = F.col("truth") == "Precision"
    return out.select("truth", *[F.when(precise, F.round(c, 6)).otherwise(F.col(c)).alias(c) for c in ("p_F", "p_O")], "total", F.round("recall", 6).alias("recall"))


@query(
    """SELECT o_orderpriority, rank, o_orderstatus, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) AS rank
    FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority <> o_orderstatus GROUP BY ALL)) WHERE rank <= 2"""
)
def agg_top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.top_confusions(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", 2)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def agg_top_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.top_frequent(table(spark, sf_dir, "orders"), "o_custkey", 10)


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def agg_repeated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.repeated_values(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query(
    "SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r = 1"
)
def agg_first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.first_occurrences(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], "c_custkey")


@query(
    "SELECT event_type, key, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS value FROM (SELECT event_type, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events) WHERE value IS NOT NULL GROUP BY ALL"
)
def agg_sum_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-wise sums of the maps that events carry."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    return agg.sum_maps(e, "m", ["event_type"])


@query("SELECT n_regionkey, min(n_nationkey) AS first, list(n_name ORDER BY n_nationkey) AS values FROM nation GROUP BY n_regionkey")
def agg_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.groups(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name")


@query(
    """WITH s AS (SELECT DISTINCT p_name AS s FROM part UNION SELECT DISTINCT p_type || ' ' || p_name FROM part)
    SELECT s FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE length(b.s) > length(a.s) AND contains(' ' || b.s || ' ', ' ' || a.s || ' '))"""
)
def agg_longest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names without those that a longer name contains."""
    p = table(spark, sf_dir, "part")
    return agg.longest_only(p.select(F.col("p_name").alias("s")).union(p.select(F.concat_ws(" ", "p_type", "p_name"))), "s")


# ---- selection


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000")
def select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.in_range(table(spark, sf_dir, "orders"), "o_totalprice", 100000, 200000, closed_left=False).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def select_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of a status."""
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return selection.where_in_table(table(spark, sf_dir, "customer"), "c_custkey", keys, "o_custkey", negate=True).select("c_custkey", "c_name")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3"""
)
def select_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")]
    return selection.top_per_group(lines, ["l_orderkey"], order, 3).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
    LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY 1) USING (event_type) WHERE r > coalesce(n, 0)"""
)
def select_drop_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset difference that keeps order."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    counts = e.where("value > 100").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    return selection.drop_counted(e, "event_type", "event_id", counts).select("event_id", "event_type")


@query(
    """WITH f AS (SELECT user_id, min(event_id) AS a FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT event_id, user_id FROM events LEFT JOIN f USING (user_id) WHERE a IS NULL OR event_id <= a"""
)
def select_until_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events up to the first purchase."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return selection.until_first(e, F.col("event_type") == "purchase", "event_id", ["user_id"]).select("event_id", "user_id")


@query(
    """WITH f AS (SELECT user_id, min(event_id) AS a FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT event_id, user_id FROM events JOIN f USING (user_id) WHERE event_id > a"""
)
def select_after_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return selection.after_first(e, F.col("event_type") == "purchase", "event_id", ["user_id"]).select("event_id", "user_id")


@query("SELECT * FROM (SELECT p_partkey, p_retailprice FROM part ORDER BY abs(p_retailprice - 950.05), p_retailprice, p_partkey LIMIT 7)")
def select_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return selection.closest(p.orderBy("p_partkey"), "p_retailprice", 950.05, 7)


# ---- reshaping


@query(
    "SELECT key, source FROM (SELECT c_nationkey AS key, 'customer' AS source, 0 AS t FROM customer UNION ALL SELECT s_nationkey, 'supplier', 1 FROM supplier) QUALIFY row_number() OVER (PARTITION BY key ORDER BY t) = 1"
)
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in order of first occurrence over two tables."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.lit("customer").alias("source"), F.col("c_custkey").alias("o"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.lit("supplier").alias("source"), F.col("s_suppkey").alias("o"))
    return reshape.union_distinct([a, b], "o", ["key"]).select("key", "source")


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.intersect(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT p_size AS key FROM part EXCEPT ALL SELECT p_size FROM part WHERE p_type = 'ECONOMY'")
def set_subtract_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return reshape.subtract(p.select(F.col("p_size").alias("key")), p.where("p_type = 'ECONOMY'").select("p_size"), counted=True)


@query(
    """SELECT p_partkey, w.word, t.tag FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) w JOIN (SELECT p_partkey, unnest([p_type, p_brand]) AS tag FROM part) t USING (p_partkey)"""
)
def reshape_explode_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per word and tag of a part."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("word"), F.array("p_type", "p_brand").alias("tag"))
    return reshape.explode_columns(p, ["word", "tag"], "product")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest([p_type, p_brand]) AS tag FROM part")
def reshape_explode_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("word"), F.array("p_type", "p_brand").alias("tag"))
    return reshape.explode_columns(p, ["word", "tag"], "zip")


@query("SELECT user_id, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 7) AS BIGINT) AS chunk FROM events")
def reshape_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.chunks(table(spark, sf_dir, "events").select("user_id", "event_id"), ["event_id"], 7, ["user_id"])


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f(user_id, i, held, chunk) AS (SELECT user_id, i, value, 0 FROM e WHERE i = 1 UNION ALL
    SELECT e.user_id, e.i, CASE WHEN f.held + e.value > 100 THEN e.value ELSE f.held + e.value END, CASE WHEN f.held + e.value > 100 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, event_id, value, chunk FROM e JOIN f USING (user_id, i)"""
)
def reshape_weighted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in chunks of bounded value."""
    return reshape.weighted_chunks(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["event_id"], "value", 100.0, ["user_id"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, ntile(3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS split FROM lineitem")
def reshape_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = reshape.splits(lines, ["l_linenumber", "l_partkey", "l_suppkey"], 3, ["l_orderkey"])
    return out.drop("l_suppkey").withColumn("split", F.col("split").cast("bigint"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * 100 / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def reshape_distribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 shared out by quantity within each order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return reshape.distribute(lines, "l_quantity", 100, ["l_orderkey"]).drop("l_quantity").withColumn("share", F.round("share", 6))


@query("SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def reshape_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return reshape.unpivot(p, ["p_partkey"], ["p_size", "p_retailprice"])


@query(
    "SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '_' || (r - 1) END AS p_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)"
)
def reshape_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.unique_names(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"])


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|0'), o_orderkey LIMIT 100")
def sample_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample that depends on the keys only."""
    return selection.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)
