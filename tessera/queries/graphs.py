"""Graph and tree queries: customers, nations and regions, and the orders and parts between customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.operators import graph
from tessera.operators.components import connected_components

_EDGES = """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS s, 'p' || l_partkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey 
    UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to part by the orders, part to supplier, supplier to nation."""
    o, lines, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    bought = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(named("c", "o_custkey").alias("source_id"), named("p", "l_partkey").alias("target_id"))
    made = lines.select(named("p", "l_partkey"), named("s", "l_suppkey"))
    return bought.union(made).union(s.select(named("s", "s_suppkey"), named("n", "s_nationkey"))).distinct()


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("start"))


@query(
    f"""{_EDGES}, b(start, node, depth) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer WHERE c_custkey % 20 = 0
    UNION SELECT b.start, e.t, b.depth + 1 FROM b JOIN e ON b.node = e.s WHERE b.depth < 3)
    SELECT start, node, min(depth) AS depth FROM b GROUP BY ALL HAVING min(depth) > 0"""
)
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every twentieth customer reaches in three steps."""
    return graph.neighbours(_edges(spark, sf_dir), _starts(spark, sf_dir), 3)


@query(
    f"""{_EDGES} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e) GROUP BY node"""
)
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


graph_neighbours_all, graph_degrees_all = graph_neighbours, graph_degrees


@query(
    """WITH RECURSIVE l AS (SELECT DISTINCT 'c' || c_nationkey AS a, 'r' || n_regionkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    w(node, c) AS (SELECT a, a FROM u UNION SELECT u.a, w.c FROM u JOIN w ON u.b = w.node) SELECT node, min(c) AS component FROM w GROUP BY node"""
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions that hang together."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    links = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return connected_components(links.distinct())


@query()
def graph_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, parts, suppliers and nations that hang together; recursive SQL would list every pair of them."""
    return connected_components(_edges(spark, sf_dir), "source_id", "target_id")


@query(
    """SELECT node_id, score FROM (SELECT 'p' || p_partkey AS node_id,
    len(list_intersect(list_distinct(list_transform(string_split('part ' || p_name || ' ' || p_brand || ' size: ' || p_size, ' '), lambda w: regexp_replace(lower(w), '[^\\p{L}\\p{N}]', '', 'g'))), ['red', 'bolt', 'size'])) / 3.0 AS score FROM part)
    WHERE score > 0 ORDER BY score DESC, node_id LIMIT 50"""
)
def graph_search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, as nodes, by their text."""
    from tessera.operators.search import search

    p = table(spark, sf_dir, "part")
    props = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    nodes = p.select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.lit("part").alias("node_type"), F.col("p_name").alias("label"), props.alias("properties"))
    return search(nodes.withColumn("t", graph.node_text()), "red bolt size", 50, "overlap", "node_id", "t", stem=False).select("node_id", "score")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    key = lambda letter, col: F.concat(F.lit(letter), F.col(col))
    rows = r.select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("v"))
    return rows.union(n.select(key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit(0.0))).union(c.select(key("c", "c_custkey"), key("n", "c_nationkey"), F.col("c_acctbal")))


@query(
    """SELECT 'r' || r_regionkey AS node, 0 AS depth, 'r' || r_regionkey AS root FROM region UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'c' || c_custkey, 2, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tree_levels(_tree(spark, sf_dir), "node", "parent")


@query(
    """SELECT 'c' || c_custkey AS node, round(c_acctbal, 2) AS total FROM customer UNION ALL SELECT 'n' || n_nationkey, round(coalesce(sum(c_acctbal), 0), 2) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
    UNION ALL SELECT 'r' || r_regionkey, round(coalesce(sum(c_acctbal), 0), 2) FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey"""
)
def tree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances summed up the tree."""
    return graph.subtree_sums(_tree(spark, sf_dir), "node", "parent", "v").withColumn("total", F.round("total", 2))


@query(
    """WITH w AS (SELECT string_split(p_name, ' ') AS w FROM part), x AS (SELECT w[1:i] AS prefix, i, len(w) AS n FROM w, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i))
    SELECT prefix, CAST(any_value(i) AS INTEGER) AS depth, count(*) AS n, count(*) FILTER (i = n) AS complete FROM x GROUP BY prefix"""
)
def tree_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tree of the words of part names."""
    return graph.prefixes(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("w")), "w")
