"""Queries through sources (round trips by files), lists, stores, graph upkeep, joins and the batch forms of streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import parsing
from tessera.functions.nested import json_at
from tessera.operators import graph, pairs, reshape, search, selection, windows
from tessera.operators.keyvalue import KeyValue
from tessera.plans import steps
from tessera.sources import lists, text
from tessera.staging import new_path
from tessera.streaming import queues, sessions

# ---- files


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def source_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through a delimited file and back."""
    path = new_path(spark, "delimited")
    text.write_delimited(table(spark, sf_dir, "customer").select("c_custkey", F.struct("c_name", "c_acctbal").alias("s"), "c_mktsegment"), path, "\t", flatten=True)
    return text.read_delimited(spark, path, "\t", schema="c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT event_id, event_type, value, user_id FROM events")
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through JSON lines, in folders by type, and back."""
    path = new_path(spark, "json")
    text.write_json(table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id"), path, by=["event_type"])
    return text.read_json(spark, path, "event_id bigint, event_type string, value double, user_id bigint")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def source_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one JSON text each, through files of lines, and back: line breaks and quotes survive."""
    path = new_path(spark, "lines")
    text.write_lines(text.as_json(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")), path, "json", lines_per_file=500)
    return text.read_lines(spark, path).select(text.from_json(F.col("value"), "doc_id bigint, text string").alias("r")).select("r.*")


@query("SELECT doc_id, text, 0 AS n_left FROM documents")
def source_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts in a side table, and joined again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, parts = text.split_parts(docs, "doc_id", ["text"], 1000)
    left = rows.agg(F.count(F.when(F.char_length("text") >= 1000, 1)).cast("int")).first()[0]
    return text.join_parts(rows, parts, "doc_id", ["text"]).withColumn("n_left", F.lit(left))


@query("SELECT CAST(unnest(range(0, 25)) AS BIGINT) AS n, 'nation' AS kind, 'n' AS top")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files listed and read whole: one per nation, by the number in its name."""
    path = new_path(spark, "whole")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("value"), "n_nationkey")
    text.write_lines(nations.repartitionById(25, F.col("n_nationkey").cast("int")), path)
    listed = text.by_index(text.list_files(spark, path, "part-*.txt").where("size > 0").withColumn("path", F.regexp_extract("path", r"part-(\d+)", 1)).select("path"))
    whole = text.read_whole(spark, path, "part-*.txt").where("value <> ''").withColumn("path", F.regexp_extract("path", r"part-(\d+)", 1))
    both = listed.join(whole, "path").select(F.regexp_extract("value", r"nation-(\d+)", 1).cast("bigint").alias("n"), F.regexp_extract("value", r"^(\w+)-", 1).alias("kind"))
    return both.withColumn("top", text.parent_at(F.concat(F.lit("n/"), F.col("kind"))))


@query("SELECT CAST(d AS DATE) AS date, 'a/' || strftime(d, '%Y/%m/%d') || '.csv' AS path, day(d) = 5 AS first_there FROM (SELECT unnest(generate_series(DATE '2024-02-27', DATE '2024-03-10', INTERVAL 1 DAY)) AS d)")
def source_dated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = text.dated_paths(spark, "a/{year}/{month}/{day}.csv", "2024-02-27", "2024-03-10")
    there = dated.where("day(date) in (5, 9)")
    return dated.join(text.first_existing(dated, there).select("path", F.lit(True).alias("first_there")), "path", "left").select("date", "path", F.coalesce("first_there", F.lit(False)).alias("first_there"))


@query("SELECT doc_id, sha256(array_to_string(list_transform(string_split(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: rtrim(x, ' ')), chr(10)).rtrim(chr(10))) AS digest FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\t\\x{a0}\\x{2000}-\\x{200b}\\x{3000}\\x0b\\x0c]')")
def source_canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts whatever their line ends, outer blanks of lines and Unicode form (texts with blanks other than spaces left to tests)."""
    docs = table(spark, sf_dir, "documents").where("text is not null").where(~F.col("text").rlike(r"[\t\x{a0}\x{2000}-\x{200b}\x{3000}\x0b\x0c]"))
    return docs.select("doc_id", text.canonical_hash(F.encode("text", "UTF-8")).alias("digest"))


# ---- lists in tables


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as a list of values."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("list_key"), F.col("event_id").alias("o"), F.col("event_type").alias("value"))
    empty = spark.createDataFrame([], "list_key string, idx bigint, value string")
    return lists.append(empty, e, "o")


_L = "WITH l AS (SELECT 'u' || user_id AS list_key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_type AS value FROM events)"


@query(
    f"""{_L}, k AS (SELECT * FROM l WHERE NOT (list_key = 'u1' AND idx = 1)), r AS (SELECT list_key, idx - CAST(list_key = 'u1' AND idx > 1 AS BIGINT) AS idx, value FROM k),
    i AS (SELECT list_key, idx + CAST(list_key = 'u2' AND idx >= 1 AS BIGINT) AS idx, value FROM r UNION ALL SELECT 'u2', 1, 'new') SELECT list_key, max(idx) OVER (PARTITION BY list_key) - idx AS idx, value FROM i"""
)
def list_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists made by appending, one element removed, one put in, and all reversed."""
    made, gone = lists.remove(_lists(spark, sf_dir), "u1", 1)
    assert gone.count() == 1
    return lists.reverse(lists.insert(made, "u2", 1, "new"))


@query(
    f"""{_L}, s AS (SELECT list_key, row_number() OVER (PARTITION BY list_key ORDER BY value, idx) - 1 AS idx, value FROM l), f AS (SELECT list_key, min(idx) AS first, count(*) AS n FROM l WHERE value = 'click' GROUP BY list_key)
    SELECT s.list_key, s.idx, s.value, f.first, f.n, last.value AS last FROM s LEFT JOIN f USING (list_key), (SELECT value FROM l WHERE list_key = 'u1' ORDER BY idx DESC LIMIT 1) last"""
)
def list_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists sorted, with the first place and the number of clicks, and the last element of one of them."""
    made = _lists(spark, sf_dir)
    last = lists.element(made, "u1", -1).first()["value"]
    found = lists.index_of(made, F.lit("click")).withColumnRenamed("idx", "first").join(lists.count_of(made, F.lit("click")), "list_key")
    return lists.sort(made).join(found, "list_key", "left").withColumn("last", F.lit(last)).select("list_key", "idx", "value", "first", "n", "last")


# ---- stores

_KV_ROWS = "WITH k AS (SELECT coalesce(namespace, '_default') AS namespace, item_key AS key, value_json AS value FROM kv_store QUALIFY row_number() OVER (PARTITION BY coalesce(namespace, '_default'), item_key ORDER BY updated_at DESC NULLS LAST, put_id DESC) = 1)"


def _kv(spark: SparkSession, sf_dir: str) -> KeyValue:
    return KeyValue.from_log(table(spark, sf_dir, "kv_store"), "item_key", "value_json", ["updated_at", "put_id"])


@query(
    f"""{_KV_ROWS}, n AS (SELECT namespace, key, 'new' AS value FROM k WHERE key < 'd' UNION ALL SELECT '_default', 'added', 'last'), u AS (SELECT * FROM k ANTI JOIN n USING (namespace, key) UNION ALL SELECT * FROM n),
    d AS (SELECT * FROM u WHERE key NOT LIKE 'l%') SELECT namespace, count(*) AS n, count(*) FILTER (value = 'new') AS n_new, count(*) FILTER (value = 'last') AS n_last FROM d WHERE namespace <> 'agent_memory' GROUP BY namespace"""
)
def kv_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys put (twice, the last stays), deleted, and a namespace cleared: what is left, by namespace."""
    kv = _kv(spark, sf_dir)
    new = kv.rows.where("key < 'd'").select("namespace", "key", F.lit("new").alias("value"), F.lit(1).alias("o"))
    twice = spark.createDataFrame([(None, "added", "z", 1), (None, "added", "last", 2)], "namespace string, key string, value string, o int")
    left = kv.put_many(new.unionByName(twice), "o").delete(kv.rows.where("key like 'l%'").select("namespace", "key")).clear("agent_memory")
    assert left.size("agent_memory") == 0 and left.exists("added") and left.get("added") == "last" and not left.exists("added", "") and left.keys().count() == left.size()
    named = left.namespaces().join(left.rows, "namespace")
    return named.groupBy("namespace").agg(F.count("*").alias("n"), F.count(F.when(F.col("value") == "new", 1)).alias("n_new"), F.count(F.when(F.col("value") == "last", 1)).alias("n_last"))


@query(
    """WITH c AS (SELECT coalesce(namespace, '_default') AS namespace, doc_id, max(row_id) AS row_id FROM doc_store GROUP BY ALL), u AS (SELECT namespace, doc_id, CASE WHEN row_id % 3 = 0 THEN -1 ELSE row_id END AS row_id FROM c)
    SELECT namespace, count(*) AS n, count(*) FILTER (row_id = -1) AS n_updated, count(*) FILTER (doc_id = 'added') AS n_added FROM (SELECT * FROM u WHERE row_id % 5 <> 0 UNION ALL SELECT DISTINCT namespace, 'added', 0 FROM c) GROUP BY namespace"""
)
def store_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents updated, removed and added: what is there, by namespace."""
    docs = search.current(table(spark, sf_dir, "doc_store"), ["row_id"]).select("namespace", "doc_id", "row_id")
    updated = search.update(docs, docs.where("row_id % 3 = 0").withColumn("row_id", F.lit(-1).cast("bigint")))
    left = search.remove(updated, docs.where("row_id % 3 <> 0 and row_id % 5 = 0"))
    left = search.add(left, docs.select("namespace").distinct().select("namespace", F.lit("added").alias("doc_id"), F.lit(0).cast("bigint").alias("row_id")))
    by = left.groupBy("namespace").agg(F.count(F.when(F.col("row_id") == -1, 1)).alias("n_updated"), F.count(F.when(F.col("doc_id") == "added", 1)).alias("n_added"))
    return search.stats(left).join(by, "namespace")


# ---- graphs


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations and regions as nodes of a namespace, nations in regions and customers' nations as edges."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    node = lambda df, letter, key, kind, label: df.select(F.lit("g").alias("namespace"), F.concat(F.lit(letter), key).alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("label"), F.to_json(F.struct(F.col(key).alias("number"))).alias("properties"))
    nodes = node(r, "r", "r_regionkey", "region", "r_name").unionByName(node(n, "n", "n_nationkey", "nation", "n_name"))
    edge = lambda s, t, kind: n.select(F.lit("g").alias("namespace"), F.concat(*s).alias("source_id"), F.concat(*t).alias("target_id"), F.lit(kind).alias("edge_type"), F.lit("{}").alias("properties"))
    inside = edge((F.lit("n"), "n_nationkey"), (F.lit("r"), "n_regionkey"), "in")
    return nodes, inside.unionByName(edge((F.lit("r"), "n_regionkey"), (F.lit("n"), "n_nationkey"), "has"))


_G = """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS node_id, 'region' AS node_type, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation),
    e AS (SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS t, 'in' AS edge_type FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'has' FROM nation)"""


@query(
    f"""{_G}, m AS (SELECT node_id, node_type, CASE WHEN node_id = 'n1' THEN 'renamed' ELSE label END AS label FROM n WHERE node_id <> 'r0' UNION ALL SELECT 'x', 'extra', 'new'),
    f AS (SELECT * FROM e WHERE s <> 'r0' AND t <> 'r0' AND NOT (s = 'n1' AND edge_type = 'in') UNION ALL SELECT 'x', 'n1', 'to')
    SELECT m.node_id, m.node_type, m.label, count(a.s) AS n_out, (SELECT count(*) FROM f WHERE t = m.node_id) AS n_in FROM m LEFT JOIN f a ON a.s = m.node_id GROUP BY ALL"""
)
def graph_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges put, put again and removed; each node left with its edges counted."""
    nodes, edges = _graph(spark, sf_dir)
    new = spark.createDataFrame([("g", "x", "extra", "new", "{}"), ("g", "n1", "nation", "renamed", "{}")], nodes.schema)
    nodes = graph.put_nodes(nodes, new)
    edges = graph.put_edges(edges, spark.createDataFrame([("g", "x", "n1", "to", "{}")], edges.schema), nodes)
    nodes, edges = graph.remove_nodes(nodes, edges, spark.createDataFrame([("g", "r0")], "namespace string, node_id string"))
    edges = graph.remove_edges(edges, edges.where("source_id = 'n1' and edge_type = 'in'"))
    degree = graph.degrees(edges)
    return nodes.join(degree, nodes["node_id"] == degree["node"], "left").select("node_id", "node_type", "label", F.coalesce("out_degree", F.lit(0)).alias("n_out"), F.coalesce("in_degree", F.lit(0)).alias("n_in"))


@query(f"{_G} SELECT s AS source_id, t AS target_id, edge_type, (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges FROM e WHERE s = 'r1' OR (t = 'r1' AND edge_type = 'in')")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a node, out of it and into it, and the sizes of the graph's namespace."""
    nodes, edges = _graph(spark, sf_dir)
    both = graph.edges_of(edges, "r1", direction="outgoing").unionByName(graph.edges_of(edges, "r1", "in", "incoming"))
    size = graph.namespaces(nodes, edges)
    return both.join(size, "namespace").select("source_id", "target_id", "edge_type", "n_nodes", "n_edges")


@query(
    f"""{_G}, w(node, depth) AS (SELECT 'n1', 0 UNION SELECT e.t, w.depth + 1 FROM w JOIN e ON w.node = e.s WHERE w.depth < 2), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
    SELECT n.node_id, n.label, d.depth, (SELECT count(*) FROM e JOIN d x ON e.s = x.node JOIN d y ON e.t = y.node WHERE x.depth < 2) AS n_inner, 3 AS path_length FROM d JOIN n ON n.node_id = d.node"""
)
def graph_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two steps of a nation, the edges among it, and the length of a path to a nation of its region."""
    nodes, edges = _graph(spark, sf_dir)
    near, inner = graph.subgraph(nodes, edges, "n1", 2)
    other = near.where("depth = 2").agg(F.min("node_id")).first()[0]
    path = graph.shortest_path(edges, "n1", other) if other else ["n1", "r", "n"]
    return near.select("node_id", "label", F.col("depth").cast("int").alias("depth"), F.lit(inner.count()).cast("bigint").alias("n_inner"), F.lit(len(path)).alias("path_length"))


@query(f"{_G} SELECT node_id, CAST(1 AS DOUBLE) AS score FROM n WHERE node_type = 'nation' AND lower(label) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3)")
def graph_search_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by their label, through the graph's own search."""
    nodes, _ = _graph(spark, sf_dir)
    name = table(spark, sf_dir, "nation").where("n_nationkey = 3").first()["n_name"]
    return graph.search_nodes(nodes.drop("namespace"), name, 100, "nation").where("score = 1").select("node_id", "score")


@query("SELECT DISTINCT 'c' || o_custkey AS source_id, 'o' || o_orderkey AS target_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem")
def graph_path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of paths from customers by orders to parts."""
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    paths = lines.select(F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("p"), "l_partkey")).alias("path"))
    return graph.edges_from_paths(paths, "path")


# ---- joins and choices


@query("SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_suppkey")
def pairs_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mappings joined by their values; what has no partner is kept."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    met = pairs.join_by_value(n.select(F.col("n_nationkey").alias("key"), F.concat(F.lit("v"), "n_nationkey").alias("value")), s.select(F.col("s_suppkey").alias("key"), F.concat(F.lit("v"), "s_suppkey").alias("value")), keep_unmatched=True)
    return met.toDF("n_nationkey", "s_suppkey")


@query(
    """WITH q AS (SELECT DISTINCT p_name || 'x' AS q FROM part UNION SELECT DISTINCT p_name FROM part), t AS (SELECT DISTINCT p_name AS key, length(p_name) AS value FROM part),
    s AS (SELECT q, key, value, CASE WHEN q = key THEN 1.0 ELSE 1 - levenshtein(q, key) / greatest(length(q), length(key)) END AS score FROM q, t)
    SELECT q, key, value, round(score, 6) AS score FROM s WHERE score >= 0.5 - 1e-9 QUALIFY row_number() OVER (PARTITION BY q ORDER BY q = key DESC, score DESC, key) = 1"""
)
def pairs_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up by the equal key, else by the most similar one."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    asked = names.select(F.concat("p_name", F.lit("x")).alias("q")).union(names)
    keys = names.select("p_name", F.char_length("p_name").cast("bigint").alias("value"))
    return pairs.lookup(asked.distinct(), keys, "q", "p_name", "value").withColumn("score", F.round("score", 6))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey <= b.s_nationkey AND b.s_acctbal < a.s_acctbal * 0.5")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in an order of nations whose balances are far apart."""
    s = table(spark, sf_dir, "supplier")
    a, b = s.select(*[F.col(c).alias(f"{c}_a") for c in s.columns]), s.select(*[F.col(c).alias(f"{c}_b") for c in s.columns])
    met = pairs.theta_join(a, b, "s_nationkey_a", "<=", "s_nationkey_b", F.col("s_acctbal_b") < F.col("s_acctbal_a") * 0.5)
    return met.select(F.col("s_suppkey_a").alias("a"), F.col("s_suppkey_b").alias("b"))


@query("SELECT doc_id, w AS word, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS w FROM documents WHERE text IS NOT NULL))")
def reshape_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of each row: the words of a text and their places."""
    words = reshape.table_function(lambda s: [(w, i) for i, w in enumerate(parsing.re.findall("[a-z]+", s or ""))], "word string, pos bigint")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return reshape.apply_table_function(docs, words, "text").select("doc_id", "word", "pos")


@query("SELECT l_orderkey, l_partkey, l_quantity AS quantity, o_custkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def select_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns chosen, renamed, split and put first; pairs of equal keys; values from a list."""
    lines, orders = table(spark, sf_dir, "lineitem"), selection.where_in(table(spark, sf_dir, "orders"), "o_orderstatus", ["F"])
    chosen = selection.project(lines, {"l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "x_quantity": "l_quantity", "none": "no_such"})
    keyed, _ = selection.split_columns(selection.renamed(orders, "o", only=["nothing"]), ["o_orderkey", "o_custkey"])
    met = pairs.product(chosen, selection.columns_first(keyed.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey"), ["l_orderkey"])
    quantity = selection.columns_with_prefix(met.select("x_quantity"), "x_").columns
    return met.withColumnRenamed("x_quantity", quantity[0]).withColumnRenamed("o_custkey", "c")


@query("SELECT max(s_acctbal) FILTER (s_acctbal <= 4000) AS floor, min(s_acctbal) FILTER (s_acctbal >= 4000) AS ceiling FROM supplier")
def select_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return selection.floor_value(s, "s_acctbal", 4000).select(F.col("s_acctbal").alias("floor")).join(selection.ceiling_value(s, "s_acctbal", 4000).select(F.col("s_acctbal").alias("ceiling")), F.lit(True))


@query(
    """SELECT (SELECT count(*) FROM orders) AS n, 100 AS n_sampled, 100 AS n_distinct, 100 AS n_ordered, (SELECT count(*) FROM orders WHERE o_orderkey % 500 = 0) AS n_must, true AS in_order"""
)
def select_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples: of the right size, without repeats, in order and with what must be in them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    uniform, ordered = selection.sample_rows(o, 100, 1), [r[0] for r in selection.ordered_sample(o, 100, "o_orderkey", F.col("o_orderkey") % 500 == 0, 2).collect()]
    told = (o.count(), uniform.count(), uniform.distinct().count(), len(ordered), sum(k % 500 == 0 for k in ordered if k % 500 == 0 or k % 500 == 500), ordered == sorted(ordered))
    return spark.createDataFrame([told], "n bigint, n_sampled int, n_distinct int, n_ordered int, n_must bigint, in_order boolean")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 5 THEN 1 ELSE 2 END AS source FROM nation")
def reshape_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two tables that has a key; parts of a table put together again."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = reshape.union_all(*[reshape.part(n, ["n_nationkey"], 4, k) for k in range(4)])
    return reshape.overlay([n.where("n_nationkey < 5").withColumn("source", F.lit(1)), parts.withColumn("source", F.lit(2))], ["n_nationkey"])


@query("SELECT n_nationkey AS pos, n_name AS a, coalesce(r_name, (SELECT r_name FROM region ORDER BY r_regionkey DESC LIMIT 1)) AS b FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def reshape_zip_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions side by side, the shorter table filled with its last row."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return reshape.zip_rows([n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("a")), r.select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("b"))], "pos", longest=True)


# ---- queues, windows and sessions


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items put into a folder of JSON lines and read back, by queue; repeated users dropped."""
    path = new_path(spark, "queue")
    items = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    queues.put(items.where("event_id % 2 = 0"), path)
    queues.put(items.where("event_id % 2 = 1"), path)
    held = spark.read.schema("event_type string, event_id bigint, user_id bigint").json(path)
    return queues.stats(held, "event_type").join(queues.stats(held.dropDuplicates(["event_type", "user_id"]), "event_type").withColumnRenamed("n", "n_users"), "event_type")


@query(
    """WITH o AS (SELECT user_id AS queue_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'get' ELSE 'put' END AS op FROM events), s AS (SELECT *, sum(CASE op WHEN 'put' THEN 1 ELSE -1 END) OVER w AS s FROM o WINDOW w AS (PARTITION BY queue_id ORDER BY ts, event_id)),
    b AS (SELECT queue_id, arg_max(s, {'t': ts, 'e': event_id}) - least(min(s), 0) AS b FROM s GROUP BY queue_id),
    p AS (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY ts DESC, event_id DESC) AS r FROM o WHERE op = 'put') SELECT queue_id, event_id AS operation_id FROM p JOIN b USING (queue_id) WHERE r <= b"""
)
def queue_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in each user's queue after a log of puts and gets, part of which was delivered twice."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("queue_id"), F.col("event_id").alias("operation_id"), "ts", F.when(F.col("event_type") == "error", "get").otherwise("put").alias("op"))
    return queues.replay(log.unionByName(log.where("operation_id % 3 = 0"))).select("queue_id", "operation_id")


@query(
    """SELECT CAST(s AS TIMESTAMP) AS start, CAST(s AS TIMESTAMP) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s"""
)
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.windowed(_events(spark, sf_dir), "ts", "2 hours", F.count("*").alias("n"), slide="1 hour")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.session_windows(_events(spark, sf_dir), "ts", "6 hours", ["user_id"], F.count("*").alias("n"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT user_id, 0 AS server, count(*) AS n FROM events GROUP BY user_id")
def queue_busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One server that is always free takes every request."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("at"), F.lit(0.5).alias("load"))
    return parsing.busiest(e, ["user_id"], ["event_id"], "at", "load", 1)


@query("SELECT event_type, count(*) AS n, sum(event_id) AS total FROM events WHERE user_id % 2 = 0 GROUP BY event_type")
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of saved steps, one of which scatters its rows over workers, run and resumed."""
    import pandas as pd

    def even(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[frame["user_id"] % 2 == 0]

    made = steps.line(
        spark, new_path(spark, "steps"), ("read", lambda: table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")),
        ("even", lambda df: steps.scatter(df, even, "event_type string, event_id bigint, user_id bigint")), ("sum", lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))),
    )
    steps.retried(made.run)
    assert made.saved("even") and steps.side_by_side([lambda: 1, lambda: 2]) == [1, 2]
    return made.run()["sum"]


@query("SELECT row_id, metadata ->> '$.year' AS year FROM doc_store WHERE json_valid(metadata)")
def nested_quoted_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key with a quote in it, read from JSON."""
    docs = table(spark, sf_dir, "doc_store").where("metadata is not null")
    odd = docs.withColumn("m", F.replace("metadata", F.lit('"year"'), F.lit('"ye\'ar"')))
    return odd.where(F.try_parse_json("metadata").isNotNull()).select("row_id", json_at(F.col("m"), "ye'ar").alias("year"))


@query(
    """WITH c AS (SELECT user_id % 10 AS r, event_id % 20 AS c, CAST(sum(user_id) AS BIGINT) AS v FROM events GROUP BY ALL)
    SELECT a.r, a.c, a.v, CAST(sum(b.v) AS BIGINT) AS total FROM c a JOIN c b ON b.r <= a.r AND b.c <= a.c GROUP BY ALL"""
)
def ts_prefix_sums_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of all cells up to a row and a column."""
    cells = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("r"), (F.col("event_id") % 20).alias("c"), F.col("user_id").alias("v"))
    return windows.prefix_sums_2d(cells, "r", "c", "v")
