"""Property graphs as node and edge tables: upkeep, neighbourhoods, paths, trees, node search.

Nodes: ``namespace, node_id, node_type, label, properties`` (JSON).  Edges: ``namespace, source_id, target_id, edge_type,
properties``.  An edge is unique by its ends and type; a self loop counts once in both directions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.diff import latest
from tessera.staging import stage

NODE_KEY, EDGE_KEY = ["namespace", "node_id"], ["namespace", "source_id", "target_id", "edge_type"]


def put_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id."""
    return nodes.join(new.select(*NODE_KEY), NODE_KEY, "left_anti").unionByName(new)


def put_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Upsert by ends and type; an end that is no node is an error."""
    for end in ("source_id", "target_id"):
        lost = new.select("namespace", F.col(end).alias("node_id")).join(nodes, NODE_KEY, "left_anti")
        if lost.head(1):
            raise ValueError(f"a {end} is no node")
    return edges.join(new.select(*EDGE_KEY), EDGE_KEY, "left_anti").unionByName(new)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone`` ``(namespace, node_id)``, and edges without theirs."""
    for end in ("source_id", "target_id"):
        edges = edges.join(gone.select("namespace", F.col("node_id").alias(end)), ["namespace", end], "left_anti")
    return nodes.join(gone, NODE_KEY, "left_anti"), edges.select(*[c for c in edges.columns])


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*EDGE_KEY), EDGE_KEY, "left_anti")


def edges_of(edges: DataFrame, node_id, edge_type: str | None = None, direction: str = "outgoing") -> DataFrame:
    """A node's edges: ``outgoing``, ``incoming`` or ``both``."""
    out, into = F.col("source_id") == node_id, F.col("target_id") == node_id
    test = {"outgoing": out, "incoming": into, "both": out | into}[direction]
    return edges.where(test if edge_type is None else test & (F.col("edge_type") == edge_type))


def neighbours(edges: DataFrame, starts: DataFrame, depth: int, src: str = "source_id", dst: str = "target_id") -> DataFrame:
    """``(start, node, depth)``: what each start reaches along outgoing edges within ``depth`` steps, at its least depth, itself
    left out.

    ``starts`` ``(start)`` may be many.  Each step joins the frontier with the edges and drops what was seen; it is staged, so no
    step is computed twice.
    """
    e = stage(edges.where(f"`{src}` is not null and `{dst}` is not null").select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct(), "edges")
    seen = stage(starts.where("start is not null").select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "bfs")
    frontier = seen
    layers = [seen]
    for d in range(1, depth + 1):
        step = frontier.join(e, "node").select("start", F.col("next").alias("node")).distinct()
        known = reduce(lambda a, b: a.unionAll(b), [layer.select("start", "node") for layer in layers])
        step = step.join(known, ["start", "node"], "left_anti")
        frontier = stage(step.withColumn("depth", F.lit(d)), "bfs")
        if frontier.isEmpty():
            break
        layers.append(frontier)
    out = layers[0].where("depth > 0")
    for layer in layers[1:]:
        out = out.unionAll(layer)
    return out


def shortest_path(edges: DataFrame, start, target, most: int | None = None, src: str = "source_id", dst: str = "target_id") -> list | None:
    """The nodes of a shortest path, by breadth-first layers that keep one parent (the least) per node; null if there is none.

    With ``most``, a search that has neither ended nor found the target after so many steps is an error.
    """
    if start == target:
        return [start]
    e = stage(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct(), "edges")
    spark = edges.sparkSession
    kind = e.schema["node"].dataType.simpleString()
    first = spark.createDataFrame([(start,)], f"node {kind}")
    layers = [first.withColumn("parent", F.lit(None).cast(kind))]
    seen = first
    while most is None or len(layers) <= most:
        step = layers[-1].select(F.col("node").alias("p")).join(e, F.col("p") == F.col("node"))
        step = step.groupBy("next").agg(F.min("p").alias("parent")).withColumnRenamed("next", "node")
        step = stage(step.join(seen, "node", "left_anti"), "path")
        layers.append(step)
        if step.where(F.col("node") == target).head(1):
            path = [target]
            for layer in reversed(layers[1:]):
                path.append(layer.where(F.col("node") == path[-1]).first()["parent"])
            return path[::-1]
        if step.isEmpty():
            return None
        seen = seen.unionAll(step.select("node"))
        if len(layers) % 16 == 0:  # so that the plan does not grow with the path
            seen = stage(seen, "seen")
    raise RuntimeError(f"no end after {most} steps")


def subgraph(nodes: DataFrame, edges: DataFrame, start, depth: int = 1, edge_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes within ``depth`` steps of a start, it among them, and the edges between them.  An unknown start is an error."""
    if not nodes.where(F.col("node_id") == start).head(1):
        raise ValueError(f"unknown node {start}")
    chosen = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    first = nodes.where(F.col("node_id") == start).select(F.col("node_id").alias("start")).distinct()
    reached = stage(neighbours(chosen, first, depth).select(F.col("node").alias("node_id"), "depth").unionByName(first.select(F.col("start").alias("node_id"), F.lit(0).alias("depth"))), "sub")
    inner = reached.where(F.col("depth") < depth)
    kept = chosen.join(inner.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").join(reached.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
    return nodes.join(reached, "node_id"), kept.select(*edges.columns)


def degrees(edges: DataFrame, src: str = "source_id", dst: str = "target_id") -> DataFrame:
    """``(node, out_degree, in_degree)``."""
    ends = edges.select(F.inline(F.array(F.struct(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def node_text(properties: str = "properties") -> Column:
    """A node's text: type, label, then the properties in the order of their names, other than ``embedding_text``."""
    props = F.from_json(F.col(properties), "map<string,string>")
    entries = F.array_sort(F.map_entries(F.map_filter(props, lambda k, _: k != "embedding_text")))
    # a text stands by itself, another value after its name
    quoted = lambda e: F.col(properties).contains(F.concat(F.lit('"'), e["key"], F.lit('": "')))
    parts = F.transform(entries, lambda e: F.when(quoted(e), e["value"]).otherwise(F.concat(e["key"], F.lit(": "), e["value"])))
    return F.concat_ws(" ", F.col("node_type"), F.col("label"), F.array_join(F.coalesce(parts, F.array()), " "))


def search_nodes(nodes: DataFrame, query: str, k: int = 5, node_type: str | None = None) -> DataFrame:
    from tessera.operators.search import search

    rows = nodes if node_type is None else nodes.where(F.col("node_type") == node_type)
    return search(rows.withColumn("__text", node_text()), query, k, "overlap", "node_id", "__text").drop("__text")


def edges_from_paths(paths: DataFrame, path: str) -> DataFrame:
    """``(source_id, target_id)``: the steps of array paths, each once."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(F.element_at(path, i).alias("source_id"), F.element_at(path, i + 1).alias("target_id")))
    return paths.where(F.size(path) > 1).select(F.inline(pairs)).distinct()


def prefixes(df: DataFrame, sequence: str) -> DataFrame:
    """The nodes of a prefix tree: ``(prefix, depth, n, complete)``, ``n`` sequences begin with and ``complete`` equal the prefix."""
    each = df.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size(sequence)), lambda i: F.slice(F.col(sequence), F.lit(1), i))).alias("p", "prefix"), F.size(sequence).alias("size"))
    return each.groupBy("prefix").agg((F.min("p") + 1).alias("depth"), F.count("*").alias("n"), F.count(F.when(F.col("p") + 1 == F.col("size"), 1)).alias("complete"))


def tree_levels(nodes: DataFrame, node: str, parent: str, most: int = 64) -> DataFrame:
    """``(node, depth, root)`` of a forest, from the roots down; nodes in a cycle are left out."""
    n = stage(nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent")), "tree")
    level = stage(n.where("parent is null").select("node", F.lit(0).alias("depth"), F.col("node").alias("root")), "tree")
    out = level
    for d in range(1, most):
        level = stage(n.join(level.select(F.col("node").alias("parent"), "root"), "parent").select("node", F.lit(d).alias("depth"), "root"), "tree")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"deeper than {most}")


def tree_paths(nodes: DataFrame, node: str, parent: str, most: int = 64) -> DataFrame:
    """``(node, depth, path)`` of a forest: ``path`` holds the nodes from the root down.  Rows in the order of ``path`` are in preorder
    (depth first, siblings by id); nodes in a cycle are left out."""
    n = stage(nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent")), "tree")
    level = stage(n.where("parent is null").select("node", F.lit(0).alias("depth"), F.array("node").alias("path")), "tree")
    out = level
    for d in range(1, most):
        below = n.join(level.select(F.col("node").alias("parent"), "path"), "parent")
        level = stage(below.select("node", F.lit(d).alias("depth"), F.array_append("path", F.col("node")).alias("path")), "tree")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"deeper than {most}")


def acyclic_order(edges: DataFrame, src: str = "source_id", dst: str = "target_id", most: int = 1000) -> DataFrame:
    """``(node, rank)``: the length of the longest path to each node of an acyclic graph, so that every edge leads to a greater rank.
    Nodes without incoming edges have rank 0; a cycle is an error."""
    e = stage(edges.select(F.col(src).alias("s"), F.col(dst).alias("t")).where("s is not null and t is not null").distinct(), "dag")
    left = stage(e.select(F.col("s").alias("node")).union(e.select("t")).distinct(), "dag")
    out, rank = [], 0
    while not left.isEmpty():
        waiting = e.join(left.select(F.col("node").alias("s")), "s", "left_semi").select(F.col("t").alias("node")).distinct()
        ready = stage(left.join(waiting, "node", "left_anti").withColumn("rank", F.lit(rank)), "dag")
        if ready.isEmpty() or rank > most:
            raise ValueError("the graph has a cycle" if ready.isEmpty() else f"more than {most} ranks")
        out.append(ready)
        left = stage(left.join(ready, "node", "left_anti"), "dag")
        rank += 1
    if not out:
        return left.withColumn("rank", F.lit(0))
    return reduce(lambda a, b: a.unionByName(b), out)


def subtree_sums(nodes: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """``(node, total)``: each node's value and those below it, from the leaves up."""
    levels = stage(tree_levels(nodes, node, parent).join(nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(value).cast("double").alias("v")), "node"), "tree")
    deepest = levels.agg(F.max("depth")).first()[0]
    if deepest is None:
        return levels.select("node", F.col("v").alias("total"))
    below = levels.where(F.col("depth") == deepest).select("node", "parent", F.col("v").alias("total"))
    out = below.select("node", "total")
    for d in range(deepest - 1, -1, -1):
        sums = below.groupBy("parent").agg(F.sum("total").alias("s"))
        below = stage(levels.where(F.col("depth") == d).join(sums.select(F.col("parent").alias("node"), "s"), "node", "left").select("node", "parent", (F.col("v") + F.coalesce("s", F.lit(0.0))).alias("total")), "tree")
        out = out.unionByName(below.select("node", "total"))
    return out


def ladder(df: DataFrame, size: str, value: str, connects: Column) -> DataFrame:
    """``(size, values)`` in levels of rising size, each value of which must meet ``connects`` (on ``last`` and ``value``) with the
    last (greatest) of the level before; otherwise an error."""
    levels = stage(df.groupBy(size).agg(F.array_sort(F.collect_set(value)).alias("values"), F.max(value).alias("last")), "ladder")
    before = levels.withColumn("last", F.lag("last").over(Window.orderBy(size))).where("last is not null")
    if before.select("last", F.explode("values").alias("value")).where(~F.coalesce(connects, F.lit(False))).head(1):
        raise ValueError("a value does not connect to the level before")
    return levels.select(size, "values")


def namespaces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(namespace, n_nodes, n_edges)``."""
    a = nodes.groupBy("namespace").agg(F.count("*").alias("n_nodes"))
    b = edges.groupBy("namespace").agg(F.count("*").alias("n_edges"))
    return a.join(b, "namespace", "full").na.fill(0, ["n_nodes", "n_edges"])


def current_nodes(log: DataFrame, order: list[str]) -> DataFrame:
    return latest(log, NODE_KEY, order)
