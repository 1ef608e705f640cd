"""Relational operators, search, graphs, stores, sources, plans and streams on small tables."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate as agg
from tessera.operators import graph, intervals, pairs, reshape, search, selection, vectors, windows
from tessera.operators.aggregate import Aggregation
from tessera.operators.keyvalue import KeyValue
from tessera.plans.steps import Graph, Step, line, retried, scatter, side_by_side
from tessera.sources import lists, text
from tessera.staging import new_path
from tessera.streaming import queues, sessions

C = F.col


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- aggregation


def test_aggregate_explodes_keys(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "y"], 1), (["a"], ["x"], 2), ([], ["x"], 9)], "k array<string>, l array<string>, v int")
    by = lambda how: {(r.k, r.l): r.v for r in agg.aggregate(df, [Aggregation("v", "sum", ["k", "l"], how, "v")])[0].collect()}
    assert by("product") == {("a", "x"): 3, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 1}
    assert by("zip") == {("a", "x"): 3, ("b", "y"): 1, (None, "x"): 9}
    a, b = agg.aggregate(df, [Aggregation("v", "bmin", alias="all"), Aggregation("v", "bmax", alias="any"), Aggregation("v", "max", ["k"])])
    assert a.first().asDict() == {"all": 1, "any": 1} and b.columns == ["k", "v.max"]


def test_confusion(spark):
    df = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 2), ("b", "a", 2), ("c", "a", 1)], "t string, p string, n int")
    m = {r.t: r for r in agg.confusion_matrix(df, "t", "p", ["a", "b", "c"], "n").collect()}
    assert (m["a"].p_a, m["a"].p_b, m["a"].total, m["a"].recall) == (3, 1, 4, 0.75) and m["c"].recall == 0 and m["Total"].p_a == 6 and m["Precision"].p_a == 0.5 and m["Precision"].p_c is None
    assert rows(agg.top_confusions(df, "t", "p", 1, "n")) == [("a", 1, "b", 1), ("b", 1, "a", 2), ("c", 1, "a", 1)]
    e = agg.confusion_examples(df.withColumn("d", F.array(C("n").cast("string"))), "t", "p", "d").collect()
    assert {r.key: r.examples for r in e}["b-a"] == ["2"]


def test_confusion_examples_are_all_there(spark):
    df = spark.createDataFrame([("a", "b", [f"{i:03}", f"{i:03}"]) for i in range(150)] + [("b", "a", ["x"])], "t string, p string, d array<string>")
    want = sorted([f"{i:03}" for i in range(150)] * 2)
    assert {r.key: r.examples for r in agg.confusion_examples(df, "t", "p", "d").collect()} == {"a-b": want, "b-a": ["x"]}
    assert rows(agg.confusion_example_rows(df, "t", "p", "d")) == [*[("a-b", x) for x in want], ("b-a", "x")]


def test_merges(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (2, {"a": 5})], "o int, m map<string,int>")
    assert rows(agg.sum_maps(df, "m")) == [("a", 6), ("b", 2)] and rows(agg.merge_maps(df, "m", "o")) == [("a", 5), ("b", 2)]
    s = spark.createDataFrame([({"a": ["x", "y"]},), ({"a": ["x"]},)], "m map<string,array<string>>")
    assert rows(agg.merge_set_maps(s, "m")) == [("a", ["x", "y"])]
    words = spark.createDataFrame([("red bolt",), ("red",), ("bolts",), ("a red bolt",), (None,)], "s string")
    assert rows(agg.longest_only(words, "s")) == [("a red bolt",), ("bolts",)]


# ---- ordered rows


def ordered(spark, values):
    return spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")


def test_windows(spark):
    df = ordered(spark, [1.0, 2.0, 0.0, 4.0])
    assert [r.v_pct for r in windows.pct_change(df, ["v"], ["g"], ["i"]).orderBy("i").collect()] == [None, 1.0, -1.0, None]
    r = windows.rolling(df, ["v"], [2], ["g"], ["i"]).orderBy("i").collect()
    assert [x.v_median_2 for x in r] == [None, 1.5, 1.0, 2.0] and [x.v_min_2 for x in r] == [None, 1, 0, 0]
    assert [x.v_mean_3 for x in windows.moving_average(df, "v", 3, ["g"], ["i"]).orderBy("i").collect()] == [1, 1.5, 1, 2]
    w = lambda **k: [(x.pos, x.past, x.future) for x in windows.windows(df, "v", 2, 2, ["g"], ["i"], **k).orderBy("pos").collect()]
    assert w() == [(2, [1, 2], [0, 4])] and w(partial=True) == [(2, [1, 2], [0, 4]), (3, [2, 0], [4])]
    tie = ordered(spark, [3.0, 1.0, 3.0])
    assert [x.max_pos for x in windows.side_max(tie, "v", "i", ["g"]).orderBy("i").collect()] == [2, 2, 2] and [x.max_pos for x in windows.side_max(tie, "v", "i", ["g"], right=False).orderBy("i").collect()] == [0, 0, 0]
    assert rows(windows.longest_run(ordered(spark, [1.0, 1.0, 2.0, 0.0, 1.0, 2.0]), "v", ["g"], ["i"])) == [("g", 3, 3)]
    assert [x.steps_to_larger for x in windows.next_larger(df, "v", ["g"], ["i"]).orderBy("i").collect()] == [1, 2, 1, -1]
    assert [x.running for x in windows.global_running(df, "v", "i").orderBy("i").collect()] == [1, 3, 3, 7]
    assert [x.i for x in windows.records(df, "v", ["g"], ["i"]).collect()] == [3] and [x.i for x in windows.local_extremes(df, "v", ["g"], ["i"]).orderBy("i").collect()] == [1, 3]
    assert [x.b for x in df.select(windows.bins(C("v"), [1, 3]).alias("b")).collect()] == ["1", "1", "-inf", "3"] and [x.b for x in df.select(windows.bins(C("v"), [1, 3], right_closed=True).alias("b")).collect()] == ["-inf", "1", "-inf", "3"]


def test_weeks_without_data(spark):
    df = spark.createDataFrame([], "day date, v double")
    assert windows.weekly_change(df, "day", "v", "2024-01-30", 28).count() == 0


def test_asof(spark):
    a = spark.createDataFrame([(1, 10, "x"), (1, 20, "y"), (2, 5, "z")], "k int, t int, n string")
    b = spark.createDataFrame([(1, 10, 1.0), (1, 15, None), (2, 6, 3.0)], "k int, t int, v double")
    assert rows(windows.asof(a, b, ["k"], "t", ["v"])) == [(1, 10, "x", 1.0), (1, 20, "y", None), (2, 5, "z", None)]
    assert rows(windows.asof(a, b, ["k"], "t", ["v"], backward=False)) == [(1, 10, "x", 1.0), (1, 20, "y", None), (2, 5, "z", 3.0)]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 7), ("a", 8, 9), ("b", 1, 4), ("b", 2, 3)], "g string, s int, e int")
    assert rows(intervals.merge_intervals(df, "s", "e", ["g"])) == [("a", 1, 5), ("a", 7, 7), ("a", 8, 9), ("b", 1, 4)]
    assert rows(intervals.has_overlap(df, "s", "e", ["g"])) == [("a", False), ("b", True)] and rows(intervals.max_overlap(df, "s", "e", ["g"])) == [("a", 1), ("b", 2)]
    r = random.Random(1)
    spans = [(i, r.randint(0, 50), r.randint(0, 9)) for i in range(40)]
    x = spark.createDataFrame([(i, s, s + n) for i, s, n in spans], "i int, s int, e int")
    met = intervals.interval_join(x, x.toDF("j", "s2", "e2"), "s", "e", "s2", "e2", 4.0).select("i", "j").collect()
    assert sorted(map(tuple, met)) == sorted((a, b) for a, s, n in spans for b, t, m in spans if s <= t + m and t <= s + n)


def test_selection(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "i int, s string")
    ids = lambda d: sorted(r.i for r in d.collect())
    assert ids(selection.in_range(df, "i", 1, 3, closed_left=False)) == [2, 3] and ids(selection.where_in(df, "i", [])) == list(range(6))
    assert ids(selection.until_first(df, C("i") == 2, "i")) == [0, 1, 2] and ids(selection.after_first(df, C("i") == 2, "i", keep=True)) == [2, 3, 4, 5] and ids(selection.until_first(df, C("i") == 99, "i")) == list(range(6)) and ids(selection.after_first(df, C("i") == 99, "i")) == []
    counts = spark.createDataFrame([("a", 2)], "value string, n int")
    assert ids(selection.drop_counted(df, "s", "i", counts)) == [1, 3, 4, 5]
    assert selection.ordered_sample(df, 3, "i", C("i") == 5).collect()[-1].i == 5 and selection.renamed(df, "p", once=True, only=["i"]).columns == ["p_i", "s"]
    assert ids(selection.closest(df, "i", 2.5, 2)) == [2, 3] and selection.floor_value(df, "i", 2.5).first()[0] == 2 and selection.ceiling_value(df, "i", 9).first()[0] is None
    assert selection.project(df, ["i", "nope"]).columns == ["i"] and rows(selection.project(df, {"x": C("i") + 1}, y=F.lit(1)).limit(1)) == [(1, 1)]
    assert set(selection.weighted_split(df, "i", [1, 1]).select("split").distinct().toPandas()["split"]) <= {0, 1}


def test_reshape(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x"])], "i int, k array<string>, l array<string>")
    assert rows(reshape.explode_columns(df, ["k", "l"], "longest")) == [(1, "a", "x"), (1, "b", "x"), (1, "c", "x")]
    w = spark.createDataFrame([("g", i, x) for i, x in enumerate([5.0, 1.0, 2.0, 3.0, None])], "g string, i int, w double")
    assert [r.chunk for r in reshape.weighted_chunks(w, ["i"], "w", 3.0, ["g"]).orderBy("i").collect()] == [0, 1, 1, 2, 2]
    assert [r.share for r in reshape.distribute(w.na.fill(0), "w", 22.0, ["g"], ["i"], cumulative=True).orderBy("i").collect()] == [10, 12, 16, 22, 22]
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "i int, a string"), spark.createDataFrame([(0, "p")], "i int, b string")
    assert rows(reshape.zip_rows([a, b], "i", longest=True)) == [(0, "x", "p"), (1, "y", "p")]
    assert rows(reshape.overlay([a, a.withColumn("a", F.lit("z")).union(spark.createDataFrame([(2, "z")], a.schema))], ["i"])) == [(0, "x"), (1, "y"), (2, "z")]
    assert reshape.transposed(a, "i").first().a == ["x", "y"]


# ---- pairs and vectors


def test_pairs(spark):
    p = spark.createDataFrame([("b", "s1", "t1", 0.9), ("b", "s1", "t2", 0.8), ("b", "s2", "t1", 0.85), ("b", "s2", "t3", 0.1), ("c", "s1", "t1", 0.5)], "k string, s string, t string, x double")
    assert rows(pairs.greedy_alignment(p, "s", "t", "x", ["k"])) == [("b", "s1", "t1", 0.9), ("b", "s2", "t3", 0.1), ("c", "s1", "t1", 0.5)]
    assert len(rows(pairs.best_per_source(p, "s", "t", "x"))) == 2
    names = spark.createDataFrame([("apple",), ("apples",), ("maple",), ("banana",)], "n string")
    got = rows(pairs.edit_distance_join(names, names.toDF("m"), "n", "m", 0.8, first_letter=False).where("n < m").select("n", "m"))
    assert got == [("apple", "apples")]
    table = spark.createDataFrame([("apple", 1), ("banana", 2)], "k string, v int")
    q = spark.createDataFrame([("apple",), ("banan",), ("zzzzzz",)], "q string")
    assert [(r.q, r.v) for r in pairs.lookup(q, table, "q", "k", "v").select("q", C("value").alias("v")).orderBy("q").collect()] == [("apple", 1), ("banan", 2)]
    a, b = spark.createDataFrame([("k1", "x"), ("k2", "y")], "key string, value string"), spark.createDataFrame([("m1", "x")], "key string, value string")
    assert rows(pairs.join_by_value(a, b, keep_unmatched=True)) == [("k1", "m1"), ("k2", None)]
    with pytest.raises(ValueError):
        pairs.join_by_value(a, b.union(b), unique=True)


@pytest.mark.parametrize("measure", ["cos", "dot", "l2", "l1"])
def test_nearest_equals_brute_force(spark, measure):
    r = np.random.default_rng(2)
    x = r.integers(-3, 4, (60, 5)).astype(float)
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, v array<double>").repartition(3)
    got = {}
    for h in vectors.nearest(df, df.where("id % 20 = 0"), "id", "v", 5, measure).collect():
        got.setdefault(h.query_id, []).append((h["rank"], h.id))
    for q in (0, 20, 40):
        f = {"cos": lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b), "dot": lambda a, b: a @ b, "l2": lambda a, b: -np.linalg.norm(a - b), "l1": lambda a, b: -np.abs(a - b).sum()}[measure]
        with np.errstate(invalid="ignore"):
            s = [(-round(float(f(x[q], x[i])), 12), i) for i in range(60) if i != q and np.isfinite(f(x[q], x[i]))]
        assert [i for _, i in sorted(got[q])] == [i for _, i in sorted(s)[:5]]


def test_kernels(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    k = lambda kind: df.select(vectors.kernel(C("a"), C("b"), kind)).first()[0]
    assert k("rbf") == pytest.approx(np.exp(-4)) and k("laplacian") == pytest.approx(np.exp(-2)) and k("polynomial") == pytest.approx(6.5**3) and k("sigmoid") == pytest.approx(np.tanh(6.5))


# ---- search and stores


def test_search(spark):
    docs = spark.createDataFrame(
        [("n", "d1", "red bolts, shopping", '{"y": 1}'), ("n", "d2", "a red ring", '{"y": 2}'), (None, "d3", "red bolt", None), ("n", "d4", None, '{"y": 1}'), ("n", "d5", "", "{}")],
        "namespace string, doc_id string, content string, meta string",
    )
    found = lambda q, **k: [(r.doc_id, round(r.score, 4)) for r in search.search(docs, q, **k).collect()]
    hit = lambda q, **k: found(q, namespace=search.EVERYWHERE, **k)
    assert hit("red bolt") == [("d1", 1.0), ("d3", 1.0), ("d2", 0.5)] and found("red bolt", namespace="n") == [("d1", 1.0), ("d2", 0.5)]
    assert found("red bolt", namespace="_default") == found("red bolt") == [("d3", 1.0)] and found("red bolt", namespace="") == []
    assert hit("shop", k=1) == [("d1", 1.0)] and hit("  ") == [] and hit("?!") == [] and hit("red bolts,", mode="plain", stem=False) == [("d1", 1.0), ("d2", 0.5), ("d3", 0.5)]
    assert hit("red", metadata="meta", filters={"y": 2}) == [("d2", 1.0)] and sorted(i for i, _ in hit("red bolt", mode="all")) == ["d1", "d3"]
    bm = hit("ring", mode="bm25")
    assert bm == [("d2", 1.0)]
    later = search.search_then_filter(docs, "red bolt", 1, "meta", {"y": 2}, prefetch=3, namespace=search.EVERYWHERE)
    assert [r.doc_id for r in later.collect()] == ["d2"] and search.search_then_filter(docs, "red bolt", 1, "meta", {"y": 2}, prefetch=1, namespace="n").count() == 0
    with pytest.raises(ValueError):
        search.add(docs, docs.limit(1))
    new = spark.createDataFrame([("n", "d2", "new", None), ("n", "d9", "nothing", None)], docs.schema)
    assert search.update(docs, new).where("doc_id = 'd2'").first().content == "new" and search.update(docs, new).count() == 5 and search.remove(docs, new).count() == 4


def test_documents_of_two_namespaces_with_one_id(spark):
    docs = spark.createDataFrame([("a", "1", "red bolt red"), ("b", "1", "red blue bolt"), ("b", "2", "green"), *[("b", f"{i}", f"leaf w{i}") for i in range(3, 9)]], "namespace string, doc_id string, content string")
    rows = {(r.namespace, r.doc_id): r.score for r in search.search(docs, "red", mode="bm25", namespace=search.EVERYWHERE).collect()}
    assert rows[("a", "1")] == 1.0 and 0 < rows[("b", "1")] < 1
    assert [(r.namespace, r.doc_id) for r in search.search(docs, "red", mode="bm25", namespace="b").collect()] == [("b", "1")]


def test_hybrid(spark):
    v = spark.createDataFrame([(1, 1, 0.8), (1, 2, -0.5)], "query_id int, id int, score double")
    t = spark.createDataFrame([(1, 2, 4.0), (1, 3, 2.0)], "query_id int, id int, score double")
    assert [(r.id, r.score) for r in search.hybrid(v, t, 3).orderBy("rank").collect()] == [(2, 0.5), (1, 0.4), (3, 0.25)]


def test_key_value(spark):
    kv = KeyValue.from_log(spark.createDataFrame([("n", "a", 1, "1"), ("n", "a", 2, "2"), (None, "a", 1, None), ("N", "b", 1, "x")], "namespace string, k string, t int, v string"), "k", "v", ["t"])
    assert kv.get("a", "n") == "2" and kv.get("a") is None and kv.exists("a") and not kv.exists("z") and kv.size("n") == 1 and kv.namespaces().count() == 3
    keys = spark.createDataFrame([("n", "a"), (None, "a"), ("n", "zz"), ("n", "a")], "namespace string, key string")
    assert rows(kv.get_many(keys)) == [("n", "a", "2")]
    put = kv.put_many(spark.createDataFrame([("n", "a", "9"), (None, "q", "7")], "namespace string, key string, value string"))
    assert put.get("a", "n") == "9" and put.get("q") == "7" and put.delete(keys).get("a", "n") is None and put.clear("n").size("n") == 0 and rows(kv.stats()) == [("N", 1), ("_default", 1), ("n", 1)]


# ---- graphs


def test_long_path(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(24)] + [(24, 3)], "source_id int, target_id int").coalesce(1)
    assert graph.shortest_path(chain, 0, 24) == list(range(25))
    assert graph.shortest_path(chain, 20, 24, most=4) == list(range(20, 25)) and graph.shortest_path(chain, 3, 0) is None
    with pytest.raises(RuntimeError):
        graph.shortest_path(chain, 20, 24, most=3)


def test_graph(spark):
    e = spark.createDataFrame([("n", a, b, "t") for a, b in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y")]], "namespace string, source_id string, target_id string, edge_type string")
    n = spark.createDataFrame([("n", x) for x in "abcdxy"], "namespace string, node_id string")
    reach = lambda d: {(r.node, r.depth) for r in graph.neighbours(e, spark.createDataFrame([("a",)], "start string"), d).collect()}
    assert reach(1) == {("b", 1)} and reach(9) == {("b", 1), ("c", 2), ("d", 3)}
    assert graph.neighbours(e, spark.createDataFrame([("nope",)], "start string"), 2).count() == 0
    assert graph.shortest_path(e, "a", "d") == ["a", "b", "c", "d"] and graph.shortest_path(e, "a", "y") is None and graph.shortest_path(e, "a", "a") == ["a"]
    nodes, inner = graph.subgraph(n, e, "a", 2)
    assert {r.node_id for r in nodes.collect()} == {"a", "b", "c"} and inner.count() == 2
    with pytest.raises(ValueError):
        graph.subgraph(n, e, "nope")
    assert graph.edges_of(e, "d", direction="both").count() == 2
    left, cut = graph.remove_nodes(n, e, spark.createDataFrame([("n", "c")], "namespace string, node_id string"))
    assert left.count() == 5 and cut.count() == 3
    with pytest.raises(ValueError):
        graph.put_edges(e, spark.createDataFrame([("n", "a", "zz", "t")], e.schema), n)
    assert graph.put_edges(e, e.limit(1), n).count() == 6
    t = spark.createDataFrame([("r", None, 1.0), ("a", "r", 2.0), ("b", "a", 3.0), ("lost", "gone", 1.0)], "n string, p string, v double")
    assert rows(graph.tree_levels(t, "n", "p")) == [("a", 1, "r"), ("b", 2, "r"), ("r", 0, "r")] and rows(graph.subtree_sums(t, "n", "p", "v")) == [("a", 5.0), ("b", 3.0), ("r", 6.0)]
    node = spark.createDataFrame([("t", "lab", '{"b": 2, "a": "x y", "embedding_text": "no"}')], "node_type string, label string, properties string")
    assert node.select(graph.node_text()).first()[0] == "t lab x y b: 2"
    steps = spark.createDataFrame([(1, "a"), (2, "ab"), (2, "b"), (3, "abc")], "s int, v string")
    with pytest.raises(ValueError):
        graph.ladder(steps, "s", "v", C("value").contains(C("last")))
    assert graph.ladder(steps.where("v <> 'b' and s < 3"), "s", "v", C("value").contains(C("last"))).count() == 2
    assert rows(graph.edges_from_paths(spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["z"],)], "p array<string>"), "p")) == [("a", "b"), ("b", "c")]


# ---- sources


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("name\tage\n x \t1\n\ny\t2\n")
    df = text.read_delimited(spark, str(tmp_path / "a.tsv"))
    assert rows(df) == [("x", "1"), ("y", "2")] and text.read_delimited(spark, str(tmp_path / "a.tsv"), parse=True, columns=["age"]).dtypes == [("age", "int")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/1.json").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    assert rows(text.read_json(spark, str(tmp_path / "j"), "a int", errors="drop")) == [(1,), (3,)] and sum(r._corrupt_record is not None for r in text.read_json(spark, str(tmp_path / "j"), "a int", errors="keep").collect()) == 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        text.read_json(spark, str(tmp_path / "j"), "a int").collect()
    text.write_json(df, str(tmp_path / "out"), by=["name"])
    assert text.read_json(spark, str(tmp_path / "out"), "name string, age string").count() == 2
    text.write_lines(df, str(tmp_path / "lines"), "name")
    assert rows(text.read_lines(spark, str(tmp_path / "lines"), drop_blank=True)) == [("x",), ("y",)] and text.read_whole(spark, str(tmp_path / "j")).count() == 1
    assert text.list_files(spark, str(tmp_path), "*.tsv").first().name == "a.tsv"
    big = spark.createDataFrame([(1, "s"), (2, "long text here")], "k int, t string")
    marked, parts = text.split_parts(big, "k", ["t"], 5)
    assert parts.count() == 1 and rows(text.join_parts(marked, parts, "k", ["t"])) == rows(big)
    paths = text.dated_paths(spark, "/d/{year}/{month}/{day}", "2024-02-28", "2024-03-01")
    assert [r.path for r in paths.orderBy("date").collect()] == ["/d/2024/02/28", "/d/2024/02/29", "/d/2024/03/01"]
    assert text.first_existing(paths, paths.where("date > '2024-02-28'"), forward=False).first().path == "/d/2024/03/01"
    b = spark.createDataFrame([(b"a \r\nb\n",), (b"a\nb",), (b"\xff",)], "c binary").select(text.canonical_hash("c").alias("h")).collect()
    assert b[0].h == b[1].h != b[2].h


def test_lists(spark):
    t = spark.createDataFrame([("l", i, v) for i, v in enumerate("bca")] + [("m", 0, "z")], "list_key string, idx bigint, value string")
    own = lambda d: [r.value for r in d.where("list_key = 'l'").orderBy("idx").collect()]
    assert lists.element(t, "l", -1).first().value == "a" and lists.element(t, "l", -9).count() == 0 and own(lists.insert(t, "l", 1, "n")) == ["b", "n", "c", "a"]
    rest, gone = lists.remove(t, "l", -3)
    assert own(rest) == ["c", "a"] and gone.first().value == "b" and own(lists.sort(t)) == ["a", "b", "c"] and own(lists.reverse(t)) == ["a", "c", "b"]
    assert own(lists.append(t, spark.createDataFrame([("l", 1, "p"), ("l", 2, "q"), ("new", 1, "r")], "list_key string, o int, value string"), "o")) == ["b", "c", "a", "p", "q"] and rows(lists.index_of(t, F.lit("c"))) == [("l", 1)]


# ---- plans


def test_graph_of_steps_resumes(spark):
    calls = []

    def step(name, f):
        def run(*parents):
            calls.append(name)
            return f(*parents)

        return run

    def broken(*_):
        calls.append("bad")
        raise RuntimeError("no")

    one = Step("one", step("one", lambda: spark.range(5).toDF("x")))
    two = Step("two", step("two", lambda d: d.where("x > 1")), ["one"])
    folder = new_path(spark, "plan")
    with pytest.raises(RuntimeError):
        Graph(spark, [one, two, Step("bad", broken, ["two"], retries=1)], folder).run()
    assert calls == ["one", "two", "bad", "bad"]
    calls.clear()
    three = Step("bad", step("three", lambda d: d.selectExpr("x + 1 as x")), ["two"], loop=lambda d, i: d.agg({"x": "max"}).first()[0] < 8)
    out = Graph(spark, [one, two, three], folder).run()
    assert calls[0] == "three" and "one" not in calls and out["bad"].agg({"x": "max"}).first()[0] == 8
    calls.clear()
    Graph(spark, [one, two, three], folder).run(fresh=("two",))
    assert calls[0] == "two"
    with pytest.raises(ValueError):
        Graph(spark, [Step("a", None, ["b"]), Step("b", None, ["a"])], folder)
    assert line(spark, folder, ("one", one.run), ("two", two.run)).run()["two"].count() == 3


def test_scatter_and_retry(spark):
    assert rows(scatter(spark.range(4), lambda p: p.assign(y=p.id * 2), "id bigint, y bigint", 2)) == [(0, 0), (1, 2), (2, 4), (3, 6)]
    tries = iter([ValueError(), 1, 5])

    def f():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert retried(f, 3, valid=lambda x: x > 2) == 5 and retried(lambda: 1 / 0, 2, default=7) == 7 and side_by_side([lambda: 1, lambda: 2]) == [1, 2]


# ---- queues and streams


def test_replay(spark):
    ops = [("q", 1, "put", "a", "1"), ("q", 2, "put", "b", "2"), ("q", 2, "put", "b", "2"), ("q", 3, "get", "g1", None), ("q", 4, "put", "c", "3"), ("p", 1, "get", "g2", None), ("p", 2, "put", "d", "4"), ("r", 1, "put", "e", "5"), ("r", 2, "clear", "f", None), ("r", 3, "put", "h", "6"), ("s", 1, "put", "i", "7"), ("s", 2, "delete", "j", None)]
    df = spark.createDataFrame(ops, "queue_id string, ts int, op string, operation_id string, payload string")
    assert sorted((r.queue_id, r.payload) for r in queues.replay(df).collect()) == [("p", "4"), ("q", "2"), ("q", "3"), ("r", "6")]
    r = random.Random(9)
    log, live = [], {}
    for i in range(200):
        q, op = r.choice("ab"), r.choice(["put", "put", "get", "get", "put", "clear"] if r.random() < 0.1 else ["put", "get"])
        log.append((q, i, op, f"o{i}", str(i)))
        items = live.setdefault(q, [])
        if op == "put":
            items.append(str(i))
        elif op == "get":
            del items[:1]
        else:
            items.clear()
    got = queues.replay(spark.createDataFrame(log, df.schema)).collect()
    assert sorted((x.queue_id, x.payload) for x in got) == sorted((q, p) for q, items in live.items() for p in items)
    assert [x.payload for x in queues.peek(df.where("queue_id = 'q'"), -1, order=["ts"]).collect()] == ["3"]


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "queue")
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "s string, ts timestamp, id int"
    queues.put(spark.createDataFrame([("a", t(0), 1), ("a", t(2), 2), ("b", t(1), 3), ("a", t(0), 1)], schema).coalesce(1), folder)
    stream = queues.read_queue(spark, folder, schema, 1)
    q = queues.deduplicated(stream, ["id"], "ts", "10 minutes").writeStream.format("memory").queryName("once").start()
    e = sessions.evictions(stream, "s", "ts", "5 minutes", "0 seconds").writeStream.format("memory").queryName("gone").outputMode("append").start()
    try:
        q.processAllAvailable()
        e.processAllAvailable()
        queues.put(spark.createDataFrame([("c", t(30), 9)], schema).coalesce(1), folder)
        q.processAllAvailable()
        e.processAllAvailable()
        queues.put(spark.createDataFrame([("c", t(31), 10)], schema).coalesce(1), folder)
        e.processAllAvailable()
        assert sorted(r.id for r in spark.sql("select id from once").collect()) [:4] == [1, 2, 3, 9]
        assert sorted((r.s, r.n) for r in spark.sql("select * from gone").collect()) == [("a", 3), ("b", 1)]
    finally:
        q.stop()
        e.stop()


def test_idle_and_limited(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([("a", t(0)), ("a", t(3)), ("b", t(5)), ("a", t(9))], "k string, ts timestamp")
    assert rows(sessions.idle_at(df, "k", "ts", F.lit("2024-01-01 00:10:00"), 300)) == [] and [r.k for r in sessions.idle_at(df, "k", "ts", F.lit("2024-01-01 00:10:01"), 300).collect()] == ["b"]
    assert [(r.k, r.suppressed) for r in sessions.rate_limited(df, "k", "ts", 300).orderBy("k", "ts").collect()] == [("a", 1), ("a", 0), ("b", 0)]
    out = sessions.session_windows(df, "ts", "4 minutes", ["k"], F.count("*").alias("n"))
    assert sorted((r.k, r.n) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1)]


# ---- places in groups, plans that stop


def test_positions_of_hot_and_null_groups(spark):
    rows = [("hot", i) for i in range(500)] + [(None, i) for i in range(40)] + [("one", 7)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(5)
    got = {(r.k, r.o): r.pos for r in windows.positions(df, ["k"], ["o"]).collect()}
    assert got == {("hot", i): i for i in range(500)} | {(None, i): i for i in range(40)} | {("one", 7): 0}
    assert windows.positions(df.limit(0), ["k"], ["o"]).count() == 0
    assert sorted(r.pos for r in windows.positions(df.where("k = 'one'"), [], ["o"]).collect()) == [0]


def test_a_stopped_branch(spark):
    from tessera.plans import steps
    from tessera.staging import new_path

    seen = []

    def count(df):
        seen.append("count")
        return df.groupBy().count()

    def stop(df):
        return steps.Stop(df.limit(1))

    made = steps.Graph(
        spark,
        [steps.Step("read", lambda: spark.range(10)), steps.Step("stop", stop, ["read"]), steps.Step("after", count, ["stop"]), steps.Step("beside", count, ["read"])],
        new_path(spark, "steps"),
    )
    done = made.run()
    assert set(done) == {"read", "stop", "beside"} and done["stop"].count() == 1 and seen == ["count"]

    def fail():
        seen.append("fail")
        raise TypeError("a mistake")

    with pytest.raises(TypeError):
        steps.Graph(spark, [steps.Step("fail", fail, retries=3, retry_on=(OSError,))], new_path(spark, "steps")).run()
    assert seen.count("fail") == 1


def test_theta_join_with_ties_and_nulls(spark):
    from tessera.operators import pairs

    a = spark.createDataFrame([(i % 7 if i % 11 else None, i) for i in range(60)], "x int, i int")
    b = spark.createDataFrame([(i % 5 if i % 13 else None, i) for i in range(50)], "y int, j int")
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    for op, f in test.items():
        want = sorted((r.i, s.j) for r in a.collect() for s in b.collect() if r.x is not None and s.y is not None and f(r.x, s.y))
        assert sorted((r.i, r.j) for r in pairs.theta_join(a, b, "x", op, "y", ranges=4).collect()) == want
    assert pairs.theta_join(a.limit(0), b, "x", "<", "y").count() == 0 == pairs.theta_join(a, b.limit(0), "x", "<", "y").count()


def test_acyclic_order_finds_cycles(spark):
    from tessera.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("a", "d"), (None, "d")], "source_id string, target_id string")
    assert {r.node: r["rank"] for r in graph.acyclic_order(edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert graph.acyclic_order(edges.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        graph.acyclic_order(edges.union(spark.createDataFrame([("d", "a")], edges.schema)))
