"""Copies, compaction, shredding and hot keys: brute force and odd rows."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.paths import below, plain_path, plain_segments
from tessera.operators import compaction, diff, hotkeys, shred
from tessera.operators.components import connected_components
from tessera.queries import upkeep
from tessera.staging import new_path

# ---- copies


def test_compare_copies(spark):
    cols = "k1 string, k2 int, a bigint, b string, extra string"
    left = [("x", 1, 1, "p", "z"), ("x", 2, None, "p", "z"), (None, 3, 5, None, "z"), ("only", 1, 1, "p", "z"), ("dup", 1, 1, "p", "z"), ("dup", 1, 1, "p", "z"), ("é", 0, 0, "", None)]
    right = [("x", 1, 1, "q", "y"), ("x", 2, 7, "p", "y"), (None, 3, 5, None, "y"), ("new", 1, None, None, "y"), ("dup", 1, 1, "p", "y"), ("é", 0, 0, None, None)]
    out = diff.compare_copies(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols.replace("extra", "k0")), ["k1", "k2"], ["a", "b"], "l", "r")
    rows = {(r.k1, r.k2, r["diff"]): (r.left_value, r.right_value) for r in out.collect()}
    assert rows == {
        ("x", 1, "b"): ("p", "q"), ("x", 2, "a"): (None, "7"), ("only", 1, "missing_in_r"): (None, None), ("new", 1, "missing_in_l"): (None, None), ("dup", 1, "count"): ("2", "1"), ("é", 0, "b"): ("", None),
    }
    with pytest.raises(ValueError):
        diff.compare_copies(out, out, ["diff"], [])


def test_compare_empty_copies(spark):
    some, none = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([], "k int, v string")
    assert diff.compare_copies(none, none, ["k"], ["v"]).count() == 0
    assert [r["diff"] for r in diff.compare_copies(some, none, ["k"], ["v"]).collect()] == ["missing_in_right"]
    assert [r["diff"] for r in diff.compare_copies(none, some, ["k"], []).collect()] == ["missing_in_left"]


def test_compare_random_copies(spark):
    r = random.Random(4)
    side = lambda: {k: (r.choice([None, 1, 2]), r.choice([None, "a", "b"])) for k in r.sample(range(80), 60)}
    a, b = side(), side()
    df = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "k int, x int, y string")
    want = {(k, "missing_in_right") for k in a.keys() - b.keys()} | {(k, "missing_in_left") for k in b.keys() - a.keys()}
    want |= {(k, n) for k in a.keys() & b.keys() for i, n in enumerate("xy") if a[k][i] != b[k][i]}
    assert {(x.k, x["diff"]) for x in diff.compare_copies(df(a), df(b), ["k"], ["x", "y"]).collect()} == want


def test_paths(spark):
    assert below("D:\\Data\\.\\a\\\\b\\..\\c.txt", "d:/Data") == "a/c.txt"
    assert below("/r/x/../../q", "/r") is None and below("/r", "/r") is None and below(None, "/r") is None and below("/R/x", "/r") is None
    assert plain_segments("cafe\u0301/x") == ["caf\u00e9", "x"] and plain_segments("../a") == ["..", "a"] and plain_segments("") == []
    df = spark.createDataFrame([("./a\\b//c/.",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(plain_path(F.col("p"))).collect()] == ["a/b/c", "", None]


def test_latest(spark):
    rows = [(1, 5, "b"), (1, 5, "a"), (1, None, "z"), (2, None, None), (None, 1, "n")]
    out = diff.latest(spark.createDataFrame(rows, "k int, t int, v string"), ["k"], ["t"])
    assert {(r.k, r.t, r.v) for r in out.collect()} == {(1, 5, "b"), (2, None, None), (None, 1, "n")}


# ---- small files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=80))
def test_first_fit_decreasing(sizes):
    sizes = np.array(sizes, np.int64)
    got = compaction.first_fit_decreasing(sizes, 100)
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = int(sizes[i])
        b = next((b for b, r in enumerate(room) if r >= min(size, 100)), None)
        if b is None:
            b = len(room)
            room.append(100)
        room[b] = room[b] - size if size <= 100 else -1
        want[i] = b
    groups = lambda f: {frozenset(i for i in range(len(sizes)) if f(i) == b) for b in {f(i) for i in range(len(sizes))}}
    assert groups(lambda i: got[i]) == groups(want.get)


LINES = lambda *ids: "\n".join(json.dumps({"record_id": i, "n": k}) for k, i in enumerate(ids))


def session_files():
    rows = [("s1\na", "s1", "a", "log", LINES("s1.1", "s1.2") + '\n{"record_id": "s1.9", "cut'), ("s1\nb", "s1", "b", "log", LINES("s1.2", "s1.3")), ("s1\nc", "s1", "c", "artifact", "<x/>")]
    rows += [("s2\na", "s2", "a", "log", LINES("s1.1")), ("s2\nn", "s2", "n", "artifact", None), ("s2\ne", "s2", "e", "log", ""), ("s2\nbig", "s2", "big", "artifact", "y" * 5000), ("s2\nk", "s2", "k", None, "kind?")]
    return rows


def compacted(spark, rows, capacity=300):
    df = spark.createDataFrame(rows, "name string, session string, path string, kind string, body string")
    return compaction.compact(df, "name", "body", lambda d: compaction.log_records(d, "session", "path", "kind", "body", F.col("path")), new_path(spark, "t"), capacity)


def test_compaction_keeps_each_record_once(spark):
    done = compacted(spark, session_files())
    data = spark.read.parquet(f"{done.path}/data").collect()
    assert sorted((r.session_id, r.record_id) for r in data if r.record_id) == [("s1", "s1.1"), ("s1", "s1.2"), ("s1", "s1.3"), ("s2", "s1.1")]
    assert [r.body for r in data if r.kind == "log" and r.record_id is None] == ['{"record_id": "s1.9", "cut']
    assert sorted(r.file_path for r in data if r.kind != "log") == ["big", "c", "k", "n"] and done.n_rows == len(data)
    manifest = done.manifest.collect()
    assert sorted(r.name for r in manifest) == sorted(r[0] for r in session_files())
    sizes = {}
    for r in manifest:
        sizes[r.bin] = sizes.get(r.bin, 0) + r.n_bytes
    big = next(r.bin for r in manifest if r.name == "s2\nbig")
    assert all(n <= 300 for b, n in sizes.items() if b != big) and sum(r.bin == big for r in manifest) == 1


def test_compaction_odd(spark):
    done = compacted(spark, [])
    assert done.n_rows == 0 and done.manifest.count() == 0
    df = spark.createDataFrame(session_files(), "name string, session string, path string, kind string, body string")
    with pytest.raises(FileExistsError):
        compaction.compact(df, "name", "body", lambda d: d.select("bin", "body"), done.path)


def test_compaction_takes_every_named_file(spark, tmp_path):
    """Large logs and artifacts are written too, a record that a small and a large log share once, and p4_found lists small files."""
    large = LINES("s.1", *[f"s.{i}" for i in range(10, 300)])
    turns = [{"turn_number": 1, "log_file": "a.log", "artifacts": [{"path": "x/big"}, {"path": "x/tiny"}]}, {"turn_number": 2, "log_file": "./b.log", "artifacts": []}]
    spark.createDataFrame([(1, 1, json.dumps({"session_id": "s", "turns": turns}))], "manifest_id bigint, written_at bigint, manifest string").write.parquet(f"{tmp_path}/session_manifests.parquet")
    rows = [(1, "a.log", "log", LINES("s.1", "s.2")), (2, "b.log", "log", large), (3, "x/big", "artifact", "y" * 4096), (4, "x/tiny", "artifact", "z"), (5, "unnamed", "log", LINES("s.0"))]
    files = [(i, "s", path, 1, kind, body) for i, path, kind, body in rows]
    spark.createDataFrame(files, "file_id bigint, session_id string, file_path string, written_at bigint, kind string, body string").write.parquet(f"{tmp_path}/session_files.parquet")
    done = upkeep.compacted_session_files(spark, str(tmp_path))
    data = spark.read.parquet(f"{done.path}/data").collect()
    assert sorted(r.record_id for r in data if r.record_id) == sorted({"s.1", "s.2", *[f"s.{i}" for i in range(10, 300)]})
    assert {r.file_path: len(r.body) for r in data if r.kind == "artifact"} == {"x/big": 4096, "x/tiny": 1}
    assert {tuple(r) for r in upkeep.p4_found(spark, str(tmp_path)).collect()} == {("s", "a.log"), ("s", "x/tiny")}


# ---- nested records


def test_shred(spark):
    deep = {"id": "a", "turns": [{"n": 1, "arts": [{"p": "x"}, None, {"p": "y", "tags": [{"t": 1}]}]}, None, {"n": "2", "arts": '[{"p": "z"}]', "meta": {"k": {"j": True}}, "l": [1, 2]}]}
    spelled = {"id": "b", "turns": {"2": {"n": 2.0}, "1": {"n": 1, "arts": {"p": "only"}}}}
    rows = [(1, json.dumps(deep)), (2, json.dumps(spelled)), (3, json.dumps(deep)[:-5]), (4, None), (5, ""), (6, "[1]"), (7, '{"turns": "nonsense"}'), (8, "[" * 5000), (1, json.dumps(deep)), (9, '{"id": null, "turns": null}')]
    df = spark.createDataFrame(rows, "id bigint, j string").selectExpr("id", "j", "1 as node", "'x' as path", "2 as doc")
    nodes = shred.shred(df, "id", "j", ("turns", "arts"))
    arts = shred.table(nodes, "/turns/arts", {"p": ["p", "q"]}).distinct()
    assert {(r.doc, r.node, r.parent, r.p) for r in arts.collect()} == {(1, "1.1.1", "1.1", "x"), (1, "1.1.3", "1.1", "y"), (1, "1.3.1", "1.3", "z"), (2, "1.1.1", "1.1", "only")}
    turns = shred.table(nodes, "/turns", {"n": "n", "j": "meta.k.j", "l": "l"}).withColumn("n", shred.to_integer(F.col("n"))).distinct().collect()
    assert {(r.doc, r.node, r.n, r.j, r.l) for r in turns} == {(1, "1.1", 1, None, None), (1, "1.3", 2, "true", "[1, 2]"), (2, "1.1", 1, None, None), (2, "1.2", 2, None, None)}
    roots = shred.table(nodes, "", {"id": "id"})
    assert sorted((r.doc, r.id) for r in roots.collect() if r.id) == [(1, "a"), (1, "a"), (2, "b")] and roots.count() == 5
    assert nodes.where("path = '/turns/arts/tags'").count() == 2
    assert shred.shred(df.limit(0), "id", "j").count() == 0


# ---- hot keys


def test_dense_sums(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot"] * 9 + ["a", "b", None, "", "é" * 3]), r.choice([None, 1, 5])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int").withColumns({"key": F.lit(1), "block": F.lit(2), "sums": F.lit(3)}).repartition(7)
    want = {}
    for k, v in rows:
        n, s = want.get(k, (0, 0))
        want[k] = (n + 1, s + (v or 0))
    got = {x.key: (x.n, x.s) for x in hotkeys.dense_sums(df, F.col("k"), {"n": F.lit(1), "s": F.col("v")}).collect()}
    assert got == want
    assert hotkeys.dense_sums(df.limit(0), F.col("k"), {"n": F.lit(1)}).count() == 0


def test_group_summary_and_newest(spark):
    rows = [("g", "a", 1, "x"), ("g", "a", 3, "y"), ("g", "a", 3, "z"), ("g", None, 1, "x"), (None, "a", None, None), ("G", "a", 1, "x")]
    df = spark.createDataFrame(rows, "g string, k string, t int, v string")
    assert {(r.g, r.n_rows, r.n_keys) for r in hotkeys.group_summary(df, "g", "k").collect()} == {("g", 4, 1), (None, 1, 1), ("G", 1, 1)}
    assert {(r.g, r.k, r.v) for r in hotkeys.newest_rows(df, "g", "k", ["t"]).collect()} == {("g", "a", "z"), ("g", None, "x"), (None, "a", None), ("G", "a", "x")}
    assert hotkeys.group_summary(df.limit(0), "g", "k").count() == 0


# ---- components


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 1), (7, None)] + [(200, i) for i in range(201, 260)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


JSON_VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5) | st.sampled_from(["12", "null", "[1]", "a.b", '"x"', "\\"]),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=3) | st.sampled_from(["a", "a.b", "a/b", "\\", ".", "turns"]), inner, max_size=4),
    max_leaves=20,
)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(max_size=3) | st.sampled_from(["x", "a.b", "turns"]), JSON_VALUES, max_size=5))
def test_a_record_can_be_rebuilt_from_its_nodes(record):
    assert shred.restore(list(shred.walk(record, frozenset()))) == record


def test_nothing_of_mixed_lists_is_lost(spark):
    text = '{"x":[1,{"a":2},"s",null],"turns":["t1",{"n":1}],"m":{"a.b":1,"a":{"b":2}}, "e": [], "o": {}}'
    nodes = shred.shred(spark.createDataFrame([(7, text)], "id bigint, j string"), "id", "j", ("turns",))
    rows = sorted((r.node, r.path, r.ordinal, r.fields, r.texts) for r in nodes.collect())
    assert [r[1:4] for r in rows if r[1] == "/x"] == [("/x", 1, {shred.VALUE: "1"}), ("/x", 2, {"a": "2"}), ("/x", 3, {shred.VALUE: "s"}), ("/x", 4, {shred.VALUE: None})]
    assert next(r[3] for r in rows if r[1] == "") == {"m.a\\.b": "1", "m.a.b": "2", "e": "[]", "o": "{}"}
    assert shred.restore(rows) == json.loads(text)
    assert [r.n for r in shred.table(nodes, "/turns", {"n": "n"}).collect()] == ["1"]


def test_empty_bodies_are_packed_by_several_tasks(spark):
    files = spark.range(100_000).select(F.concat(F.lit("f"), "id").alias("name"), F.lit(0).cast("bigint").alias("n"))
    out = compaction.assign_bins(files, "name", "n", 100, names_per_task=10_000)
    n_bins, least, n = out.agg(F.count_distinct("bin"), F.min("bin"), F.count("*")).first()
    assert (n_bins, least, n) == (10, 0, 100_000) and out.groupBy("bin").count().agg(F.max("count")).first()[0] < 15_000


def test_compaction_reports_paths_and_conflicts(spark):
    rows = [("s\na", "s", "a", "log", '{"record_id": "1", "v": 1}\n{"record_id": "2"}'), ("s\nb", "s", "b", "log", '{"record_id": "1", "v": 2}\n{"record_id": "2"}')]
    done = compacted(spark, rows)
    told = {r.record_id: (r.file_path, r.paths, r.conflict) for r in spark.read.parquet(f"{done.path}/data").collect()}
    assert told == {"1": ("a", ["a", "b"], True), "2": ("a", ["a", "b"], False)}
    assert compaction.opened(spark, done.path).n_rows == 2
    with pytest.raises(FileNotFoundError):
        compaction.opened(spark, new_path(spark, "nowhere"))
