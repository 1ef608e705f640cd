import pytest
from pyspark.sql import functions as F

from tessera.functions import parsing

C = F.col


def one(spark, column, schema, *cells):
    out = spark.createDataFrame([cells], schema).select(column).first()[0]
    return out.asDict() if hasattr(out, "asDict") else out


def test_quoted_splits(spark):
    assert one(spark, parsing.split_quoted(C("s")), "s string", "a,'b,c',(d,e),f\\,g") == ["a", "'b,c'", "(d,e)", "f,g"]
    assert one(spark, parsing.split_quoted(C("s"), keep_quotes=False), "s string", "'a,b',c") == ["a,b", "c"] and one(spark, parsing.split_quoted(C("s")), "s string", None) is None
    assert one(spark, parsing.split_calls(C("s")), "s string", "f(1; 2); g('a;b');") == ["f(1; 2)", "g('a;b')"]


def test_calls(spark):
    call = one(spark, parsing.parse_call(C("s")), "s string", "a.f(1, x, k='v')")
    assert call == {"name": "a.f", "args": ["1", "x"], "kwargs": {"k": "v"}} and one(spark, parsing.parse_call(C("s")), "s string", "no call(") is None
    assert one(spark, parsing.same_calls(C("a"), C("b")), "a string, b string", "f(1,2); g()", "f( 1, 2 );g( )") and not one(spark, parsing.same_calls(C("a"), C("b")), "a string, b string", "f(1)", "f(2)")


def test_xml(spark):
    assert one(spark, parsing.from_xml(C("s"), "a int"), "s string", "<r><a>1</a></r>") == {"a": 1}
    assert "<a>1</a>" in one(spark, parsing.to_xml(F.struct(C("a"))), "a int", 1)


def test_entities(spark):
    df = spark.createDataFrame([("big red dog runs",), (None,)], "t string")
    tags = {"big": "ADJ", "red": "ADJ", "dog": "NOUN"}
    out = parsing.entities(df, "t", lambda x: [(w, tags.get(w, "X")) for w in x.split()], "A*N+", {"ADJ": "A", "NOUN": "N"}).collect()
    assert [r.entities for r in out] == [["big red dog"], None]
    assert parsing.batched(df.where("t is not null"), lambda ts: [t.split() for t in ts], "t", "w").first().w == ["big", "red", "dog", "runs"]


def test_weights(spark):
    s = lambda **k: round(one(spark, parsing.weighted_similarity(C("a"), C("b"), **k), "a string, b string", "red bolt", "red bolts"), 4)
    assert s() == 0.8889 and s(same_start=0.5) == 0.9444 and s(same_first_token=0.5, contained=0.5) == 0.9722 and s(short=3.0) == 0.8889


def test_small_searches(spark):
    assert one(spark, parsing.word_in_grid(C("g"), C("w")), "g array<string>, w string", ["abc", "xyd"], "abcd") and not one(spark, parsing.word_in_grid(C("g"), C("w")), "g array<string>, w string", ["ab"], "aba")
    m = [[0.0, 1.0, 9.0], [1.0, 0.0, 2.0], [9.0, 2.0, 0.0]]
    assert one(spark, parsing.shortest_tour(C("m")), "m array<array<double>>", m) == 12 and one(spark, parsing.cheapest_merges(C("s")), "s array<double>", [1.0, 2.0, 3.0]) == 9
    assert parsing.permutations(spark.createDataFrame([([1, 2, 3],)], "a array<int>"), "a").count() == 6
    jobs = spark.createDataFrame([("g", i, t, 5) for i, t in enumerate([1, 2, 3, 4, 5])], "g string, i int, t int, w int")
    assert sorted((r.server, r.n) for r in parsing.busiest(jobs, ["g"], ["i"], "t", "w", 3).collect()) == [(0, 1), (1, 1), (2, 1)]
    text = parsing.encode_tree({"a": ("b", "c"), "b": (None, "d")}, "a")
    assert one(spark, parsing.tree_depth(C("s")), "s string", text) == 3


def test_permutations_of_any_size(spark):
    df = spark.createDataFrame([(1, list(range(9))), (2, [5, 5]), (3, []), (4, None), (5, [7, None])], "id int, a array<int>")
    out = parsing.permutations(df, "a")
    assert {r.id: r.n for r in out.groupBy("id").agg(F.countDistinct("permutation").alias("n")).collect()} == {1: 362880, 2: 1, 3: 1, 5: 2}
    assert sorted(map(str, (r.permutation for r in out.where("id in (2, 5)").collect()))) == ["[5, 5]", "[5, 5]", "[7, None]", "[None, 7]"]
    with pytest.raises(Exception, match="more than 8"):
        parsing.permutations(df, "a", most=8).count()
