import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import neardup
from tessera.llm.neardup import Scheme, near_duplicates, signatures
from tessera.llm.shingles import shingle_sets

WORD = re.compile(r"[^\W_]+")


def brute(rows, threshold, width, least):
    """Pairs of ids of one component, by comparing all sets."""
    sets = []
    for i, group, text in rows:
        words = WORD.findall((text or "").lower())
        if i is not None and text is not None and len(words) >= least:
            sets.append((i, group, {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        if x[1] == y[1] and len(x[2] & y[2]) / len(x[2] | y[2]) >= threshold:
            parent[root(a)] = root(b)
    return sorted((min(sets[a][0], sets[b][0]), max(sets[a][0], sets[b][0])) for a, b in combinations(range(len(sets)), 2) if root(a) == root(b) and sets[a][0] != sets[b][0])


def corpus(n=120, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(n):
        if texts and r.random() < 0.6:
            words = r.choice(texts).split()
            for _ in range(r.randint(0, max(1, len(words) // 8))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([21, 25, 40, 70, 130, 400]))]
        texts.append(" ".join(words))
        rows.append((i, r.choice(["a", "b", None]), texts[-1]))
    return rows


SCHEMA = "id bigint, ns string, txt string"


def pairs(df, **scheme):
    found = near_duplicates(df, "id", "txt", "ns", Scheme(threshold=0.6, width=3, min_words=20, **scheme)).pairs().collect()
    return sorted((r.id_a, r.id_b) for r in found)


@pytest.mark.parametrize("cost_limit", [64, 1, 0])
def test_equals_comparing_all_sets(spark, cost_limit):
    rows = corpus()
    assert brute(rows, 0.6, 3, 20)
    assert pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), cost_limit=cost_limit) == brute(rows, 0.6, 3, 20)


def test_rest_in_several_blocks(spark):
    rows = corpus(40, 3)
    assert pairs(spark.createDataFrame(rows, SCHEMA), cost_limit=0, most_cost=0, block_shingles=200) == brute(rows, 0.6, 3, 20)


def test_odd_rows(spark):
    long = " ".join(f"t{i % 977}x{i}" for i in range(30_000))
    base = " ".join(f"word{i}" for i in range(30))
    rows = [
        (1, "a", base), (2, "a", base), (3, "b", base), (4, None, base), (5, "a", base.upper() + "!"), (6, "a", None), (7, "a", ""), (8, "a", "  \n"), (None, "a", base), (9, "a", "too few words"),
        (10, "a", long), (11, "a", long + " tail"), (12, "a", "same " * 50), (13, "a", "Same, " * 60), (1, "a", base),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("id", "ns", "txt", "1 as class", "2 as salt", "3 as text", "4 as component", "5 as part")
    assert sorted(set(pairs(df))) == [(1, 2), (1, 5), (2, 5), (10, 11), (12, 13)]
    grouped = near_duplicates(df, "id", "txt", "ns", Scheme(threshold=0.6, width=3, min_words=20)).grouped().collect()
    assert len(grouped) == 10
    by = {r.id: r for r in grouped}
    assert by[10].component == by[11].component and by[10].links == 1 and by[3].component not in (by[1].component, by[4].component)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = near_duplicates(empty, "id", "txt", "ns")
    assert found.pairs().count() == found.grouped().count() == found.links.count() == 0


def test_hot_text(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "a", text if i % 3 else f"{text} {i} {i + 1} {i + 2}") for i in range(90)]
    assert len(pairs(spark.createDataFrame(rows, SCHEMA))) == 90 * 89 // 2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 120), st.integers(0, 120), st.integers(0, 2**32 - 1))
def test_pigeonhole(n, added, dropped, seed):
    """Sets within the difference agree with at least what the capacity leaves."""
    scheme = Scheme(threshold=0.6)
    r = np.random.default_rng(seed)
    universe = np.unique(r.integers(0, 1 << 52, n + added, dtype=np.uint64))
    a, b = np.sort(universe[: len(universe) - added]), np.sort(np.delete(universe, r.permutation(len(universe))[: min(dropped, len(universe) - 1)]))
    if not len(a) or not len(b):
        return
    big, small = (a, b) if len(a) >= len(b) else (b, a)
    difference = len(np.setxor1d(a, b))
    if difference > scheme.difference(np.array([len(a)]), np.array([len(b)]))[0]:
        return
    size, salt = np.array([len(big), len(small)]), np.zeros(2, np.uint64)
    band = scheme.band(size)
    assert band[0] - band[1] in (0, 1)
    laid = np.array([band[1], band[1]])  # the larger set in the band of the smaller
    owner = np.repeat([0, 1], size)
    who, sig, kind, capacity = signatures(owner, np.concatenate([big, small]), salt, laid, scheme)
    entries = [{k: set(sig[(who == o) & (kind == k)].tolist()) for k in (0, 1, 2)} for o in (0, 1)]
    whole = entries[1][0] | entries[1][1]
    weight = len(entries[0][0] & whole) + 2 * len(entries[0][1] & (whole | entries[1][2])) + 2 * len(entries[0][2] & whole)
    assert weight >= capacity[0] - scheme.difference(size[:1], size[1:])[0]


def test_shingles():
    owner, token = shingle_sets(["A b-c_d 9é", "", "a B C d 9É", "one two"], 3, 3)
    assert np.bincount(owner, minlength=4).tolist() == [3, 0, 3, 0]
    assert token[owner == 0].tolist() == token[owner == 2].tolist()


def test_packed_arrays():
    from tessera.llm.packing64 import pack, unpack

    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64))
    for a, b in zip(unpack(pack(x, x.astype(np.int32), np.zeros(0, np.int64), ascending=1)), (x, x.astype(np.int32), np.zeros(0, np.int64)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    assert neardup.SIG_BITS == 43


def test_agreement_beyond_16_bits():
    """Two sets that agree in 70,000 signatures of one bucket."""
    m = 70_000
    sig, doc = np.repeat(np.arange(m, dtype=np.uint64), 2), np.tile(np.array([0, 1], np.int64), m)
    out = neardup._match(sig, doc, np.zeros(2 * m, np.int8), np.array([11, 22], np.uint64), np.array([m, m]), np.array([64, 64]), Scheme(), 0)
    (block,) = [x for _, kind, x in out if kind == 1 and len(neardup.unpack(x)[0])]
    assert neardup.unpack(block)[3].tolist() == [m]


def test_bounded_buckets(spark):
    """A second exchange cuts coarse buckets; the result is the same."""
    rows = corpus(80, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert pairs(df, coarse_bits=1, bucket_bytes=200) == brute(rows, 0.6, 3, 20) == pairs(df, coarse_bits=0, bucket_bytes=4000)


def test_merged_segments_leave_less_to_compare(spark):
    """Boilerplate that is shared by all texts makes its signatures dear: larger segments are rarer."""
    r = random.Random(4)
    common = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        at = r.randrange(60)
        rows.append((i, "a", " ".join(common[at : at + 40] + [f"own{i}x{k}" for k in range(30)])))
    rows += [(1000 + i, ns, text + " changed") for i, ns, text in rows[:20]]
    df = spark.createDataFrame(rows, SCHEMA)
    scheme = Scheme(threshold=0.6, width=3, min_words=20, cost_limit=8)
    found = near_duplicates(df, "id", "txt", "ns", scheme)
    assert found.merged > 0 and found.compared < found.merged
    assert sorted((x.id_a, x.id_b) for x in found.pairs().collect()) == brute(rows, 0.6, 3, 20)
    with pytest.raises(RuntimeError, match="passes"):
        near_duplicates(df, "id", "txt", "ns", Scheme(threshold=0.6, width=3, min_words=20, cost_limit=0, most_cost=0, block_shingles=10, most_passes=3))


def test_ids_beyond_the_filter_are_joined(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FILTER_BITS", 0)
    rows = corpus(60, 8)
    assert pairs(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 0.6, 3, 20)


def test_sets_of_one_class_id_are_told_apart():
    """Two members with the first sum of their sets in common and not the second: both are compared with all rows."""
    import pyarrow as pa

    from tessera.llm.packing64 import pack

    u = np.uint64
    block = pack(np.array([1, 2, 3]), np.array([7, 7, 9], u), np.array([70, 71, 90], u), np.array([20, 20, 20]), np.array([20, 20, 20]), np.array([20, 20, 20]))
    out = neardup._decide(Scheme(threshold=0.6), True)(pa.table({"part": [0], "kind": [0], "block": [block]})).to_pylist()
    own = int(neardup.sub_class(np.array([7], u), np.array([71], u)).view(np.int64)[0])
    assert [(x["a"], x["b"]) for x in out if x["kind"] == 0] == [(1, 7), (2, own), (3, 9)]
    assert sorted(x["a"] for x in out if x["kind"] == 2) == sorted([7, own])
    assert [(x["a"], x["b"], x["c"]) for x in out if x["kind"] == 3] == [(7, 71, own)]


def test_rows_of_a_taken_class_id_are_compared(spark):
    """``_rest`` finds the links of a class whose id was taken, under its own id."""
    base = [f"w{i}" for i in range(40)]
    rows = [(1, 0, " ".join(base)), (2, 0, " ".join(base + ["x"])), (3, 0, " ".join(f"y{i}" for i in range(40)))]
    df = spark.createDataFrame(rows, "id bigint, salt bigint, text string")
    scheme = Scheme(threshold=0.6, width=3, min_words=20)
    owner, token = shingle_sets([t for _, _, t in rows], 3, 20)
    n = np.bincount(owner)
    cls, check = neardup.class_ids(owner, token, neardup.mix(np.zeros(3, np.uint64)), n)
    c, k = cls.view(np.int64).tolist(), check.view(np.int64).tolist()
    taken = spark.createDataFrame([(c[0], k[0], 5)], "a bigint, b bigint, c bigint")
    bad = spark.createDataFrame([(5, int(n[0]))], "class bigint, size bigint")
    deputy = spark.createDataFrame([(5, 1), (c[1], 2), (c[2], 3)], "class bigint, id bigint")
    assert [tuple(r) for r in neardup._rest(df, bad, taken, deputy, scheme).collect()] == [(c[1], 5)]
