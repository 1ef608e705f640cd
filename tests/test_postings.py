"""Many queries against many texts: blocks against brute force, and what travels."""

import random
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import postings, search


def brute(docs, asked, k, weigh):
    """Of each query the k best (id, sum), ties by id; docs: (id, words)."""
    out = {}
    for q, terms in asked.items():
        sums = [(i, sum(w * weigh(Counter(words)[t], len(words)) for t, w in sorted(terms.items()) if t in words)) for i, words in docs]
        out[q] = sorted(((i, x) for i, x in sums if x > 1e-12), key=lambda e: (-round(e[1], 9), e[0]))[:k]
    return out


def by_blocks(docs, asked, k, bm25):
    batches = [pa.record_batch([pa.array([i for i, _ in part], pa.int64()), pa.array([w for _, w in part], pa.list_(pa.string()))], names=["id", "w"]) for part in (docs[:70], docs[70:])]
    batches = [batches[0], batches[1].slice(0, 50), batches[1].slice(50)]
    look = postings._Search(pa.array(list(asked)), pa.array([list(t) for t in asked.values()], pa.list_(pa.string())), pa.array([list(map(float, t.values())) for t in asked.values()], pa.list_(pa.float64())), k, bm25)
    n = words = 0
    for row in postings._pack(batches):
        x = {c: row.column(c)[0] for c in row.schema.names}
        n, words = n + x["n"].as_py(), words + x["words"].as_py()
        look.meet(x["terms"].values, *(np.frombuffer(x[c].as_buffer(), t) for c, t in (("ids", np.int64), ("sizes", np.int32), ("lengths", np.int32), ("codes", np.int32), ("counts", np.int32))))
    assert (n, words) == (len(docs), sum(len(w) for _, w in docs))
    out = {q: [] for q in asked}
    for r in [r for b in look.found() for r in b.to_pylist()]:
        assert r["n"] == len(asked[r["q"]])
        out[r["q"]].append((r["id"], r["raw"]))
    return out


@pytest.mark.parametrize("small", [{}, {"TEXTS": 7, "WORDS": 40, "COLUMNS": 3, "PAIRS": 50}, {"DENSE": 2.0, "PAIRS": 20}, {"DENSE": 0.0, "COLUMNS": 2}])
def test_blocks_find_what_brute_force_finds(monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(postings, name, value)
    r = random.Random(5)
    text = lambda: [r.choice("aabbcdefghijklmnopé") * 2 for _ in range(r.randrange(0, 14))]
    docs = [(i, text()) for i in r.sample(range(-100, 900), 200)] + [(i, ["aa", "bb", "zz"]) for i in r.sample(range(1000, 2000), 40)] + [(5000, ["zz"] * 300)]
    asked = {q: dict.fromkeys(text() + ["nowhere"], 1) for q in range(30)} | {40: {"aa": 1}, 41: {"zz": 1, "aa": 1}, 42: {"nowhere": 1}}
    for k in (1, 6, 1000):
        assert by_blocks(docs, asked, k, None) == brute(docs, asked, k, lambda tf, length: 1)
        for least in (0.0, -1.0):
            weighed = {q: {t: r.uniform(least, 3) for t in terms} for q, terms in asked.items()}
            got, want = by_blocks(docs, weighed, k, (1.5, 0.75, 7.0)), brute(docs, weighed, k, lambda tf, length: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 7)))
            for q in asked:  # sums that may become equal when they are rounded come too
                first = sorted(((i, x) for i, x in got[q] if x > 1e-12), key=lambda e: (-round(e[1], 9), e[0]))[:k]
                assert [i for i, _ in first] == [i for i, _ in want[q]] and [x for _, x in first] == pytest.approx([x for _, x in want[q]])
                assert len(got[q]) <= 2 * k + 2


def shuffled_rows(spark, run):
    """Rows written to shuffles while ``run`` runs."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    run()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext._jsc.sc().clearJobGroup()
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def common_words(spark):
    """300 texts, each of 30 out of 40 words."""
    r = random.Random(3)
    return spark.createDataFrame([(i, " ".join(r.sample([f"w{x}" for x in range(40)], 30))) for i in range(300)], "id bigint, text string").coalesce(2)


def test_bm25_of_many_queries_shuffles_no_postings(spark):
    docs = common_words(spark)
    found = {}
    asked = docs.where("id % 10 = 0").select(F.col("id").alias("q"), "text")
    # 30 queries of 30 words; each text shares words with each query
    assert shuffled_rows(spark, lambda: found.update(x=search.bm25_many(docs, "id", F.col("text"), asked, "q", F.col("text"), 4).collect())) < 3000
    assert sorted(map(tuple, found["x"])) == sorted(map(tuple, search.bm25(docs, "id", F.col("text"), asked, "q", F.col("text"), 4).collect()))


def test_overlaps_of_many_queries_shuffle_no_postings(spark):
    docs = common_words(spark)
    found = {}
    asked = docs.where("id % 10 = 0").select(F.col("id").alias("q"), "text")
    assert shuffled_rows(spark, lambda: found.update(x=search.term_overlaps(docs, "id", F.col("text"), asked, "q", F.col("text"), 4).collect())) < 200
    for q in (0, 290):
        one = search.term_overlap(docs, "id", F.col("text"), docs.where(F.col("id") == q).first().text.split(), 4).collect()
        assert [(r.id, r.score) for r in sorted(found["x"], key=lambda r: r["rank"]) if r.query_id == q] == [(r.id, r.score) for r in one]


def test_odd_texts_and_ids(spark):
    docs = spark.createDataFrame([(1, "red bolt"), (1, "red bolt red"), (None, "red ring"), (2, None), (3, ""), (4, "?!")] + [(i, f"leaf w{i}") for i in range(10, 20)], "id bigint, text string")
    asked = spark.createDataFrame([(7, "Red, ring"), (8, None), (9, "?"), (10, "unheard"), (None, "bolt")], "q bigint, t string")
    rows = search.bm25_many(docs, "id", F.col("text"), asked, "q", F.col("t"), 5).collect()
    assert {(r.query_id, r.id, r["rank"]) for r in rows} == {(7, None, 1), (7, 1, 2), (7, 1, 3), (None, 1, 1), (None, 1, 2)}
    over = search.term_overlaps(docs, "id", F.col("text"), asked, "q", F.col("t"), 2).collect()
    assert {(r.query_id, r.id, r.score, r["rank"]) for r in over} == {(7, None, 1.0, 1), (7, 1, 0.5, 2), (None, 1, 1.0, 1), (None, 1, 1.0, 2)}
    assert search.term_overlaps(docs.limit(0), "id", F.col("text"), asked, "q", F.col("t"), 5).count() == 0
    assert search.bm25_many(docs.limit(0), "id", F.col("text"), asked, "q", F.col("t"), 5).count() == 0
