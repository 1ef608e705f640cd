"""Searches with every twentieth document as a query: brute force on a fixture."""

import math
import random
from collections import Counter

from tessera.operators import search
from tessera.queries import searching


def corpus(spark, path):
    r = random.Random(8)
    texts = {i: " ".join(r.choice("abcdefghijklmnop") * 2 for _ in range(r.randrange(1, 12))) for i in range(1, 130)}
    texts[60] = None
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return {i: t.split() for i, t in texts.items() if t is not None}


def best(scores, k):
    return {i: x for i, x in sorted(scores.items(), key=lambda e: (-round(e[1], 9), e[0]))[:k] if x > 0}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.id] = (r.rank, r.score)
    return out


def test_every_twentieth_document_is_a_query(spark, tmp_path, monkeypatch):
    docs = corpus(spark, tmp_path)
    asked = [i for i in docs if i % 20 == 0]
    overlap = found(searching.search_term_overlap_all(spark, str(tmp_path)))
    want = {q: best({i: len(set(docs[q]) & set(w)) / len(set(docs[q])) for i, w in docs.items()}, 100) for q in asked}
    assert {q: [i for i, _ in sorted(h.items(), key=lambda e: e[1][0])] for q, h in overlap.items()} == {q: list(h) for q, h in want.items()}
    df = Counter(t for w in docs.values() for t in set(w))
    mean_length = sum(map(len, docs.values())) / len(docs)
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    idf = {t: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for t, x in raw.items()}
    weigh = lambda q, w: sum(n * idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean_length)) for t, n in Counter(docs[q]).items())
    for most in (search.MOST_TERMS, 2):  # beyond it terms are shuffled
        monkeypatch.setattr(search, "MOST_TERMS", most)
        got = found(searching.search_bm25_all(spark, str(tmp_path)))
        assert set(got) == set(asked)
        for q in asked:
            scores = {i: weigh(q, w) for i, w in docs.items()}
            top = max(scores.values())
            expected = best({i: x / top for i, x in scores.items()}, 20)
            assert {i: x for i, (_, x) in got[q].items()} == {i: round(x, 6) for i, x in expected.items()}
