"""The corpus queries without SQL: what must hold of their rows on the smallest tables."""

import os

import pytest

from tessera.llm import queries, tokens

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def run(spark, name):
    return queries.queries()[name](spark, DATA).collect()


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def pieces(spark):
    rows = run(spark, "p3_pieces")
    assert rows and all(len(r.text) <= 1200 and 0 <= r.overlap <= 120 and (r.overlap > 0) == (r.piece > 0) for r in rows)


def placed(spark):
    rows, encode = run(spark, "p7_placed"), tokens.encoder().encode_ordinary
    held, size = {}, {}
    for r in rows:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
        if r.bin is not None:
            held.setdefault((r.bin, r.capacity), []).append(r.n_tokens)
    assert size == {d: len(encode(t or "")) for d, t in documents(spark).items()}
    assert all(sum(n) <= capacity for (_, capacity), n in held.items())


def oversized(spark):
    encode = tokens.encoder().encode_ordinary
    assert {r.doc_id for r in run(spark, "p7_found")} == {d for d, t in documents(spark).items() if len(encode(t or "")) > 4096}


def filling(spark):
    rows = run(spark, "p7_filling")
    whole = next(r for r in rows if r.capacity is None)
    assert whole.n_bins == sum(r.n_bins for r in rows if r.capacity) >= 1 and whole.n_bins * 4096 >= whole.n_tokens and whole.unused_share < 0.05


def report(spark):
    rows = run(spark, "p8_report")
    assert abs(sum(r.actual_share for r in rows) - 1) < 1e-9 and all(r.rate <= r.max_repeats for r in rows)


def reachable(spark):
    assert all(r.wanted_total <= r.reachable_total + 1e-6 for r in run(spark, "p8_reachable"))


def mixed(spark):
    rows = run(spark, "p8_mixture")
    most = {r.source: r.max_repeats for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").collect()}
    assert rows and all(1 <= r.copy <= most[r.source] for r in rows) and len({(r.doc_id, r.copy) for r in rows}) == len(rows)


def shares(spark):
    rows = run(spark, "p9_shares")
    assert len(rows) == len(documents(spark))
    assert all(abs(r.prose + r.link_list + r.tag_list + r.menu - (r.n_lines > 0)) < 1e-9 and r.spam == (r.n_lines > 0 and r.prose < 0.5) for r in rows)


def spam(spark):
    assert {r.doc_id for r in run(spark, "p9_found")} == {r.doc_id for r in run(spark, "p9_shares") if r.spam}


CHECKS = {
    "p3_pieces": pieces, "p7_placed": placed, "p7_found": oversized, "p7_filling": filling, "p8_report": report, "p8_reachable": reachable, "p8_mixture": mixed, "p9_shares": shares, "p9_found": spam,
}


def test_every_query_is_checked():
    assert set(queries.queries()) - set(queries.oracle_sql()) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_what_sql_cannot_say(spark, name):
    CHECKS[name](spark)
