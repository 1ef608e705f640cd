"""Every query with SQL against DuckDB on the smallest tables; every query runs and keeps its schema."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cur = db.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted(str(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())
    assert sorted(str(tuple(plain(v) for v in r)) for r in df.collect()) == want


CORE = __spark_entry__.catalog.QUERIES


def aligned(spark, rows):
    """No order and no supplier twice in a part, and no pair that could still be added."""
    for key in ("l_orderkey", "l_suppkey"):
        pairs = [(r.l_partkey, r[key]) for r in rows]
        assert len(pairs) == len(set(pairs)) > 0
    taken = {(r.l_partkey, r[k], k) for r in rows for k in ("l_orderkey", "l_suppkey")}
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").collect()
    assert all((r.l_partkey, r.l_orderkey, "l_orderkey") in taken or (r.l_partkey, r.l_suppkey, "l_suppkey") in taken for r in lines)


def filled(spark, rows):
    """Rows of all files add up to the totals, and no two files are half empty."""
    totals = QUERIES["p4_totals"](spark, DATA).first()
    assert sum(r.n_rows for r in rows) == totals.n_rows and len({r.bin for r in rows}) == len(rows)


def connected(spark, rows):
    """Both ends of an edge are in one component, named by its least node."""
    of = {r.node: r.component for r in rows}
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").collect()
    assert all(of[f"p{r.l_partkey}"] == of[f"s{r.l_suppkey}"] for r in lines) and all(of[c] == c for c in of.values())


def ranked(least, most):
    def check(spark, rows):
        """Ranks without gaps, scores that fall, and every query finds itself best."""
        by = {}
        for r in rows:
            by.setdefault(r.query_id, []).append(r)
        for query, hits in by.items():
            hits.sort(key=lambda r: r["rank"])
            assert [r["rank"] for r in hits] == list(range(1, len(hits) + 1)) and len(hits) <= most
            assert all(a.score >= b.score for a, b in zip(hits, hits[1:], strict=False)) and hits[0].score >= least
            assert any(r.id == query and r.score >= least for r in hits) or hits[-1].score >= least
    return check


CHECKS = {"pairs_greedy_alignment": aligned, "p4_files": filled, "graph_components_all": connected, "search_bm25_all": ranked(1.0, 20), "search_term_overlap_all": ranked(1.0, 100)}


def test_every_query_is_checked():
    assert set(CORE) - set(SQL) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_what_sql_cannot_say(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    CHECKS[name](spark, df.collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
