"""The corpus queries, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chunks, mixture, neardup, packing, spam
from tessera.staging import stage

DEFAULT_NAMESPACE = "_default"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- near-duplicates

NEAR = neardup.Scheme(threshold=0.6, width=3, min_words=20)


def _near(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    docs = table(spark, sf_dir, "doc_store").select("row_id", F.coalesce("namespace", F.lit(DEFAULT_NAMESPACE)).alias("namespace"), "content")
    return neardup.near_duplicates(docs, "row_id", "content", "namespace", NEAR)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs().select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text that takes part: its class of equal texts and its group, each by its least row_id, and the number of linked
    classes."""
    rows = stage(_near(spark, sf_dir).grouped(), "groups")
    least = lambda c: rows.groupBy(c).agg(F.min("id").alias(f"least_{c}"))
    named = rows.join(least("class"), "class").join(least("component"), "component")
    return named.select(F.col("id").alias("row_id"), F.col("least_class").alias("class"), F.col("least_component").alias("component"), "links")


# ---- pieces

PIECE = chunks.Limits(size=1200, overlap=120)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the oversized contents."""
    return chunks.split_texts(table(spark, sf_dir, "doc_store"), "row_id", "content", PIECE, only_oversized=True).withColumnRenamed("id", "row_id")


def p3_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized contents put together from their pieces, and whether all pieces keep to the limits."""
    pieces = p3_pieces(spark, sf_dir)
    own = F.struct("piece", F.expr("substring(text, overlap + 1)").alias("own"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["own"]), "").alias("content")
    within = (F.max(F.char_length("text")) <= PIECE.size) & (F.max("overlap") <= PIECE.overlap) & (F.count("*") == F.max("piece") + 1)
    return pieces.groupBy("row_id").agg(whole, within.alias("within"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece = 1").select("row_id")


# ---- containers

CAPACITIES = (512, 1024, 2048, 4096)


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every text goes."""
    return packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITIES).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_placed(spark, sf_dir).where("piece = 1").select("doc_id")


def p7_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins, tokens and unused places by capacity; the last row, with a null capacity, is for all, and says how many of the largest bins
    would be needed at least."""
    bins = p7_placed(spark, sf_dir).where("bin is not null").groupBy("bin", "capacity").agg(F.sum("n_tokens").alias("n"))
    out = bins.rollup("capacity").agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_tokens"), F.sum(F.col("capacity") - F.col("n")).alias("n_unused"))
    least = F.when(F.col("capacity").isNull(), F.ceil(F.col("n_tokens") / CAPACITIES[-1]))
    return out.select("capacity", "n_bins", "n_tokens", "n_unused", (F.col("n_unused") / (F.col("n_tokens") + F.col("n_unused"))).alias("unused_share"), least.alias("least_bins"))


# ---- mixture


def _mixture(spark: SparkSession, sf_dir: str, within_reach: bool = False) -> mixture.Mixture:
    return mixture.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"), within_reach=within_reach)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and the shares reached."""
    return _mixture(spark, sf_dir).report


def p8_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and the shares reached by the largest mixture in which no source is short."""
    return _mixture(spark, sf_dir, within_reach=True).report


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document."""
    return _mixture(spark, sf_dir).rows().withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_report(spark, sf_dir).where("short").select("source")


# ---- pages of keywords, links and tags


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of characters of every text by label."""
    return spam.page_shares(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_shares(spark, sf_dir).where("spam").select("doc_id")


def queries() -> dict:
    found = (p1_found, p1_groups, p3_found, p3_pieces, p3_rebuilt, p7_found, p7_placed, p7_filling, p8_found, p8_report, p8_reachable, p8_mixture, p9_found, p9_shares)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            WITH RECURSIVE w AS (SELECT row_id, coalesce(namespace, '_default') AS ns, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM doc_store WHERE content IS NOT NULL),
            s AS (SELECT row_id, ns, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
            x AS (SELECT row_id, ns, len(g) AS n, unnest(g) AS g FROM s),
            l AS (SELECT a.row_id AS a, b.row_id AS b FROM x a JOIN x b ON a.ns = b.ns AND a.g = b.g AND a.row_id < b.row_id GROUP BY a.row_id, b.row_id
                HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6),
            u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
            r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
            SELECT a AS row_id_a, b AS row_id_b FROM r WHERE a < b""",
        "p1_groups": r"""
            WITH RECURSIVE w AS (SELECT row_id, coalesce(namespace, '_default') AS ns, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM doc_store WHERE content IS NOT NULL),
            s AS (SELECT row_id, ns, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 20),
            k AS (SELECT row_id, ns, g, min(row_id) OVER (PARTITION BY ns, g) AS class FROM s),
            x AS (SELECT class, ns, len(g) AS n, unnest(g) AS g FROM k WHERE row_id = class),
            l AS (SELECT a.class AS a, b.class AS b FROM x a JOIN x b ON a.ns = b.ns AND a.g = b.g AND a.class < b.class GROUP BY a.class, b.class
                HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6),
            u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
            r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
            c AS (SELECT a AS class, least(a, min(b)) AS component FROM r GROUP BY a), d AS (SELECT a AS class, count(*) AS links FROM u GROUP BY a)
            SELECT row_id, k.class AS class, coalesce(component, k.class) AS component, coalesce(links, 0) AS links FROM k LEFT JOIN c USING (class) LEFT JOIN d USING (class)""",
        "p3_rebuilt": f"SELECT row_id, content, true AS within FROM doc_store WHERE length(content) > {PIECE.size}",
        "p3_found": f"SELECT row_id FROM doc_store WHERE length(content) > {PIECE.size}",
        # characters give the same answer as tokens
        "p8_found": """
            WITH s AS (SELECT replace(lower(trim(source)), '-', '_') AS source, sum(length(text)) AS n FROM documents GROUP BY 1)
            SELECT t.source FROM mix_targets t LEFT JOIN s ON s.source = replace(lower(trim(t.source)), '-', '_')
            WHERE coalesce(s.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM s)""",
    }
