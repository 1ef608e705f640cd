"""Search, similarity and store queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.operators import pairs, search, vectors
from tessera.operators.diff import latest
from tessera.operators.keyvalue import KeyValue

_TERMS = ["replay", "queue", "latency", "namespaces", "hit"]
_WORDS = r"list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')), lambda w: w <> '')"


@query(
    f"WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL)"
    f" SELECT doc_id, len(list_intersect(list_distinct(w), {_TERMS!r})) / {float(len(_TERMS))} AS score FROM t"
    f" WHERE len(list_intersect(list_distinct(w), {_TERMS!r})) > 0 ORDER BY score DESC, doc_id LIMIT 100"
)
def search_term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 documents that share most of the terms of one query; search_term_overlap_all takes many."""
    return search.term_overlap(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _TERMS, 100).select("doc_id", "score")


def _every_twentieth(docs: DataFrame) -> DataFrame:
    """The texts of the rows whose id is divisible by 20, as queries."""
    return docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("q"))


@query()
def search_term_overlap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 documents that share most of the terms of every twentieth document."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return search.term_overlaps(docs, "doc_id", F.col("text"), _every_twentieth(docs), "query_id", F.col("q"), 100)


_QUERIES = {1: "replay time and queue depth", 2: "metadata filters of the session manager", 3: "coffee grinder near me", 4: "spell filter recall recall", 5: "the hot partition"}


@query(
    f"""
    WITH t AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
    p AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT id, unnest(w) AS term, len(w) AS len FROM t) GROUP BY id, term),
    d AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
    i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM d) ELSE raw END AS idf FROM d),
    q AS (SELECT query_id, unnest(string_split(text, ' ')) AS term FROM (VALUES {", ".join(f"({k}, '{v}')" for k, v in _QUERIES.items())}) v(query_id, text)),
    r AS (SELECT query_id, id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS raw FROM q JOIN p USING (term) JOIN i USING (term), s GROUP BY ALL),
    z AS (SELECT query_id, id, round(CASE WHEN max(raw) OVER w > 0 THEN raw / max(raw) OVER w ELSE 0 END, 9) AS score FROM r WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20"""
)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of five queries; search_bm25_all takes many."""
    asked = spark.createDataFrame(list(_QUERIES.items()), "query_id bigint, q string")
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return search.bm25(docs, "doc_id", F.col("text"), asked, "query_id", F.col("q"), 20).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def search_bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every twentieth document, whose whole text is the query."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    hits = search.bm25_many(docs, "doc_id", F.col("text"), _every_twentieth(docs), "query_id", F.col("q"), 20)
    return hits.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    """SELECT row_id FROM doc_store WHERE json_valid(metadata) AND json_type(metadata, '$.year') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string(metadata, '$.year') AS DOUBLE) = 2024
    AND json_type(metadata, '$.open_access') = 'BOOLEAN' AND json_extract_string(metadata, '$.open_access') = 'true'"""
)
def search_metadata_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose metadata hold two values, by type."""
    docs = table(spark, sf_dir, "doc_store")
    return search.filtered(docs, "metadata", {"year": 2024, "open_access": True}).select("row_id")


@query(
    """SELECT row_id FROM doc_store WHERE json_valid(metadata) AND json_type(metadata, '$.topics') = 'ARRAY'
    AND list_contains(CAST(json_extract(metadata, '$.topics') AS VARCHAR[]), 'bird_migration')"""
)
def search_metadata_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a topic in their list of topics."""
    return search.filtered(table(spark, sf_dir, "doc_store"), "metadata", {"topics": ["bird_migration"]}).select("row_id")


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_cosine_similarity(q.v, d.v), 12) AS score FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10"""
)
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, by cosine, to every twentieth one, among all."""
    data = table(spark, sf_dir, "embeddings")
    hits = vectors.nearest(data, data.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return hits.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT v AS w FROM e WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(v, w), 6) AS cos, round(list_inner_product(v, w), 6) AS dot, round(list_distance(v, w), 6) AS l2 FROM e, c"""
)
def vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every vector against the first."""
    data = table(spark, sf_dir, "embeddings")
    w = F.array(*map(F.lit, data.where("vec_id = 0").first()["embedding"]))
    v = F.col("embedding")
    return data.select("vec_id", *[F.round(vectors.MEASURES[m](v, w), 6).alias(m) for m in ("cos", "dot", "l2")])


@query(
    """SELECT namespace, item_key, value_json FROM (SELECT coalesce(namespace, '_default') AS namespace, item_key, value_json,
    row_number() OVER (PARTITION BY coalesce(namespace, '_default'), item_key ORDER BY updated_at DESC NULLS LAST, put_id DESC) AS r FROM kv_store) WHERE r = 1 AND value_json IS NOT NULL
    AND (namespace, item_key) IN (SELECT coalesce(namespace, '_default'), item_key FROM kv_store WHERE put_id % 20 = 0)"""
)
def kv_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the keys of every twentieth put."""
    log = table(spark, sf_dir, "kv_store")
    wanted = log.where("put_id % 20 = 0").select("namespace", F.col("item_key").alias("key"))
    return KeyValue.from_log(log, "item_key", "value_json", ["updated_at", "put_id"]).get_many(wanted).toDF("namespace", "item_key", "value_json")


@query(
    """SELECT namespace, count(*) AS n FROM (SELECT DISTINCT coalesce(namespace, '_default') AS namespace, item_key FROM kv_store) GROUP BY namespace"""
)
def kv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys by namespace."""
    return KeyValue.from_log(table(spark, sf_dir, "kv_store"), "item_key", "value_json", ["updated_at", "put_id"]).stats()


@query(
    """SELECT coalesce(namespace, '_default') AS namespace, doc_id, max(row_id) AS row_id FROM doc_store GROUP BY ALL"""
)
def store_current_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row delivered last of every document."""
    return search.current(table(spark, sf_dir, "doc_store"), ["row_id"]).select("namespace", "doc_id", "row_id")


@query(
    """WITH f AS (SELECT lower(trim(root_name)) AS root, regexp_extract(replace(abs_path, '\\', '/'), '[^/]*$') AS name, lower(trim(sha256, e' \\n\\t')) AS digest FROM file_candidates WHERE sha256 IS NOT NULL)
    SELECT name, count(DISTINCT root) AS n_roots, count(DISTINCT digest) AS n_versions, count(DISTINCT digest) = 1 AS agreed FROM f GROUP BY name HAVING count(DISTINCT root) > 1"""
)
def files_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that several roots have, and whether their digests agree."""
    from tessera.sources.text import agreed_and_conflicting

    files = table(spark, sf_dir, "file_candidates").where("sha256 is not null")
    name = F.regexp_extract(F.translate("abs_path", "\\", "/"), "[^/]*$", 0)
    rows = files.select(F.lower(F.trim("root_name")).alias("root"), name.alias("name"), F.lower(F.regexp_replace("sha256", r"^[ \n\t]+|[ \n\t]+$", "")).alias("digest"))
    return agreed_and_conflicting(rows, "root", "name", "digest")


@query(
    """WITH p AS (SELECT DISTINCT p_name AS a FROM part)
    SELECT x.a, y.a AS b, round(1 - levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a)), 6) AS similarity FROM p x JOIN p y
    ON levenshtein(x.a, y.a) <= floor(0.3 * greatest(length(x.a), length(y.a)) + 1e-9) WHERE x.a < y.a"""
)
def pairs_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different part names that are similar by at least 0.7."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    met = pairs.edit_distance_join(names, names.toDF("b"), "a", "b", 0.7, first_letter=False).where("a < b")
    return met.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "SELECT p_name, round(1 - levenshtein(p_name, 'small rings') / greatest(length(p_name), 11), 6) AS score FROM (SELECT DISTINCT p_name FROM part) ORDER BY score DESC, p_name DESC LIMIT 5"
)
def pairs_top_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return pairs.top_similar(names, "p_name", "small rings", 5).withColumn("score", F.round("score", 6))


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1"""
)
def pairs_best_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest line of each order, with ties."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return pairs.best_per_source(lines, "l_orderkey", "l_partkey", "l_extendedprice")


@query(
    "SELECT a.n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name"
)
def pairs_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations of a region."""
    return pairs.ordered_pairs(table(spark, sf_dir, "nation"), "n_name", ["n_regionkey"])


@query()
def pairs_greedy_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders aligned with suppliers one to one, by the dearest line first, within the lines of a part."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_extendedprice")
    return pairs.greedy_alignment(lines, "l_orderkey", "l_suppkey", "l_extendedprice", ["l_partkey"])


@query(
    """SELECT user_id, max(ts) AS ts, arg_max(value, event_id) AS value FROM events WHERE (user_id, ts) IN (SELECT user_id, max(ts) FROM events GROUP BY user_id) GROUP BY user_id"""
)
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "value")
