"""Ranked document search: term overlap, BM25, vectors and both, with metadata filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.nested import json_matches
from tessera.functions.text import plain_tokens, tokens
from tessera.operators import postings
from tessera.staging import stage


def term_overlap(docs: DataFrame, id_col: str, text: Column, query: list[str], k: int, stem: bool = False, punctuation: bool = False) -> DataFrame:
    """The ``k`` rows of ``docs`` sharing most of the query's different terms, with ``score`` (share of the terms); ties by id.

    One scan: terms are intersected inside the row, and only ``k`` rows per task are ordered.  No terms, no rows.
    """
    terms = sorted(set(query))
    if not terms:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    words = plain_tokens(text) if punctuation else tokens(text, stem)
    score = F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) / F.lit(float(len(terms)))
    # rows without any term come last: dropped after the limit, they do not make the score be computed twice
    return docs.withColumn("score", F.coalesce(score, F.lit(0.0))).orderBy(F.desc("score"), id_col).limit(k).where("score > 0")


def term_overlaps(docs: DataFrame, id_col: str, text: Column, queries: DataFrame, query_id: str, query_text: Column, k: int, stem: bool = False) -> DataFrame:
    """``(query_id, id, score, rank)``: of many queries the ``k`` rows that share most of their different terms, as in :func:`term_overlap`.

    No posting is shuffled (:mod:`tessera.operators.postings`).  Ids are whole numbers, and rows of one id are rows of their own.
    """
    blocks = postings.packed(docs, id_col, text, stem)
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), tokens(query_text, stem).alias("w")).where("size(w) > 0")
    asked = asked.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("terms"))
    top = postings.best(blocks, asked.withColumn("weights", F.transform("terms", lambda _: F.lit(1.0))), k)
    return top.select(F.col("q").alias("query_id"), "id", (F.col("raw") / F.col("n")).alias("score"), "rank")


#: The namespace of documents without one, and what asks for all namespaces.
DEFAULT, EVERYWHERE = "_default", "*"
#: Query terms that are broadcast at most; beyond, words are shuffled by term.
MOST_TERMS = 100_000


def vocabulary(docs: DataFrame, text: Column, stem: bool = False) -> tuple[DataFrame, int, float]:
    """``(term, df)``, the number of rows and their mean length, in one pass that combines before its shuffle.

    Each row also counts under the empty term, which no text has; there its length is summed.
    """
    words = docs.where(text.isNotNull()).select(tokens(text, stem).alias("w"))
    # the outer form, as for the inner one the optimizer adds a filter that computes the words once more
    each = words.select(F.explode_outer(F.array_append(F.array_distinct("w"), F.lit(""))).alias("term"), F.size("w").alias("length"))
    counted = stage(each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("length"))).alias("length")), "terms")
    whole = counted.where("term = ''").first()
    n = whole["df"] if whole else 0
    return counted.where("term <> ''").select("term", "df"), n, (whole["length"] / n if n else 0.0) or 1.0


def bm25(docs: DataFrame, id_col: str, text: Column, queries: DataFrame, query_id: str, query_text: Column, k: int, stem: bool = False, k1: float = 1.5, b: float = 0.75, epsilon: float | None = 0.25, only: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` best rows of each query by BM25, scores over the query's best; ties by id.

    A term in more than half of the rows, whose weight would be negative, weighs ``epsilon`` times the mean weight of all
    terms (without ``epsilon``: 1e-6).  ``only`` ``(id)`` bounds what may be found, not the corpus.  A query's term counts as often as the query repeats it.  The corpus is what ``docs`` holds: filter it before.

    Words meet the queries' terms before they are counted; up to ``MOST_TERMS`` of these are broadcast, so that only their
    postings are shuffled.
    """
    terms, n, average = vocabulary(docs, text, stem)
    asked = queries.select(F.col(query_id).alias("q"), F.explode(tokens(query_text, stem)).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    terms = terms.withColumn("idf", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = terms.agg(F.avg("idf")).first()[0] or 0.0
    idf = F.greatest("idf", F.lit(1e-6)) if epsilon is None else F.when(F.col("idf") < 0, F.lit(epsilon * mean)).otherwise(F.col("idf"))
    wanted = stage(asked.select("term").distinct(), "asked")
    if wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        wanted = F.broadcast(wanted)
    weights = terms.join(wanted, "term", "left_semi").select("term", idf.alias("idf"))
    words = docs.select(F.col(id_col).alias("id"), tokens(text, stem).alias("w")).select("id", F.size("w").alias("length"), F.explode_outer("w").alias("term"))
    post = words.join(wanted, "term", "left_semi").groupBy("id", "term", "length").agg(F.count("*").alias("tf"))
    post = post if only is None else post.join(only, "id", "left_semi")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))
    scored = post.join(asked, "term").join(weights, "term").groupBy("q", "id").agg(F.sum(part).alias("raw"))
    # the best are chosen before they are scaled: a task keeps about k rows of a query, whatever its words
    nearly = F.rank().over(Window.partitionBy("q").orderBy(F.desc("about")))
    top = scored.withColumn("about", F.round("raw", 6)).withColumn("nearly", nearly).where(F.col("nearly") <= k)
    best = F.max("raw").over(Window.partitionBy("q"))
    ranked = top.withColumn("score", F.round(F.when(best > 0, F.col("raw") / best).otherwise(0.0), 9)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "id", "score", "rank")


def bm25_many(docs: DataFrame, id_col: str, text: Column, queries: DataFrame, query_id: str, query_text: Column, k: int, stem: bool = False, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """:func:`bm25` for queries as many and as long as the rows: no posting is shuffled (:mod:`tessera.operators.postings`).  Ids are
    whole numbers, and rows of one id are rows of their own."""
    blocks = postings.packed(docs, id_col, text, stem)
    terms, n, average = postings.vocabulary(blocks)
    terms = terms.withColumn("idf", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = terms.agg(F.avg("idf")).first()[0] or 0.0
    weights = terms.select("term", F.when(F.col("idf") < 0, F.lit(epsilon * mean)).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select(F.col(query_id).alias("q"), F.explode(tokens(query_text, stem)).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    each = asked.join(weights, "term").groupBy(F.col("q").cast("bigint").alias("q")).agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("w"))).alias("x"))
    top = postings.best(blocks, each.select("q", F.col("x.term").alias("terms"), F.col("x.w").alias("weights")), k, (k1, b, average))
    best = F.max("raw").over(Window.partitionBy("q"))
    ranked = top.withColumn("score", F.round(F.col("raw") / best, 9)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "id", "score", "rank")


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """``(query_id, id, score, rank)``: ``alpha`` times the vector score (at least 0) and the rest of the text score over its best,
    clamped to [0, 1]; what only one of both found has 0 in the other."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    text = text_hits.select("query_id", "id", F.coalesce(F.try_divide(F.col("score"), best), F.lit(0.0)).alias("t"))
    vector = vector_hits.select("query_id", "id", F.greatest(F.lit(0.0), F.col("score")).alias("v"))
    score = alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("t", F.lit(0.0))
    both = vector.join(text, ["query_id", "id"], "full").withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def distance_score(distance: Column) -> Column:
    """A cosine distance in [0, 2] as a score in [0, 1]."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def filtered(docs: DataFrame, metadata: str, filters: dict[str, object] | None) -> DataFrame:
    """Rows whose metadata (JSON) pass the filters, before anything is scored."""
    return docs.where(json_matches(F.col(metadata), filters)) if filters else docs


def search(docs: DataFrame, query: str, k: int = 5, mode: str = "overlap", id_col: str = "doc_id", text_col: str = "content", metadata: str | None = None, filters: dict[str, object] | None = None, namespace: str | None = None, stem: bool = True) -> DataFrame:
    """Search one namespace's documents: ``mode`` is ``overlap``, ``plain`` (punctuation kept), ``all`` (every term must occur) or ``bm25``.

    A blank query finds nothing.  Where ``docs`` has a column ``namespace``, only one is searched: a null one is ``_default``, and no
    ``namespace`` asks for that; :data:`EVERYWHERE` asks for all, in which documents are told apart by namespace and id.  Filters
    and namespace apply before scoring, so that ``k`` rows come if there are ``k`` (:func:`search_then_filter` does the other).
    """
    named = "namespace" in docs.columns
    if named and namespace != EVERYWHERE:
        docs = docs.where(F.coalesce("namespace", F.lit(DEFAULT)) == (DEFAULT if namespace is None else namespace))
    if metadata:
        docs = filtered(docs, metadata, filters)
    words = _query_terms(docs, query, mode, stem)
    if not words:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    text = F.col(text_col)
    if mode in ("overlap", "plain"):
        return term_overlap(docs, id_col, text, words, k, stem and mode == "overlap", punctuation=mode == "plain")
    only = None
    key = F.struct(F.col(id_col).alias("id"), F.coalesce("namespace", F.lit(DEFAULT)).alias("namespace")) if named else F.struct(F.col(id_col).alias("id"))
    keyed = docs.withColumn("__key", key)
    if mode == "all":
        every = F.size(F.array_intersect(tokens(text, stem), F.array(*map(F.lit, sorted(set(words)))))) == len(set(words))
        only = keyed.where(every).select(F.col("__key").alias("id"))
    asked = docs.sparkSession.createDataFrame([(0, query)], "q int, t string")
    hits = bm25(keyed, "__key", text, asked, "q", F.col("t"), k, stem, epsilon=0.25 if only is None else None, only=only)
    return keyed.join(hits.select(F.col("id").alias("__key"), "score"), "__key").orderBy(F.desc("score"), "__key").drop("__key")


def search_then_filter(docs: DataFrame, query: str, k: int, metadata: str, filters: dict[str, object], prefetch: int = 5, **options) -> DataFrame:
    """:func:`search` for ``prefetch * k`` rows, of which the ``k`` best that pass the filters are kept: the corpus statistics are those of
    all documents, and fewer than ``k`` rows may come."""
    found = search(docs, query, prefetch * k, metadata=metadata, **options)
    return filtered(found, metadata, filters).orderBy(F.desc("score"), options.get("id_col", "doc_id")).limit(k)


def _query_terms(docs: DataFrame, query: str, mode: str, stem: bool) -> list[str]:
    """The query's terms by the expression that reads documents, so that both agree."""
    if not query.strip():
        return []
    one = docs.sparkSession.createDataFrame([(query,)], "q string")
    return one.select(plain_tokens(F.col("q")) if mode == "plain" else tokens(F.col("q"), stem)).first()[0]


# ---- the documents of a store


def current(log: DataFrame, order: list[str], keys: tuple[str, ...] = ("namespace", "doc_id")) -> DataFrame:
    """The last version of each document of a log of writes; a null namespace is ``_default``."""
    from tessera.operators.diff import latest

    return latest(log.withColumn("namespace", F.coalesce("namespace", F.lit("_default"))), list(keys), order)


def add(docs: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("namespace", "doc_id")) -> DataFrame:
    """``docs`` with new documents; an id that is there is an error."""
    if new.join(docs, list(keys), "left_semi").head(1) or new.groupBy(*keys).count().where("count > 1").head(1):
        raise ValueError("a document of this id is already there")
    return docs.unionByName(new)


def update(docs: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("namespace", "doc_id")) -> DataFrame:
    """``docs`` with documents replaced; those that are not there are ignored."""
    there = new.join(docs.select(*keys), list(keys), "left_semi")
    return docs.join(there.select(*keys), list(keys), "left_anti").unionByName(there)


def remove(docs: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("namespace", "doc_id")) -> DataFrame:
    return docs.join(gone.select(*keys), list(keys), "left_anti")


def stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("namespace").agg(F.count("*").alias("n"))
