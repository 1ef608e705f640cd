"""Queries through weighted distances, spelling by sound, markers and protected regions, session logs, tree and graph orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import dates, matching, strings
from tessera.functions.matching import SOUNDS, Conflict, Weights
from tessera.functions.paths import plain_path
from tessera.operators import graph
from tessera.queries import graphs, upkeep
from tessera.sources import text

_SOUND = "p_name"
for _old, _new in SOUNDS.items():
    _SOUND = f"replace({_SOUND}, '{_old}', '{_new}')"


@query(f"SELECT p_partkey, {_SOUND} AS sound, replace(p_name, 'c', 'k') AS own FROM part")
def text_by_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", matching.by_sound(n).alias("sound"), matching.by_sound(n, {"c": "k"}).alias("own"))


_D = "(levenshtein(a, b) / greatest(length(a), length(b)))"


@query(
    f"""WITH x AS (SELECT p_partkey, p_name AS a, 'cold ' || lower(p_type) AS b FROM part), h AS (SELECT *, 1 - levenshtein(replace(a, ' ', '')[:4], replace(b, ' ', '')[:4]) / 4.0 AS alike FROM x)
    SELECT p_partkey, round({_D}, 6) AS plain, round({_D} * CASE WHEN a[:2] = b[:2] AND alike > 0.55 THEN 1 - 0.5 * alike ELSE 1 END, 6) AS start,
    round({_D} * CASE WHEN replace(a, ' ', '')[:4] = replace(b, ' ', '')[:4] THEN 0.5 ELSE 1 END, 6) AS same_start,
    round({_D} * CASE WHEN contains(b, split_part(a, ' ', 1)) THEN 0.25 ELSE 1 END * CASE WHEN contains(a, 'cold') THEN 0.5 ELSE 1 END, 6) AS token,
    round({_D} * CASE WHEN (ends_with(a, 'bolt') AND ends_with(b, 'economy')) OR (ends_with(b, 'bolt') AND ends_with(a, 'economy')) THEN 1.5 ELSE 1 END, 6) AS ends,
    round({_D} * CASE WHEN contains(a[:3], 'o') <> contains(b[:3], 'o') AND contains(a[:3], 'e') <> contains(b[:3], 'e') AND contains(a[:3], 'o') <> contains(a[:3], 'e') THEN 2.0 ELSE 1 END, 6) AS starts,
    CASE WHEN length(a) < 10 THEN 0 ELSE round({_D}, 6) END AS least, CAST(0 AS DOUBLE) AS empty, CAST(1 AS DOUBLE) AS empty_counts, round(levenshtein(a[:3], b[:3]) / 3 * CASE WHEN a[1] = b[1] THEN 0.1 ELSE 1 END, 6) AS short,
    round((length(b) - length(b[:5])) / length(b) * 0.3, 6) AS heads FROM h"""
)
def text_weighted_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weight of a weighted distance by itself."""
    a, b = F.col("p_name"), F.concat(F.lit("cold "), F.lower("p_type"))
    d = lambda x, y, **w: F.round(matching.weighted_distance(x, y, Weights(**w)), 6)
    return table(spark, sf_dir, "part").select(
        "p_partkey", d(a, b).alias("plain"), d(a, b, start=0.5, start_size=4).alias("start"), d(a, b, start=0.5, start_size=4, start_similarity=None).alias("same_start"), d(a, b, token=(0.25, 0.5)).alias("token"),
        d(a, b, ends=(Conflict(("bolt",), ("economy",), 1.5),)).alias("ends"), d(a, b, starts=(Conflict(("o",), ("e",), 2.0, 3),)).alias("starts"), d(a, b, least_a=10).alias("least"),
        d(F.lit(""), b, free_if_empty=("a",)).alias("empty"), d(a, F.lit(""), free_if_empty=("a",)).alias("empty_counts"), d(F.substring(a, 1, 3), F.substring(b, 1, 3), short=0.1).alias("short"),
        d(F.substring(b, 1, 5), b, heads=(0.3, None)).alias("heads"),
    )


@query(
    r"""SELECT p_partkey, p_name AS stripped, p_name || '  ' AS left_only, p_name AS chars, length(p_name) + 1 AS start, length(p_name) + 1 + length(p_brand) AS stop, CAST(NULL AS INTEGER) AS no_stop, length(p_name) AS end_stop,
    list_filter([CASE WHEN contains(p_name, 'cold') THEN 0 END, CASE WHEN contains(p_name, 'bolt') THEN 1 END, CASE WHEN contains(p_name, 'red') THEN 2 END], lambda x: x IS NOT NULL) AS groups,
    upper(p_name) || ' `' || p_brand || '` ' || upper(p_name) AS guarded, upper(p_name) || ' ' || p_brand AS unwrapped, p_brand[-1] AS tail, 12 AS n_random, array_to_string(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('bolt', 'cold')), ' ') AS left_over,
    array_to_string(list_filter(string_split(p_name, ' '), lambda w: w <> 'bolt'), ' ') AS with_parts FROM part"""
)
def string_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b = F.col("p_name"), F.col("p_brand")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    pair = matching.index_pair(say(n, "<", b, ">"), "<", ">")
    marked = say(n, " `", b, "` ", n)
    return table(spark, sf_dir, "part").select(
        "p_partkey", matching.strip(say("  ", n, " \n")).alias("stripped"), matching.strip(say("  ", n, "  "), right=False).alias("left_only"), matching.strip(say("-=", n, "=-"), chars="-=").alias("chars"),
        pair["start"].alias("start"), pair["stop"].alias("stop"), matching.index_pair(n, "<", ">")["stop"].alias("no_stop"), matching.index_pair(n, "<", ">", fallback="end")["stop"].alias("end_stop"),
        matching.matched_groups(n, "(cold)|(bolt)|(red)").alias("groups"), matching.protected(marked, "`([^`]*)`", F.upper).alias("guarded"),
        matching.protected(say(n, " `", b, "`"), "`([^`]*)`", F.upper, 1).alias("unwrapped"), strings.last_match(b, matching.tail_pattern(r"\d")).alias("tail"), F.char_length(matching.random_string(12, 3)).alias("n_random"),
        matching.without_shared_tokens(n, F.lit("bolt cold"))[0].alias("left_over"), matching.without_shared_tokens(n, F.lit("bolt cold colder"), keep_parts=True)[0].alias("with_parts"),
    )


@query("SELECT r_regionkey, 'yyyy-MM-dd' AS day, 'yyyy-MM' AS month, 'HH:mm' AS minute, 'dd/MM/yyyy' AS all_day, 14 AS n_now, 8 AS n_today FROM region")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats down to a granularity, and the lengths of the current time and day as text."""
    f = dates.format_down_to
    formats = {"day": f("day", "yyyy-MM-dd"), "month": f("month", "yyyy-MM-dd"), "minute": f("minute", "HH:mm:ss"), "all_day": f("hour", "dd/MM/yyyy")}
    return table(spark, sf_dir, "region").select("r_regionkey", *[F.lit(v).alias(k) for k, v in formats.items()], F.char_length(dates.now_text()).alias("n_now"), F.char_length(dates.today_text()).alias("n_today"))


@query(
    f"""{upkeep._NAMED_FILES}, g AS (SELECT session_id AS session, TRY_CAST(TRY_CAST(turn ->> '$.turn_number' AS DOUBLE) AS BIGINT) AS turn, {upkeep._SEGMENTS.format("(turn ->> '$.log_file')")} AS path FROM t WHERE json_type(turn) = 'OBJECT' AND turn ->> '$.log_file' IS NOT NULL)
    SELECT session, turn, line AS entry FROM g JOIN (SELECT session_id AS session, path, line FROM l WHERE json_valid(line)) USING (session, path)"""
)
def session_turn_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log entries of every turn of the current manifests."""
    turns = upkeep.manifest_tables(spark, sf_dir)[1].withColumn("log_file", plain_path(F.col("log_file")))
    files = upkeep.named_session_files(spark, sf_dir).where("kind = 'log'")
    return text.turn_entries(turns, files).select("session", "turn", "entry")


@query(
    """SELECT 'r' || r_regionkey AS node, ['r' || r_regionkey] AS path, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, ['r' || n_regionkey, 'n' || n_nationkey], 1 FROM nation
    UNION ALL SELECT 'c' || c_custkey, ['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey], 2 FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def tree_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths from the root, in whose order nodes stand depth first."""
    return graph.tree_paths(graphs._tree(spark, sf_dir), "node", "parent").select("node", "path", "depth")


@query(
    """WITH e AS (SELECT DISTINCT 'o' || o_orderkey AS s, 'p' || l_partkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)
    SELECT node, CASE node[1] WHEN 'c' THEN 0 WHEN 'o' THEN 1 WHEN 'p' THEN 2 ELSE 3 END AS rank FROM (SELECT s AS node FROM e UNION SELECT t FROM e)"""
)
def graph_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of customers, orders, parts and suppliers in the graph that leads from one to the next."""
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    e = o.select(named("c", "o_custkey").alias("source_id"), named("o", "o_orderkey").alias("target_id"))
    e = e.union(lines.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(named("o", "l_orderkey"), named("p", "l_partkey"))).union(lines.select(named("p", "l_partkey"), named("s", "l_suppkey")))
    return graph.acyclic_order(e).select("node", "rank")
