"""Queries on files, manifests, copies and hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions.nested import whole_json_field
from tessera.functions.paths import path_below, plain_path
from tessera.operators import compaction, diff, hotkeys, shred
from tessera.staging import new_path, stage

# ---- copies


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of both copies as last scanned: ``(root, rel_path, size, sha256)``; one scan for both."""
    roots = table(spark, sf_dir, "file_roots").where("copy_role = 'compared'").select(F.lower(F.trim("root_name")).alias("root"), "root_dir")
    scans = table(spark, sf_dir, "file_candidates").withColumn("root", F.lower(F.trim("root_name")))
    digest = F.regexp_replace(F.lower(F.trim(F.regexp_replace("sha256", r"\s+", ""))), r"^(sha256:|0x)", "")
    scans = scans.join(F.broadcast(roots), "root").select(
        "root", path_below("abs_path", "root_dir").alias("rel_path"), "scanned_at", "scan_id", "size", F.nullif(F.ltrim(digest, F.lit("0")), F.lit("")).alias("sha256")
    )
    return diff.latest(scans.where("rel_path is not null"), ["root", "rel_path"], ["scanned_at", "scan_id"])


# ``..`` goes with the segment before it, as often as segments can stand in a row
_PLAIN = r"regexp_replace(replace(nfc_normalize(abs_path), '\', '/'), '(/\.?)+(/|$)', '/', 'g')"
for _ in range(6):
    _PLAIN = rf"regexp_replace({_PLAIN}, '/[^/]+/\.\.(/|$)', '/')"


_BOTH = rf"""WITH s AS (SELECT lower(trim(root_name)) AS root, scan_id, scanned_at, size, nullif(ltrim(regexp_replace(lower(regexp_replace(sha256, '\s+', '', 'g')), '^(sha256:|0x)', ''), '0'), '') AS sha,
    {_PLAIN} AS path FROM file_candidates WHERE lower(trim(root_name)) IN ('north_copy', 'south_copy')),
    r AS (SELECT *, CASE root WHEN 'north_copy' THEN substr(path, length('/srv/north/data/') + 1) ELSE substr(path, length('D:/south/data/') + 1) END AS rel FROM s),
    l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY root, rel ORDER BY scanned_at DESC, scan_id DESC) = 1),
    j AS (SELECT coalesce(n.rel, s.rel) AS rel, n.rel IS NULL AS no_n, s.rel IS NULL AS no_s, n.size IS DISTINCT FROM s.size AS z, n.sha IS DISTINCT FROM s.sha AS h,
    CAST(n.size AS VARCHAR) AS n_size, CAST(s.size AS VARCHAR) AS s_size, n.sha AS n_sha, s.sha AS s_sha
    FROM (SELECT * FROM l WHERE root = 'north_copy') n FULL JOIN (SELECT * FROM l WHERE root = 'south_copy') s ON n.rel = s.rel)"""


@query(
    f"""{_BOTH} SELECT rel AS rel_path, 'missing_in_north' AS diff FROM j WHERE no_n UNION ALL SELECT rel, 'missing_in_south' FROM j WHERE no_s
    UNION ALL SELECT rel, 'size' FROM j WHERE NOT no_n AND NOT no_s AND z UNION ALL SELECT rel, 'sha256' FROM j WHERE NOT no_n AND NOT no_s AND h"""
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_differences(spark, sf_dir).select("rel_path", "diff")


@query(
    f"""{_BOTH} SELECT rel AS rel_path, 'missing_in_north' AS diff, NULL AS left_value, NULL AS right_value FROM j WHERE no_n UNION ALL SELECT rel, 'missing_in_south', NULL, NULL FROM j WHERE no_s
    UNION ALL SELECT rel, 'size', n_size, s_size FROM j WHERE NOT no_n AND NOT no_s AND z UNION ALL SELECT rel, 'sha256', n_sha, s_sha FROM j WHERE NOT no_n AND NOT no_s AND h"""
)
def p2_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs, with both values."""
    side = F.when(F.col("root") == "north_copy", False).when(F.col("root") == "south_copy", True)
    return diff.compare_sides(_copies(spark, sf_dir), side, ["rel_path"], ["size", "sha256"], "north", "south")


# ---- manifests

LISTS = ("turns", "artifacts")


def newest_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(session_id, manifest_id)`` of the complete manifest written last of each session, staged."""
    saved = table(spark, sf_dir, "session_manifests")
    named = saved.select(whole_json_field(F.col("manifest"), "session_id").alias("session_id"), "written_at", "manifest_id").where("session_id is not null")
    # the newest are chosen by ids alone: no manifest is shuffled that is not needed
    return stage(diff.latest(named, ["session_id"], ["written_at", "manifest_id"]).select("session_id", "manifest_id"), "newest")


def manifest_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sessions, turns and artifacts of the current manifests, tied by session_id and turn_number."""
    newest = newest_manifests(spark, sf_dir)
    current = table(spark, sf_dir, "session_manifests").select("manifest_id", "manifest").join(newest.select("manifest_id"), "manifest_id", "left_semi")
    nodes = stage(shred.shred(current, "manifest_id", "manifest", LISTS), "nodes")
    times = ["creation_timestamp", "end_timestamp"]
    sessions = shred.table(nodes, "", {c: c for c in ["session_id", *times, "session_type", "status", "session_dir", "session_log_file"]})
    turns = shred.table(nodes, "/turns", {c: c for c in ["turn_number", "start_timestamp", "end_timestamp", "log_file"]})
    turns = turns.withColumn("turn_number", shred.to_integer(F.col("turn_number")))
    artifacts = shred.table(nodes, "/turns/artifacts", {"path": "path", "type": "type", "producer": ["producer", "class_name"], "timestamp": "timestamp", "step": "step"})
    artifacts = artifacts.withColumn("step", shred.to_integer(F.col("step")))
    key = newest.select(F.col("manifest_id").alias("doc"), "session_id")
    turns = stage(turns.join(key, "doc").select("doc", "node", "session_id", "turn_number", "start_timestamp", "end_timestamp", "log_file"), "turns")
    of = turns.select("doc", F.col("node").alias("parent"), "session_id", "turn_number")
    artifacts = artifacts.join(of, ["doc", "parent"]).select("doc", "node", "parent", "session_id", "turn_number", "path", "type", "producer", "timestamp", "step")
    return sessions, turns, artifacts


def _elements(x: str) -> str:
    """SQL for the elements of a list however it is spelled."""
    plain = f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN CAST({x} ->> '$' AS JSON) ELSE {x} END)"
    return (
        f"(CASE WHEN json_type({plain}) = 'ARRAY' THEN json_extract({plain}, '$[*]') WHEN json_type({plain}) <> 'OBJECT' THEN [] WHEN len(list_filter(json_keys({plain}), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0"
        f" THEN list_transform(json_keys({plain}), lambda k: json_extract({plain}, '$.\"' || k || '\"')) ELSE [{plain}] END)"
    )


_CURRENT = f"""WITH m AS (SELECT manifest_id, CAST(manifest AS JSON) AS j, written_at FROM session_manifests WHERE json_valid(manifest)),
    c AS (SELECT j ->> '$.session_id' AS session_id, j -> '$.turns' AS turns FROM m QUALIFY row_number() OVER (PARTITION BY j ->> '$.session_id' ORDER BY written_at DESC, manifest_id DESC) = 1),
    t AS (SELECT session_id, unnest({_elements("turns")}) AS turn FROM c), a AS (SELECT session_id, turn, unnest({_elements("(turn -> '$.artifacts')")}) AS artifact FROM t)"""


@query(
    f"{_CURRENT} SELECT DISTINCT session_id, CAST(CAST(turn ->> '$.turn_number' AS DOUBLE) AS BIGINT) AS turn_number, artifact ->> '$.path' AS artifact_path FROM a WHERE artifact ->> '$.path' IS NOT NULL"
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = manifest_tables(spark, sf_dir)[2].where("path is not null")
    return artifacts.select("session_id", "turn_number", F.col("path").alias("artifact_path")).distinct()


_SESSION_FIELDS = ["session_id", "creation_timestamp", "end_timestamp", "session_type", "status", "session_dir", "session_log_file"]


@query(
    f"SELECT {', '.join(f_ + ' AS ' + n for n, f_ in ((n, f'(j ->> {chr(39)}$.{n}{chr(39)})') for n in _SESSION_FIELDS))} FROM (SELECT CAST(manifest AS JSON) AS j, written_at, manifest_id FROM session_manifests WHERE json_valid(manifest))"
    " QUALIFY row_number() OVER (PARTITION BY j ->> '$.session_id' ORDER BY written_at DESC, manifest_id DESC) = 1"
)
def p5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_tables(spark, sf_dir)[0].select(*_SESSION_FIELDS)


@query(
    f"""{_CURRENT} SELECT session_id, TRY_CAST(TRY_CAST(turn ->> '$.turn_number' AS DOUBLE) AS BIGINT) AS turn_number, turn ->> '$.start_timestamp' AS start_timestamp, turn ->> '$.end_timestamp' AS end_timestamp,
    turn ->> '$.log_file' AS log_file FROM t WHERE json_type(turn) = 'OBJECT'"""
)
def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_tables(spark, sf_dir)[1].select("session_id", "turn_number", "start_timestamp", "end_timestamp", "log_file")


@query(
    f"""{_CURRENT} SELECT session_id, TRY_CAST(TRY_CAST(turn ->> '$.turn_number' AS DOUBLE) AS BIGINT) AS turn_number, artifact ->> '$.path' AS path, artifact ->> '$.type' AS type,
    coalesce(artifact ->> '$.producer', artifact ->> '$.class_name') AS producer, artifact ->> '$.timestamp' AS timestamp, TRY_CAST(TRY_CAST(artifact ->> '$.step' AS DOUBLE) AS BIGINT) AS step FROM a WHERE json_type(artifact) = 'OBJECT'"""
)
def p5_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_tables(spark, sf_dir)[2].select("session_id", "turn_number", "path", "type", "producer", "timestamp", "step")


# ---- small files

#: Files below this size are small; files are written up to the second.
SMALL_BYTES, FILE_BYTES = 4096, 1 << 20


def named_session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, session_id, path, kind, body)`` of the named files as last written, whatever their size."""
    _, turns, artifacts = manifest_tables(spark, sf_dir)
    named = turns.select("session_id", plain_path(F.col("log_file")).alias("path")).unionByName(artifacts.select("session_id", plain_path(F.col("path")).alias("path")))
    named = named.where("path <> ''").distinct()
    files = table(spark, sf_dir, "session_files")
    # the newest writes are chosen by ids alone, and the bodies fetched for them
    writes = files.select("session_id", plain_path(F.col("file_path")).alias("path"), "written_at", "file_id").join(named, ["session_id", "path"], "left_semi")
    newest = diff.latest(writes, ["session_id", "path"], ["written_at", "file_id"]).select("session_id", "path", "file_id")
    files = newest.join(files.select("file_id", "kind", "body"), "file_id")
    return files.select(F.concat_ws("\n", "session_id", "path").alias("name"), "session_id", "path", "kind", "body")


def compacted_session_files(spark: SparkSession, sf_dir: str) -> compaction.Compacted:
    def records(binned: DataFrame) -> DataFrame:
        return compaction.log_records(binned, "session_id", "path", "kind", "body", F.col("path"))

    return compaction.compact(named_session_files(spark, sf_dir), "name", "body", records, new_path(spark, "compacted"), FILE_BYTES)


_SEGMENTS = "array_to_string(list_filter(string_split(replace({}, '\\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/')"


@query(
    f"""{_CURRENT}, n AS (SELECT session_id, turn ->> '$.log_file' AS p FROM t UNION ALL SELECT session_id, artifact ->> '$.path' FROM a),
    w AS (SELECT DISTINCT session_id, {_SEGMENTS.format("p")} AS path FROM n WHERE p IS NOT NULL),
    f AS (SELECT session_id, {_SEGMENTS.format("file_path")} AS path, body FROM session_files QUALIFY row_number() OVER (PARTITION BY session_id, {_SEGMENTS.format("file_path")} ORDER BY written_at DESC, file_id DESC) = 1)
    SELECT session_id, path AS file_path FROM f SEMI JOIN w USING (session_id, path) WHERE strlen(coalesce(body, '')) < {SMALL_BYTES}"""
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small ones of the named files, all of which are compacted."""
    parts = F.split("name", "\n", 2)
    return compacted_session_files(spark, sf_dir).manifest.where(F.col("n_bytes") < SMALL_BYTES).select(parts[0].alias("session_id"), parts[1].alias("file_path"))


_NAMED_FILES = f"""{_CURRENT}, n AS (SELECT session_id, turn ->> '$.log_file' AS p FROM t UNION ALL SELECT session_id, artifact ->> '$.path' FROM a),
    w AS (SELECT DISTINCT session_id, {_SEGMENTS.format("p")} AS path FROM n WHERE p IS NOT NULL),
    f AS (SELECT session_id, {_SEGMENTS.format("file_path")} AS path, kind, body FROM session_files QUALIFY row_number() OVER (PARTITION BY session_id, {_SEGMENTS.format("file_path")} ORDER BY written_at DESC, file_id DESC) = 1),
    k AS (SELECT f.* FROM f SEMI JOIN w USING (session_id, path)),
    l AS (SELECT session_id, path, line, CASE WHEN json_valid(line) THEN line ->> '$.record_id' END AS record_id FROM (SELECT session_id, path, unnest(string_split_regex(body, '\\r?\\n')) AS line FROM k WHERE kind = 'log') WHERE trim(line) <> ''),
    r AS (SELECT session_id, record_id, count(DISTINCT path) AS n_paths, count(DISTINCT line) > 1 AS conflict FROM l WHERE record_id IS NOT NULL GROUP BY ALL)"""


@query(
    f"""{_NAMED_FILES} SELECT (SELECT count(*) FROM r) + (SELECT count(*) FROM l WHERE record_id IS NULL) + (SELECT count(*) FROM k WHERE kind IS DISTINCT FROM 'log') AS n_rows, (SELECT count(*) FROM k) AS n_files,
    (SELECT count(*) FROM r) AS n_records, (SELECT count(*) FROM r WHERE n_paths > 1) AS n_in_several, (SELECT count(*) FROM r WHERE conflict) AS n_conflicts, (SELECT sum(strlen(coalesce(body, ''))) FROM k) AS n_bytes"""
)
def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was consolidated, as a whole: rows, files, records, records in several files and with differing bodies, bytes of body read."""
    done = compacted_session_files(spark, sf_dir)
    data = spark.read.parquet(f"{done.path}/data")
    has, n = F.col("record_id").isNotNull(), lambda c: F.count(F.when(c, 1))
    rows = data.agg(F.count("*").alias("n_rows"), n(has).alias("n_records"), n(has & (F.size("paths") > 1)).alias("n_in_several"), n(has & F.col("conflict")).alias("n_conflicts"))
    files = done.manifest.agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
    return rows.join(files, F.lit(True)).select("n_rows", "n_files", "n_records", "n_in_several", "n_conflicts", "n_bytes")


@query()
def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that were written: rows and bytes of body in each."""
    done = compacted_session_files(spark, sf_dir)
    data = spark.read.parquet(f"{done.path}/data")
    return data.groupBy("bin").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("body")).alias("n_bytes"), F.countDistinct("session_id").alias("n_sessions"))


# ---- hot keys

DEFAULT_NAMESPACE, HOT_SHARE = "_default", 0.04
KEYED = {"kv_store": ("item_key", ["updated_at", "put_id"]), "doc_store": ("doc_id", ["updated_at", "row_id"]), "documents": ("doc_id", ["fetched_at", "doc_id"])}


def _namespace() -> F.Column:
    return F.coalesce("namespace", F.lit(DEFAULT_NAMESPACE))


@query(
    "WITH n AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, coalesce(namespace, '{DEFAULT_NAMESPACE}') AS namespace, count(*) AS n FROM {t} GROUP BY ALL" for t in KEYED)
    + f") SELECT table_name, namespace FROM (SELECT *, sum(n) OVER (PARTITION BY table_name) AS total FROM n) WHERE n >= {HOT_SHARE} * total"
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = None
    for name in KEYED:
        rows = table(spark, sf_dir, name).select("namespace")
        n = hotkeys.dense_sums(rows, _namespace(), {"n": F.lit(1)}).select(F.lit(name).alias("table_name"), F.col("key").alias("namespace"), "n")
        counts = n if counts is None else counts.unionByName(n)
    counts = stage(counts, "counts")
    total = counts.groupBy("table_name").agg(F.sum("n").alias("total"))
    return counts.join(total, "table_name").where(F.col("n") >= HOT_SHARE * F.col("total")).select("table_name", "namespace")


_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, coalesce(namespace, '{DEFAULT_NAMESPACE}') AS namespace, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {t} GROUP BY ALL" for t, (k, _) in KEYED.items()
)


@query(_COUNTS)
def p6_namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct keys of every namespace."""
    found = None
    for name, (key, _) in KEYED.items():
        rows = table(spark, sf_dir, name).select(_namespace().alias("namespace"), key)
        counts = hotkeys.group_summary(rows, "namespace", key).select(F.lit(name).alias("table_name"), "namespace", "n_rows", "n_keys")
        found = counts if found is None else found.unionByName(counts)
    return found


@query(
    f"SELECT coalesce(namespace, '{DEFAULT_NAMESPACE}') AS namespace, item_key, put_id, value_json FROM kv_store"
    f" QUALIFY row_number() OVER (PARTITION BY coalesce(namespace, '{DEFAULT_NAMESPACE}'), item_key ORDER BY updated_at DESC NULLS LAST, put_id DESC) = 1"
)
def p6_newest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of every key of every namespace of the key-value log."""
    rows = table(spark, sf_dir, "kv_store").select(_namespace().alias("namespace"), "item_key", "updated_at", "put_id", "value_json")
    return hotkeys.newest_rows(rows, "namespace", "item_key", ["updated_at", "put_id"]).select("namespace", "item_key", "put_id", "value_json")


@query(
    """SELECT coalesce(namespace, '_default') AS namespace, doc_id, row_id FROM doc_store
    QUALIFY row_number() OVER (PARTITION BY coalesce(namespace, '_default'), doc_id ORDER BY TRY_CAST(updated_at AS TIMESTAMPTZ) DESC NULLS LAST, row_id DESC) = 1"""
)
def p6_newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of every document, times without a zone being UTC."""
    rows = table(spark, sf_dir, "doc_store").select(_namespace().alias("namespace"), "doc_id", F.col("updated_at").try_cast("timestamp").alias("at"), "row_id")
    return hotkeys.newest_rows(rows, "namespace", "doc_id", ["at", "row_id"]).select("namespace", "doc_id", "row_id")


@query(
    "SELECT coalesce(namespace, '_default') AS namespace, arg_max(doc_id, {'t': fetched_at, 'd': doc_id}) AS doc_id FROM documents WHERE fetched_at IS NOT NULL GROUP BY ALL"
)
def p6_newest_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document fetched last in every namespace."""
    rows = table(spark, sf_dir, "documents").where("fetched_at is not null").select(_namespace().alias("namespace"), "fetched_at", "doc_id")
    return diff.latest(rows, ["namespace"], ["fetched_at", "doc_id"]).select("namespace", "doc_id")
