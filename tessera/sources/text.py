"""Delimited, JSON and text files, and listings of them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- delimited


def read_delimited(spark: SparkSession, paths: str | list[str], sep: str = "\t", header: bool = True, schema: str | None = None, columns: list[str] | None = None, strip: bool = True, parse: bool = False, recursive: bool = False, glob: str | None = None, top: int | None = None) -> DataFrame:
    """Rows of delimited files, all text unless a schema is given or values are parsed; fields stripped, blank lines dropped."""
    reader = spark.read.option("sep", sep).option("header", header).option("recursiveFileLookup", recursive).option("escape", '"').option("multiLine", False)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if parse:
        reader = reader.option("inferSchema", True)
    df = (reader.schema(schema) if schema else reader).csv(paths)
    if strip:
        df = df.select(*[F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])
    if columns:
        df = df.select(*columns)
    return df.limit(top) if top is not None else df


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True, append: bool = False, flatten: bool = False) -> None:
    """With ``flatten`` struct columns become one column per field."""
    if flatten:
        df = df.select(*[F.col(f"`{f.name}`.*") if isinstance(f.dataType, T.StructType) else F.col(f"`{f.name}`") for f in df.schema])
    df.write.mode("append" if append else "overwrite").option("sep", sep).option("header", header).csv(path)


# ---- JSON


def read_json(spark: SparkSession, paths: str | list[str], schema: str | None = None, columns: list[str] | None = None, errors: str = "fail", whole: bool = False, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Objects of JSON line files (or one document per file with ``whole``).  ``errors``: ``fail``, ``keep`` (in ``_corrupt_record``) or ``drop``."""
    mode = {"fail": "FAILFAST", "keep": "PERMISSIVE", "drop": "DROPMALFORMED"}[errors]
    reader = spark.read.option("mode", mode).option("multiLine", whole).option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if schema and errors == "keep" and "_corrupt_record" not in schema:
        schema += ", _corrupt_record string"
    df = (reader.schema(schema) if schema else reader).json(paths)
    return df.select(*columns) if columns else df


def write_json(df: DataFrame, path: str, append: bool = False, by: list[str] = (), records_per_file: int | None = None) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if records_per_file:
        writer = writer.option("maxRecordsPerFile", records_per_file)
    writer.json(path)


def as_json(df: DataFrame) -> DataFrame:
    """``(json)``: each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def from_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def split_parts(df: DataFrame, key: str, large: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, parts)``: texts of the ``large`` columns of at least ``least`` characters go to a side table ``(key, name, value)``,
    with a marker in their place."""
    big = lambda c: F.char_length(c) >= least
    marked = df.withColumns({c: F.when(big(c), F.to_json(F.struct(F.lit(c).alias("__part__")))).otherwise(F.col(c)) for c in large})
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.when(big(c), F.col(c)).alias("value")) for c in large])
    return marked, df.select(key, F.inline(cells)).where("value is not null")


def join_parts(rows: DataFrame, parts: DataFrame, key: str, large: list[str]) -> DataFrame:
    """The inverse of :func:`split_parts`."""
    wide = parts.groupBy(key).agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(f"__{c}") for c in large])
    return rows.join(wide, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in large}).drop(*[f"__{c}" for c in large])


# ---- lines and whole files


def read_lines(spark: SparkSession, paths: str | list[str], lstrip: bool = False, rstrip: bool = True, drop_blank: bool = False, rate: float = 1.0, seed: int = 0, with_path: bool = False) -> DataFrame:
    df = spark.read.text(paths)
    if with_path:
        df = df.withColumn("path", F.col("_metadata.file_path"))
    value = F.col("value")
    value = F.ltrim(value) if lstrip else value
    value = F.rtrim(value) if rstrip else value
    df = df.withColumn("value", value)
    if drop_blank:
        df = df.where(F.trim("value") != "")
    return df.sample(False, rate, seed) if rate < 1 else df


def write_lines(df: DataFrame, path: str, column: str = "value", append: bool = False, drop_blank: bool = False, lines_per_file: int | None = None) -> None:
    rows = df.select(F.regexp_replace(F.col(column).cast("string"), r"\n+$", "").alias("value"))
    if drop_blank:
        rows = rows.where(F.trim("value") != "")
    writer = rows.write.mode("append" if append else "overwrite")
    if lines_per_file:
        writer = writer.option("maxRecordsPerFile", lines_per_file)
    writer.text(path)


def read_whole(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """``(path, value)``: a row per file."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


# ---- listings


def list_files(spark: SparkSession, paths: str | list[str], glob: str = "*", recursive: bool = True) -> DataFrame:
    """``(path, name, size, modified)``, without reading contents."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(paths)
    m = F.col("_metadata")
    return df.select(m["file_path"].alias("path"), m["file_name"].alias("name"), m["file_size"].alias("size"), m["file_modification_time"].alias("modified"))


def by_index(df: DataFrame, path: str = "path") -> DataFrame:
    """Paths in the order of the last number in their names, then by name."""
    return df.orderBy(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"(\d+)\D*$", 1).try_cast("bigint").asc_nulls_last(), path)


def _canonical(content: bytes | None, raw_above: int) -> bytes | None:
    if content is None or len(content) > raw_above:
        return content
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return content
    lines = unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).split("\n")
    return "\n".join(x.rstrip() for x in lines).rstrip("\n").encode()


def canonical_hash(content: str, raw_above: int = 10 << 20) -> Column:
    """SHA-256 of a binary column as text with ``\\n`` line ends, without blanks at line ends, in NFC; of larger or non-text
    content as it is."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: _canonical(b, raw_above))

    return F.sha2(F.pandas_udf(run, T.BinaryType())(content), 256)


def agreed_and_conflicting(files: DataFrame, root: str, path: str, digest: str) -> DataFrame:
    """``(path, n_roots, n_versions, agreed)`` of the paths that several roots have."""
    by = files.groupBy(path).agg(F.count_distinct(root).alias("n_roots"), F.count_distinct(digest).alias("n_versions"))
    return by.where("n_roots > 1").withColumn("agreed", F.col("n_versions") == 1)


def parent_at(path: str, depth: int = 1) -> Column:
    return F.substring_index(path, "/", depth)


def dated_paths(spark: SparkSession, template: str, start: str, end: str) -> DataFrame:
    """``(date, path)``: a template with ``{year} {month} {day}`` over the dates from start to end."""
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval 1 day)) as date")
    path = F.lit(template)
    for name, fmt in (("year", "yyyy"), ("month", "MM"), ("day", "dd")):
        path = F.replace(path, F.lit("{" + name + "}"), F.date_format("date", fmt))
    return days.withColumn("path", path)


def first_existing(dated: DataFrame, there: DataFrame, forward: bool = True) -> DataFrame:
    """The first dated path that exists, walking from the first date (or back from the last)."""
    return dated.join(there.select("path"), "path", "left_semi").orderBy(F.asc("date") if forward else F.desc("date")).limit(1)


# ---- session logs


def turn_entries(turns: DataFrame, files: DataFrame, session: str = "session_id", turn: str = "turn_number", log_file: str = "log_file", path: str = "path", body: str = "body") -> DataFrame:
    """``(session, turn, line, entry)``: the entries of the log file that each turn names, in their order in the file; a turn without
    a file gives none, and a line that is no whole JSON value is left out."""
    named = turns.select(F.col(session).alias("session"), F.col(turn).alias("turn"), F.col(log_file).alias("__path"))
    held = files.select(F.col(session).alias("session"), F.col(path).alias("__path"), F.col(body).alias("__body"))
    return _entries(named.join(held, ["session", "__path"]), ["session", "turn"])


def cross_turn_entries(sessions: DataFrame, files: DataFrame, session: str = "session_id", log_file: str = "session_log_file", path: str = "path", body: str = "body") -> DataFrame:
    """``(session, turn, line, entry)``: the entries of each session's own log file, of no turn (null)."""
    named = sessions.select(F.col(session).alias("session"), F.lit(None).cast("bigint").alias("turn"), F.col(log_file).alias("__path"))
    held = files.select(F.col(session).alias("session"), F.col(path).alias("__path"), F.col(body).alias("__body"))
    return _entries(named.join(held, ["session", "__path"]), ["session", "turn"])


def _entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    from tessera.functions.nested import whole_json

    lines = rows.select(*keys, F.posexplode(F.split("__body", r"\r?\n")).alias("line", "entry")).where(F.trim("entry") != "")
    return lines.where(whole_json(F.col("entry")).isNotNull())
