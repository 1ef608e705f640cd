"""Consolidating a multitude of small files into few of good size."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.nested import whole_json_field
from tessera.staging import discard, folder_bytes, release, stage


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; items are placed from the largest down, each into the first bin with room.

    A tree of the most room below each node finds that bin in logarithmic time.  An item above the capacity gets a bin of
    its own.
    """
    n = len(sizes)
    leaves = 1 << max(1, int(n)).bit_length()
    room = np.full(2 * leaves, capacity, np.int64).tolist()
    out = np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = min(int(sizes[i]), capacity)
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        out[i] = at - leaves
        room[at] = room[at] - size if sizes[i] <= capacity else -1
        at //= 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
    # bins in the order they were opened, numbered without gaps
    return np.unique(out, return_inverse=True)[1]


#: Names that one task packs at most (about), however small they are.
NAMES_PER_TASK = 100_000


def assign_bins(files: DataFrame, name: str, size: str, capacity: int, bins_per_task: int = 64, names_per_task: int = NAMES_PER_TASK) -> DataFrame:
    """``files`` with a ``bin BIGINT``, numbered from 0 without gaps: names are dealt by hash to tasks of about ``bins_per_task`` bins
    and at most about ``names_per_task`` names, each packed by itself.

    Only names and sizes travel, and a task sees a bounded share of them, so the number of files is not limited by any
    machine.  What this gives away against packing everything at once is at most one part-filled bin per task.
    """
    total, count = files.agg(F.sum(F.least(F.col(size), F.lit(capacity))), F.count("*")).first()
    tasks = max(1, int((total or 0) // (capacity * bins_per_task)), -(-count // names_per_task))

    def run(table: pa.Table) -> pa.Table:
        bins = first_fit_decreasing(table[size].to_numpy(), capacity)
        return table.append_column("__local", pa.array(bins, pa.int64()))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema] + ["__task bigint", "__local bigint"])
    dealt = files.withColumn("__task", F.pmod(F.xxhash64(name), F.lit(tasks)).cast("bigint"))
    packed = stage(dealt.groupBy("__task").applyInArrow(run, schema), "packed")
    # a row per task: its bins stand after those of the tasks before it
    used = packed.groupBy("__task").agg((F.max("__local") + 1).alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = packed.join(used.select("__task", base.alias("__base")), "__task").withColumn("bin", F.col("__base") + F.col("__local")).drop("__task", "__local", "__base")
    out = stage(numbered, "bins")
    discard(packed)
    return out


@dataclass(frozen=True)
class Compacted:
    """``path``: the committed folder (``data``: one file per bin, ``manifest``: what went where)."""

    path: str
    manifest: DataFrame
    n_rows: int


#: Files that one job writes into one folder at most; beyond, one job and folder after the other.
FILES_PER_FOLDER = 100_000
#: Of the size that the compression measured so far promises, so much is used: bins differ.
FILL = 0.8


def checksum(*columns: Column) -> Column:
    """An order-free checksum of rows: the sum of their hashes."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def compact(files: DataFrame, name: str, body: str, records, path: str, capacity: int = 1 << 20) -> Compacted:
    """Rewrite ``files`` (one row per file, ``name`` unique) into few files of about ``capacity`` stored bytes at most under ``path``.

    1. ``path`` is claimed by a file that only one writer can make; a path that is claimed or committed is an error.
    2. The manifest of names, byte sizes and checksums is frozen in a staged table; what is written later is not seen.
       How far the frozen bodies compress is measured, and bounds the body a bin may hold (never less than ``capacity`` bytes).
    3. Names are packed into bins by first-fit decreasing (:func:`assign_bins`).
    4. ``records(df)`` turns the binned rows (all columns of ``files`` and ``bin``) into rows to be stored, with ``bin`` among
       the columns; each bin is written by one task as one file, ``FILES_PER_FOLDER`` files to a folder.
    5. What was written is read again: rows and checksum must equal those of the staged rows, names and checksums of the manifest
       those of the frozen table.
    6. The commit is one small file written last (:func:`opened` asks for it), so it does not depend on a rename.

    Null bodies have size 0.  An empty table commits an empty folder.  A body above the capacity gets a file of its own.
    """
    spark = files.sparkSession
    _create(spark, f"{path}/_claimed", "")
    frozen = stage(files, "frozen")
    listed = frozen.select(F.col(name).alias("name"), F.coalesce(F.octet_length(F.col(body)), F.lit(0)).cast("bigint").alias("n_bytes"), F.xxhash64(F.col(body)).alias("hash"))
    plain = listed.agg(F.sum("n_bytes")).first()[0] or 0
    packed = folder_bytes(frozen)
    room = max(capacity, int(FILL * capacity * plain / packed)) if packed else capacity
    manifest = assign_bins(listed, "name", "n_bytes", room)
    n_bins = (manifest.agg(F.max("bin")).first()[0] or 0) + 1
    binned = frozen.join(manifest.select(F.col("name").alias(name), "bin"), name)
    rows = stage(records(binned), "rows")
    whole = tuple(frozen.agg(F.count("*"), checksum(F.col(name), F.xxhash64(F.col(body)))).first())
    discard(frozen)
    release(spark)
    columns = [c for c in rows.columns if c != "bin"]
    for chunk in range(-(-n_bins // FILES_PER_FOLDER)):
        first = chunk * FILES_PER_FOLDER
        here = rows if n_bins <= FILES_PER_FOLDER else rows.where(F.col("bin").between(first, first + FILES_PER_FOLDER - 1))
        of = here.repartitionById(min(FILES_PER_FOLDER, n_bins - first), (F.col("bin") - first).cast("int"))
        of.write.option("compression", "zstd").parquet(f"{path}/data/chunk={chunk}")
    manifest.write.parquet(f"{path}/manifest")

    summary = lambda df: tuple(df.agg(F.count("*"), checksum(*[F.col(c) for c in [*columns, "bin"]])).first())
    written = spark.read.schema(rows.schema).parquet(f"{path}/data")
    wanted, got = summary(rows), summary(written)
    if wanted != got:
        raise RuntimeError(f"what was written differs from its source: {got} for {wanted}")
    kept = tuple(spark.read.parquet(f"{path}/manifest").agg(F.count("*"), checksum("name", "hash")).first())
    if kept != whole:
        raise RuntimeError("the manifest does not cover the frozen files, each once")
    _create(spark, f"{path}/_committed", json.dumps({"rows": got[0], "files": kept[0], "bins": n_bins}))
    discard(manifest, rows)
    return opened(spark, path, manifest.schema)


def opened(spark: SparkSession, path: str, schema=None) -> Compacted:
    """A committed folder; one that is not committed is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_committed")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(f"{path} is not committed")
    stream = fs.open(at)
    told = json.loads(bytes(stream.readAllBytes()).decode())
    stream.close()
    reader = spark.read if schema is None else spark.read.schema(schema)
    return Compacted(path, reader.parquet(f"{path}/manifest"), told["rows"])


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; one that is there is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        stream = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            raise FileExistsError(path) from e
        raise
    stream.write(bytearray(text.encode()))
    stream.close()


def json_lines(body: Column) -> Column:
    """The non-blank lines of a body as an array."""
    return F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != "")


def log_records(binned: DataFrame, session: str, file_path: str, kind: str, body: str, file_id: Column) -> DataFrame:
    """The rows to store for session files: ``(bin, session, file_path, kind, line, record_id, body, paths, conflict)``.

    A log becomes a row per line; of the lines that hold the same complete record of a session one is kept, that of the
    least file and line.  ``paths`` names all files that the record stands in, and ``conflict`` says that its lines differ.  A cut
    line is no record: it is kept as it stands, without a record_id.  Other files are one row.
    """
    keep = [F.col("bin"), F.col(session).alias("session_id"), F.col(file_path).alias("file_path"), F.col(kind).alias("kind")]
    logs = binned.where(F.col(kind) == "log").select(*keep, file_id.alias("__file"), F.posexplode(json_lines(F.col(body))).alias("line", "body"))
    record = whole_json_field(F.col("body"), "record_id")
    logs = logs.withColumn("record_id", record)
    whole = logs.where("record_id is not null")
    payload = F.min(F.struct("__file", "line", "bin", "file_path", "kind", "body")).alias("r")
    told = [F.array_sort(F.collect_set("file_path")).alias("paths"), (F.min(F.xxhash64("body")) != F.max(F.xxhash64("body"))).alias("conflict")]
    once = whole.groupBy("session_id", "record_id").agg(payload, *told).select("r.bin", "session_id", "r.file_path", "r.kind", "r.line", "record_id", "r.body", "paths", "conflict")
    alone = [F.array("file_path").alias("paths"), F.lit(False).alias("conflict")]
    cut = logs.where("record_id is null").select("bin", "session_id", "file_path", "kind", "line", "record_id", "body", *alone)
    other = binned.where(~F.col(kind).eqNullSafe("log")).select(*keep, F.lit(0).alias("line"), F.lit(None).cast("string").alias("record_id"), F.col(body).alias("body"))
    return once.unionByName(cut).unionByName(other.select("*", *alone))
