"""Turning deeply nested JSON records into related flat tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.nested import parse_path

NODES = "doc bigint, node string, path string, ordinal int, fields map<string,string>, texts array<string>"


def as_elements(value) -> list:
    """The elements of a list that may be spelled as JSON text, as one object, or as an object with ordinal keys."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return []
        if isinstance(value, str):
            return []
    if isinstance(value, dict):
        if value and all(k.strip().lstrip("-").isdecimal() for k in value):
            return [value[k] for k in sorted(value, key=int)]
        return [value] if value else []
    return value if isinstance(value, list) else []


def parse(text: str | None):
    """The object a text holds in full, else null (cut off, not an object, or nested beyond the parser)."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


#: The field of a list element that is no object.  No name is spelled like it, as names are escaped.
VALUE = "\\"
_SPECIAL = re.compile(r"[\\./]")
_FIRST = frozenset("-0123456789tfnNI[{\"")
_LAST_STEP = re.compile(r"(?:[^\\/]|\\.)*\Z", re.DOTALL)
_AMBIGUOUS = re.compile(r'-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity|[\["{].*', re.DOTALL)


def escaped(name: str) -> str:
    """A name as it stands in fields and paths: a backslash before each backslash, dot and slash."""
    return _SPECIAL.sub(lambda m: "\\" + m[0], name)


def walk(record: dict, lists: frozenset[str]) -> Iterator[tuple[str, str, int, dict[str, str | None], list[str]]]:
    """``(node, path, ordinal, fields, texts)`` of every node: node is its Dewey label, path the names that lead to it.

    Names in ``lists`` hold elements however they are spelled; other lists that hold objects are followed too.  Scalars become
    fields; an object that is no list element becomes dotted fields of its owner, a list of scalars and an empty object JSON
    text.  An element that is no object (null too) is a node with the field :data:`VALUE`.  ``texts`` names the fields that are
    texts but read like other JSON, so that nothing of the record is lost (:func:`restore`).
    """
    todo: list[tuple[str, str, int, object]] = [("1", "", 1, record)]
    while todo:
        label, path, ordinal, obj = todo.pop()
        fields: dict[str, str | None] = {}
        texts: list[str] = []

        def put(name: str, value, fields=fields, texts=texts) -> None:
            if value is None or isinstance(value, str):
                fields[name] = value
                if value and value[0] in _FIRST and _AMBIGUOUS.fullmatch(value):
                    texts.append(name)
            else:
                fields[name] = json.dumps(value, ensure_ascii=False)

        children = 0
        flat = [("", obj)] if isinstance(obj, dict) else []
        if not flat:
            put(VALUE, obj)
        while flat:
            prefix, part = flat.pop()
            for name, value in part.items():
                full = prefix + (escaped(name) if _SPECIAL.search(name) else name)
                elements = as_elements(value) if name in lists else value if isinstance(value, list) and any(isinstance(x, dict) for x in value) else []
                if elements:
                    for element in elements:
                        children += 1
                        todo.append((f"{label}.{children}", f"{path}/{full}", children, element))
                elif isinstance(value, dict) and value:
                    flat.append((full + ".", value))
                else:
                    put(full, value)
        yield label, path, ordinal, fields, texts


def restore(nodes: list[tuple[str, str, int, dict[str, str | None], list[str]]]) -> dict:
    """The record whose nodes these are: the inverse of :func:`walk`, but for the spelling of named lists."""
    made: dict[str, object] = {}
    for label, path, _, fields, texts in sorted(nodes, key=lambda n: [int(k) for k in n[0].split(".")]):
        obj: object = {}
        for name, text in fields.items():
            value = text
            if text is not None and name not in texts and _AMBIGUOUS.fullmatch(text):
                value = json.loads(text)
            if name == VALUE:
                obj = value
                continue
            *outer, last = parse_path(name)
            at = obj
            for n in outer:
                at = at.setdefault(n, {})
            at[last] = value
        made[label] = obj
        if label != "1":
            owner = made[label.rpartition(".")[0]]
            *outer, last = parse_path(_LAST_STEP.search(path)[0])
            for n in outer:
                owner = owner.setdefault(n, {})
            owner.setdefault(last, []).append(obj)
    return made["1"]


def shred(df: DataFrame, id_col: str, json_col: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """``(doc, node, path, ordinal, fields, texts)``: one row per object, and per other element of a list of objects, of each JSON record.

    ``node`` is a Dewey label: the ordinals on the way from the record (``1``) to the object (``1.2.1``).  The parent of a
    node is its label without the last ordinal (:func:`parent`), so no ids need to be handed out across tasks.
    ``path`` groups nodes into tables (:func:`table`).  Names with dots, slashes or backslashes are escaped by a backslash.
    Nothing of a record is lost; see :func:`walk`.  A null, cut off or non-object record gives no rows.  Empty input and other
    columns are fine; a repeated record gives its rows again.
    """
    names = frozenset(lists)
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string())]
    schema = pa.schema(list(zip(["doc", "node", "path", "ordinal", "fields", "texts"], types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = parse(text)
                if record is not None:
                    rows += [(doc, node, path, ordinal, list(fields.items()), texts) for node, path, ordinal, fields, texts in walk(record, names)]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    return df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(json_col).alias("json")).mapInArrow(run, NODES)


def parent(node: Column) -> Column:
    """The Dewey label of the parent; null for a record's own node."""
    return F.when(F.instr(node, ".") > 0, F.regexp_replace(node, r"\.[^.]*$", ""))


def table(nodes: DataFrame, path: str, columns: dict[str, str | list[str]]) -> DataFrame:
    """The flat table of one path: ``(doc, node, parent, ordinal, *columns)``, a row per object.

    A column is read from the field of that name, or from the first non-null of several (an older name beside a newer).
    """

    def field(names: str | list[str]) -> Column:
        names = [names] if isinstance(names, str) else names
        return F.coalesce(*[F.col("fields")[n] for n in names])

    objects = nodes.where((F.col("path") == path) & ~F.map_contains_key("fields", VALUE))
    return objects.select("doc", "node", parent(F.col("node")).alias("parent"), "ordinal", *[field(f).alias(c) for c, f in columns.items()])


def to_integer(text: Column) -> Column:
    """An integer however it is spelled (``3``, ``"3"``, ``3.0``), else null."""
    number = F.trim(text).try_cast("double")
    return F.when(number == F.floor(number), number.cast("bigint"))
