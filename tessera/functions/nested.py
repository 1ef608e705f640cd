"""Maps, structs and JSON by dotted paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_path(path: str, sep: str = ".", escape: str = "\\") -> list[str]:
    """The names of a path; an escaped separator belongs to a name."""
    out, name, at = [], "", 0
    while at < len(path):
        if path[at] == escape and at + 1 < len(path):
            name += path[at + 1]
            at += 2
            continue
        if path[at] == sep:
            out.append(name)
            name = ""
        else:
            name += path[at]
        at += 1
    return [*out, name]


def _type_at(schema: T.DataType, names: list[str]) -> T.DataType | None:
    for name in names:
        if isinstance(schema, T.ArrayType):
            schema = schema.elementType
        if isinstance(schema, T.MapType):
            schema = schema.valueType
        elif isinstance(schema, T.StructType) and name in schema.names:
            schema = schema[name].dataType
        else:
            return None
    return schema


def _column(names: list[str]) -> Column:
    return F.col(".".join(f"`{n}`" for n in names))


def has_path(df: DataFrame, path: str) -> bool:
    """The schema has the path (whatever its values)."""
    return _type_at(df.schema, parse_path(path)) is not None


def get_at(df: DataFrame, path: str, default: Column | None = None) -> Column:
    """The value at a path, fanning out over arrays; the default where the schema lacks the path."""
    names = parse_path(path)
    if _type_at(df.schema, names) is None:
        return F.lit(None) if default is None else default
    value, kind = _column(names[:1]), df.schema[names[0]].dataType
    for name in names[1:]:
        value, kind = _step(value, kind, name)
    return value


def _step(value: Column, kind: T.DataType, name: str) -> tuple[Column, T.DataType]:
    if isinstance(kind, T.ArrayType):
        inner = _type_at(kind.elementType, [name])
        if isinstance(kind.elementType, T.ArrayType):
            return F.transform(value, lambda v: _step(v, kind.elementType, name)[0]), T.ArrayType(inner)
        out = F.transform(value, lambda v: _step(v, kind.elementType, name)[0])
        return (F.flatten(out), inner) if isinstance(inner, T.ArrayType) else (out, T.ArrayType(inner))
    if isinstance(kind, T.MapType):
        return F.try_element_at(value, F.lit(name)), kind.valueType
    return value.getField(name), kind[name].dataType


def set_at(df: DataFrame, path: str, value: Column, create: bool = True) -> DataFrame:
    """``df`` with a nested value set; missing parents are made as structs if ``create``."""
    names = parse_path(path)
    if not create and _type_at(df.schema, names[:-1] or names) is None:
        raise KeyError(path)
    if len(names) == 1:
        return df.withColumn(names[0], value)
    root = names[0]
    if root not in df.columns:
        for name in reversed(names[1:]):
            value = F.struct(value.alias(name))
        return df.withColumn(root, value)
    known = 1
    while known < len(names) - 1 and _type_at(df.schema, names[: known + 1]) is not None:
        known += 1
    for name in reversed(names[known + 1 :]):
        value = F.struct(value.alias(name))
    return df.withColumn(root, F.col(f"`{root}`").withField(".".join(f"`{n}`" for n in names[1 : known + 1]), value))


def delete_at(df: DataFrame, path: str) -> DataFrame:
    names = parse_path(path)
    if _type_at(df.schema, names) is None:
        return df
    if len(names) == 1:
        return df.drop(names[0])
    return df.withColumn(names[0], F.col(f"`{names[0]}`").dropFields(".".join(f"`{n}`" for n in names[1:])))


def pop_at(df: DataFrame, path: str, out: str) -> DataFrame:
    """``df`` with the value moved from the path to a column."""
    return delete_at(df.withColumn(out, get_at(df, path)), path)


def transform_at(df: DataFrame, path: str, f: Callable[[Column], Column]) -> DataFrame:
    return set_at(df, path, f(get_at(df, path)), create=False)


def resolve_fuzzy(schema: T.StructType, key: str, sep: str = "_") -> list[str] | None:
    """The path whose names joined by ``sep`` are the key, longer names first."""
    parts = key.split(sep)
    for n in range(len(parts), 0, -1):
        head = sep.join(parts[:n])
        if head in schema.names:
            if n == len(parts):
                return [head]
            kind = schema[head].dataType
            if isinstance(kind, T.StructType) and (rest := resolve_fuzzy(kind, sep.join(parts[n:]), sep)):
                return [head, *rest]
    return None


def leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The paths of all values that are no structs."""
    out = []
    for f in schema:
        path = (*prefix, f.name)
        out += leaves(f.dataType, path) if isinstance(f.dataType, T.StructType) else [path]
    return out


def flattened(df: DataFrame, sep: str = ".") -> DataFrame:
    """One column per leaf."""
    return df.select(*[_column(list(p)).alias(sep.join(p)) for p in leaves(df.schema)])


def unpivoted_leaves(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, path, value)``: a row per leaf, values as text."""
    cells = [F.struct(F.lit(".".join(p)).alias("path"), _column(list(p)).cast("string").alias("value")) for p in leaves(df.schema) if p[0] not in keys]
    return df.select(*keys, F.inline(F.array(*cells)))


# ---- maps


def rename_keys(m: Column, prefix: str = "", suffix: str = "", sep: str = "_", once: bool = False) -> Column:
    def new(k: Column, _: Column) -> Column:
        if prefix:
            full = F.concat(F.lit(prefix + sep), k)
            k = F.when(k.startswith(prefix + sep), k).otherwise(full) if once else full
        if suffix:
            full = F.concat(k, F.lit(sep + suffix))
            k = F.when(k.endswith(sep + suffix), k).otherwise(full) if once else full
        return k

    return F.transform_keys(m, new)


def keys_with_prefix(m: Column, prefix: str, strip: bool = True) -> Column:
    kept = F.map_filter(m, lambda k, _: k.startswith(prefix))
    return F.transform_keys(kept, lambda k, _: F.substring(k, len(prefix) + 1, 2**31 - 1)) if strip else kept


def sub_map(m: Column, keys: list[str], excluded: list[str] = ()) -> Column:
    wanted = [k for k in keys if k not in set(excluded)]
    return F.map_filter(m, lambda k, _: k.isin(wanted))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def merged(*maps: Column) -> Column:
    """Later maps win; null maps count as empty (needs ``LAST_WIN``, which :mod:`tessera.session` sets)."""
    return F.map_concat(*[F.coalesce(m, F.create_map().cast("map<string,string>")) for m in maps])


def swapped(m: Column) -> Column:
    """Values to keys; of equal values the later key wins."""
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def has_single_key(m: Column, key: str | None = None) -> Column:
    one = F.size(F.map_keys(m)) == 1
    return one & (F.element_at(F.map_keys(m), 1) == key) if key is not None else one


def first_of(*columns: Column) -> Column:
    """The first that is not null."""
    return F.coalesce(*columns)


# ---- open JSON


_END = "\\u0001 end"


def whole_json(text: Column) -> Column:
    """The text's value as a variant, null unless the whole text is one JSON value: ``try_parse_json`` by itself reads the first value
    and takes no notice of what follows it."""
    # with a last element of our own, only a single value before it gives a list of these two
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))), "$", "array<variant>")
    last = F.try_variant_get(F.try_element_at(pair, F.lit(2)), "$", "string")
    return F.when((F.size(pair) == 2) & (last == "\u0001 end"), F.try_element_at(pair, F.lit(1)))


def whole_json_field(text: Column, name: str) -> Column:
    """A field of the object that the whole text is, as text; null where the text is no object, goes on after it or lacks the field.
    One pass that reads the field alone, cheaper than :func:`whole_json`."""
    kind = T.ArrayType(T.StructType([T.StructField(name, T.StringType())]))
    pair = F.from_json(F.concat(F.lit("["), text, F.lit(f',{{"{name}":"{_END}"}}]')), kind)
    return F.when((F.size(pair) == 2) & (F.try_element_at(pair, F.lit(2))[name] == "\u0001 end"), F.try_element_at(pair, F.lit(1))[name])


def json_at(doc: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where it is missing or the text is no JSON."""
    if "'" in path:  # which a path expression cannot spell
        value = F.try_parse_json(doc)
        for name in parse_path(path):
            inside = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))
            value = F.coalesce(inside, F.try_element_at(F.try_variant_get(value, "$", "array<variant>"), F.lit(int(name) + 1))) if name.isdecimal() else inside
        return F.coalesce(F.try_variant_get(value, "$", "string"), F.when(~F.is_variant_null(value), F.to_json(value)))
    return F.get_json_object(doc, "$" + "".join(f"['{n}']" if not n.isdecimal() else f"[{n}]" for n in parse_path(path)))


def json_matches(doc: Column, filters: dict[str, object]) -> Column:
    """Metadata filter: every key is there and equals the value; a list asks for a list that holds all its values.

    Numbers equal numbers, and a text never equals a number; no filters pass everything; a missing key or no JSON fails.
    """
    test = F.lit(True)
    value = F.try_parse_json(doc)
    for key, wanted in filters.items():
        # by a map, as a path expression cannot spell every key
        at_key = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(key))
        if isinstance(wanted, (list, tuple, set)):
            held = F.try_variant_get(at_key, "$", "array<variant>")
            one = F.lit(True)
            for w in wanted:
                one = one & F.exists(held, _equals(w))
            test = test & F.coalesce(held.isNotNull() & one, F.lit(False))
        else:
            test = test & F.coalesce(_variant_equals(at_key, wanted), F.lit(False))
    return test


def _equals(wanted: object) -> Callable[[Column], Column]:
    return lambda v: _variant_equals(v, wanted)


def _variant_equals(v: Column, wanted: object) -> Column:
    kind = F.schema_of_variant(v)
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == wanted)
    if isinstance(wanted, int) and not isinstance(wanted, bool):
        # whole numbers as such: a double holds them up to 2**53 only
        exact = F.try_variant_get(v, "$", "decimal(38,9)")
        return (kind != "STRING") & F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int") == wanted).otherwise(exact == F.lit(wanted).cast("decimal(38,9)"))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
    return (kind != "STRING") & (number == float(wanted))


def to_value(text: Column) -> Column:
    """``struct<as_long, as_double, as_boolean, as_text>``: what a text may stand for."""
    low = F.lower(F.trim(text))
    truth = F.when(low.isin("true", "yes", "y", "t", "1", "on"), True).when(low.isin("false", "no", "n", "f", "0", "off"), False)
    return F.struct(F.trim(text).try_cast("bigint").alias("as_long"), F.trim(text).try_cast("double").alias("as_double"), truth.alias("as_boolean"), text.alias("as_text"))
