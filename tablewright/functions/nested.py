"""Nested data: JSON text to typed columns, nested columns to flat tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import col, spare_names

#: how the engine names the types of JSON values; values of several kinds become text, as does what is always null
KINDS = {"OBJECT": "STRUCT", "VARIANT": "STRING", "VOID": "STRING"}  # fixed values: type names


def _types(text: str) -> T.DataType:
    """A type from the engine's description of JSON values, such as ``OBJECT<a: ARRAY<BIGINT>, b: STRING>``."""
    at = 0

    def skip(what: str) -> None:
        nonlocal at
        if not text.startswith(what, at):
            raise ValueError(f"{what!r} expected at {at} of {text!r}")
        at += len(what)

    def name() -> str:
        nonlocal at
        if text[at] != "`":
            begin = at
            while text[at] not in ":":
                at += 1
            return text[begin:at]
        at, out = at + 1, []
        while text[at] != "`" or text[at + 1:at + 2] == "`":
            out.append(text[at])
            at += 2 if text[at] == "`" else 1
        at += 1
        return "".join(out)

    def kind() -> T.DataType:
        nonlocal at
        begin = at
        while at < len(text) and (text[at].isalnum() or text[at] in "_"):
            at += 1
        word = text[begin:at]
        if word == "ARRAY":
            skip("<")
            inner = kind()
            skip(">")
            return T.ArrayType(inner)
        if word == "OBJECT":
            fields = []
            skip("<")
            while text[at] != ">":
                field = name()
                skip(": ")
                fields.append(T.StructField(field, kind()))
                if text[at] == ",":
                    skip(", ")
            skip(">")
            return T.StructType(fields)
        if word == "DECIMAL":
            end = text.index(")", at) + 1
            word, at = text[begin:end], end
        return T._parse_datatype_string(KINDS.get(word, word).lower())
    found = kind()
    if at != len(text):
        raise ValueError(f"not understood from {at}: {text!r}")
    return found


def json_type(df: DataFrame, column: str) -> T.DataType:
    """The type that all JSON texts of a column fit, merged from the types of the parts in one aggregate.

    Whole numbers and decimals meet in the wider kind, objects in one with the fields of all, lists in the kind of all
    their elements; whatever does not fit together becomes text. Texts that are no JSON do not count.
    """
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(col(column))).alias("found")).first()["found"]
    return _types(found or "VOID")


def parsed_json(df: DataFrame, column: str, into: str | None = None, dtype: T.DataType | None = None) -> DataFrame:
    """The column's JSON texts as values of ``dtype``, by default the one that fits them all (``json_type``).

    Null texts and texts that are no JSON are null. Values of several kinds keep their JSON text.
    """
    dtype = dtype or json_type(df, column)
    wrapped = T.StructType([T.StructField("v", dtype)])
    known = F.when(F.try_parse_json(col(column)).isNotNull(), F.concat(F.lit('{"v":'), col(column), F.lit("}")))
    return df.withColumn(into or column, F.from_json(known, wrapped)["v"])


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs, at any depth, as columns of their own, named by their path; lists and maps stay."""
    shown: list[tuple[str, Column]] = []

    def add(name: str, value: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType) and kind.fields:
            for f in kind.fields:
                add(f"{name}{separator}{f.name}", value.getField(f.name), f.dataType)
        else:
            shown.append((name, value))
    for f in df.schema.fields:
        add(f.name, col(f.name), f.dataType)
    names = [n for n, _ in shown]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"columns {sorted(twice)} would come twice; use another separator")
    return df.select(*[value.alias(n) for n, value in shown])


def unnested(df: DataFrame, column: str, position: str = "position", value: str | None = None, key: str = "key") -> DataFrame:
    """A row for each element of a list, with its place from 0, or for each entry of a map, with its key.

    Null and empty lists keep one row, with a null place and value, so that ``nested`` can tell rows without elements.
    """
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.ArrayType, T.MapType)):
        raise TypeError(f"column {column!r} is no list or map")
    rest = [col(c) for c in df.columns if c != column]
    if isinstance(kind, T.ArrayType):
        return df.select(*rest, F.posexplode_outer(col(column)).alias(position, value or column))
    entries, = spare_names(df, "entry")
    listed = df.withColumn(entries, F.explode_outer(F.array_sort(F.map_entries(col(column))) if _sortable(kind.keyType) else F.map_entries(col(column))))
    return listed.select(*rest, F.col(entries)["key"].alias(key), F.col(entries)["value"].alias(value or column))


def _sortable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def nested(df: DataFrame, by, column: str, position: str = "position") -> DataFrame:
    """The rows of each group as one list of ``column``, in the order of ``position``: the reverse of ``unnested``.

    Rows without a place hold no element; a group of only such rows has an empty list. A list is as long as its group.
    """
    keys = [by] if isinstance(by, str) else list(by)
    element = F.when(col(position).isNotNull(), F.struct(col(position).alias("at"), col(column).alias("v")))
    # only places are compared, so elements of any kind will do; elements of one place keep no order of their own
    order = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    found = df.groupBy(*[col(k) for k in keys]).agg(F.collect_list(element).alias(column))
    return found.withColumn(column, F.transform(F.array_sort(col(column), order), lambda x: x["v"]))
