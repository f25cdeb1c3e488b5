"""Nested records as related flat tables.

Each array level becomes a child table whose rows carry the surrogate key of
their parent row (_parent), their own (_key) and their position (_pos). Typed
columns are walked by their schema; JSON texts are parsed into variants whose
merged schema over all rows decides which paths are array levels.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.parsing import strict_json


def _surrogate(parent: Column, path: str, *ordinals: Column) -> Column:
    return F.sha2(F.concat_ws("/", parent.cast("string"), F.lit(path), *[o.cast("string") for o in ordinals]), 256)


def _scalars(kind: T.StructType, at: str, taken: tuple[str, ...] = ()) -> tuple[list[Column], list[tuple[str, T.DataType]]]:
    """Leaf columns of a struct with dotted paths as names, and its array fields."""
    leaves: list[Column] = []
    arrays: list[tuple[str, T.DataType]] = []
    for f in kind.fields:
        path = f"{at}.`{f.name}`" if at else f"`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            inner = _scalars(f.dataType, path)
            leaves += inner[0]
            arrays += inner[1]
        elif isinstance(f.dataType, T.ArrayType):
            arrays.append((path, f.dataType))
        else:
            leaves.append(F.col(path).alias(path.replace("`", "")))
    return leaves, arrays


def flatten_typed(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """Flat tables of a DataFrame with structs and arrays, by path; the root is "".

    The root has the key, _key (a surrogate; equal keys give equal ones) and all
    leaf columns under dotted names. A child has the root's key, _parent, _key,
    _at (the positions from the root down, its own last) and its leaf columns, or
    "value" for arrays of leaves. Null and empty arrays give no rows; null
    elements keep their position as a row of nulls.
    """
    tables: dict[str, DataFrame] = {}
    leaves, arrays = _scalars(df.schema, "")
    root = _surrogate(F.col(f"`{key}`"), "")
    tables[""] = df.select(root.alias("_key"), *leaves)
    none = F.array().cast("array<int>").alias("_at")
    todo = [(df.select(F.col(f"`{key}`").alias("_root"), root.alias("_parent"), none, F.col(path).alias("_array")), path.replace("`", ""), kind) for path, kind in arrays]
    while todo:
        rows, name, kind = todo.pop(0)
        items = _placed(rows.select("_root", "_parent", "_at", F.posexplode("_array").alias("_pos", "value")), "_root", name)
        fixed = [F.col("_root").alias(key), "_parent", "_key", "_at"]
        below = [F.col("_root"), F.col("_key").alias("_parent"), F.col("_at")]
        element = kind.elementType
        if isinstance(element, T.StructType):
            leaves, arrays = _scalars(element, "value")
            tables[name] = items.select(*fixed, *[c.alias(n) for c, n in zip(leaves, _names(element))])
            todo += [(items.select(*below, F.col(p).alias("_array")), f"{name}.{p.replace('`', '').removeprefix('value.')}", k) for p, k in arrays]
        elif isinstance(element, T.ArrayType):
            tables[name] = items.select(*fixed)
            todo.append((items.select(*below, F.col("value").alias("_array")), f"{name}[]", element))
        else:
            tables[name] = items.select(*fixed, "value")
    return tables


def _placed(items: DataFrame, key: str, name: str) -> DataFrame:
    """Exploded elements with their surrogate and the positions down to them."""
    at = F.concat("_at", F.array("_pos"))
    return items.select(key, "_parent", _surrogate(F.col("_parent"), name, F.col("_pos")).alias("_key"), at.alias("_at"), "value")


def _names(kind: T.StructType, at: str = "") -> list[str]:
    out: list[str] = []
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            out += _names(f.dataType, f"{at}{f.name}.")
        elif not isinstance(f.dataType, T.ArrayType):
            out.append(at + f.name)
    return out


def json_variant(text: Column) -> Column:
    """The JSON value in a text as a variant; null where there is none or it is cut off.

    Strips a byte order mark, takes the part from the first bracket that starts a
    line (else the first at all) to the last closing one of its kind, so words
    and code fences around it don't matter, and unpacks JSON inside a JSON string.
    """
    def once(t: Column) -> Column:
        bare = F.regexp_replace(t, r"^[\s\uFEFF]+|[\s\uFEFF]+$", "")
        lined = F.regexp_extract(bare, r"(?ms)^[ \t]*([\[{].*)\z", 1)
        start = F.when(lined != "", lined).otherwise(F.regexp_extract(bare, r"(?s)([\[{].*)\z", 1))
        upto = F.when(F.startswith(start, F.lit("{")), F.regexp_extract(start, r"(?s)\A(.*\})", 1)).otherwise(F.regexp_extract(start, r"(?s)\A(.*\])", 1))
        return F.coalesce(strict_json(bare), F.when(upto != "", strict_json(upto)))

    first = once(text)
    inner = F.when(F.schema_of_variant(first) == "STRING", F.try_variant_get(first, "$", "string"))
    return F.when(inner.isNotNull(), once(inner)).otherwise(first)


def as_list(v: Column) -> Column:
    """A variant's elements as array<variant>: a list's own, else a list of one; null and JSON null give null."""
    return F.when(v.isNull() | F.is_variant_null(v), None).otherwise(
        F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    )


def merged_schema(df: DataFrame, column: str) -> str:
    """The merged schema of a variant column over all rows, in the engine's notation; an aggregate with one row."""
    return df.agg(F.schema_of_variant_agg(F.col(column)).alias("s")).first()["s"] or "VOID"


def parse_schema(text: str) -> object:
    """merged_schema's notation as a tree: {"name": child} for objects, [child] for arrays, else the type's name."""
    at = 0

    def name() -> str:
        nonlocal at
        if text[at] == "`":
            end = at + 1
            while text[end] != "`" or text[end + 1 : end + 2] == "`":
                end += 2 if text[end] == "`" else 1
            out, at = text[at + 1 : end].replace("``", "`"), end + 1
            return out
        m = re.compile(r"[^:<>,]+").match(text, at)
        at = m.end()
        return m.group().strip()

    def node() -> object:
        nonlocal at
        m = re.compile(r"[A-Z_ ]+(\(\d+,\s*\d+\))?").match(text, at)
        kind, at = m.group().strip(), m.end()
        if kind == "ARRAY":
            at += 1
            child = node()
            at += 1
            return [child]
        if kind == "OBJECT":
            at += 1
            out = {}
            while text[at] != ">":
                while text[at] in ", ":
                    at += 1
                n = name()
                while text[at] in ": ":
                    at += 1
                out[n] = node()
            at += 1
            return out
        return kind

    return node()


def _field(base: tuple[Column, str], name: str) -> tuple[Column, str]:
    """The field called name below a base (variant, path in it); names that no path can hold are looked up in a map."""
    value, path = base
    quote = next((q for q in "\"'" if q not in name), None)
    if name and quote and "?" not in name:
        return value, f"{path}[{quote}{name}{quote}]"
    here = F.try_variant_get(value, path, "variant")
    return F.element_at(F.try_variant_get(here, "$", "map<string,variant>"), name), "$"


def flatten_variant(df: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """Child tables of a variant column, one per array level of its merged schema, by path.

    Rows: the key, _parent, _key, _at (positions from the root down), value
    (variant). The column itself is the first level "": a lone value counts as a
    list of one, there and wherever a path holds lists in some rows and single
    values in others. JSON null gives no list; null elements keep their position.
    Paths join the names of the fields by dots, whatever characters they hold; of two
    paths that read the same the later one gets a mark of its number behind "#".
    """
    tables: dict[str, DataFrame] = {}
    none = F.array().cast("array<int>").alias("_at")
    rows = df.select(F.col(key), _surrogate(F.col(key), "").alias("_parent"), none, F.col(column).alias("_v"))
    first = rows.select(key, "_parent", "_at", F.posexplode(as_list(F.col("_v"))).alias("_pos", "value"))
    tables[""] = _placed(first, key, "")
    todo: list[tuple[str, object]] = [("", "VARIANT")]
    while todo:
        name, kind = todo.pop(0)
        if kind == "VARIANT":  # elements of several kinds: the fields are those of the objects among them
            objects = tables[name].where(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")))
            kind = parse_schema(merged_schema(objects, "value"))
        paths: list[tuple[tuple[Column, str], str, object]] = [((F.col("value"), "$"), name, kind)]
        top = True
        while paths:
            at, label, k = paths.pop(0)
            if isinstance(k, dict):
                paths += [(_field(at, n), f"{label}.{n}".lstrip(".") if n else f"{label}.", c) for n, c in k.items()]
            elif not top and (isinstance(k, list) or k == "VARIANT"):
                below = [F.col(key), F.col("_key").alias("_parent"), F.col("_at")]
                child = tables[name].select(*below, F.posexplode(as_list(F.try_variant_get(at[0], at[1], "variant"))).alias("_pos", "value"))
                if label in tables:
                    label = f"{label}#{len(tables)}"
                tables[label] = _placed(child, key, label)
                todo.append((label, k[0] if isinstance(k, list) else "VARIANT"))
            top = False
    return tables


def filled(v: Column) -> Column:
    """Whether a variant is neither null nor blank text."""
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return v.isNotNull() & ~F.is_variant_null(v) & (text.isNull() | F.regexp_like(text, F.lit(r"(?U)\S")))
