"""Templates with variables, conditions and loops, as rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import small

# The marks of variables, conditions and loops.
_MARK = re.compile(r"\{\{(?:(?P<open>#if|#each)\s+(?P<of>\w+)|(?P<close>/if|/each)|(?P<name>\w+)|item\.(?P<field>[^{}]+))\}\}")


@dataclass
class _Mark:
    """A mark as it stands: a variable (name) or a field of a loop's item (field)."""

    text: str
    name: str = ""
    field: str = ""


@dataclass
class _Block:
    """A condition or a loop over what stands up to its end."""

    kind: str
    of: str
    parts: list


class MissingVariables(ValueError):
    """Variables a strict template needs and doesn't get."""


def _parsed(template: str) -> list:
    """The template as plain texts, marks and blocks. A block ends at the next end of its kind; an opening without end, or an end without opening, is plain text."""
    flat: list = []
    at = 0
    for m in _MARK.finditer(template):
        flat += [template[at : m.start()], m]
        at = m.end()
    flat.append(template[at:])

    def read(i: int, stop: int) -> list:
        out = []
        while i < stop:
            x = flat[i]
            if isinstance(x, str):
                out.append(x)
            elif x["open"]:
                kind = x["open"][1:]
                end = next((j for j in range(i + 1, stop) if not isinstance(flat[j], str) and flat[j]["close"] == f"/{kind}"), None)
                out.append(x[0] if end is None else _Block(kind, x["of"], read(i + 1, end)))
                i = i if end is None else end
            else:
                out.append(x[0] if x["close"] else _Mark(x[0], x["name"] or "", x["field"] or ""))
            i += 1
        return out

    return read(0, len(flat))


def _trimmed(parts: list) -> list:
    """Parts without white space at either end; marks and loops end the trimming."""
    out = list(parts)
    for side, strip in ((0, str.lstrip), (-1, str.rstrip)):
        while out and isinstance(out[side], str):
            out[side] = strip(out[side])
            if out[side]:
                break
            out.pop(side)
    return out


def _chosen(parts: list, values: dict) -> list:
    """Parts with their conditions decided."""
    out = []
    for x in parts:
        if not isinstance(x, _Block):
            out.append(x)
        elif x.kind == "each":
            out.append(_Block("each", x.of, _chosen(x.parts, values)))
        elif values.get(x.of):
            out += _trimmed(_chosen(x.parts, values))
    return out


def _filled(mark: _Mark, item: object, number: int) -> str | _Mark:
    """A mark inside of a loop: what the item says to it, else the mark."""
    if mark.field:
        return str(item[mark.field]) if isinstance(item, dict) and mark.field in item else mark
    if mark.name == "index":
        return str(number)
    return str(item) if mark.name == "item" and not isinstance(item, dict) else mark


def _unrolled(parts: list, values: dict) -> list:
    """Parts with their loops written out, one trimmed line group per item."""
    out = []
    for x in parts:
        if not isinstance(x, _Block):
            out.append(x)
            continue
        items = values.get(x.of, [])
        for i, item in enumerate(items if isinstance(items, list | tuple) else []):
            body = [_filled(y, item, i) if isinstance(y, _Mark) else y for y in _unrolled(x.parts, values)]
            out += (["\n"] if i else []) + _trimmed(body)
    return out


def render(template: str, values: dict, strict: bool = True, defaults: dict | None = None) -> str:
    """A template with its values.

    Conditions are decided first (by truth of the value), then loops are written
    out, then variables filled in. A strict template must get every variable, whatever its
    defaults; a lenient one takes defaults and leaves the rest as it stands. Values
    are never read as templates. Blank lines are collapsed. Where blocks cross, the outer opening is read first.
    """
    parts = _unrolled(_chosen(_parsed(template), values), values)
    known = values if strict else {k: v for k, v in (defaults or {}).items() if v is not None} | values
    missing = list(dict.fromkeys(x.name for x in parts if isinstance(x, _Mark) and x.name and x.name not in known))
    if strict and missing:
        raise MissingVariables(", ".join(missing))
    text = "".join(x if isinstance(x, str) else str(known[x.name]) if x.name in known else x.text for x in parts)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def rendered(rows: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Rows (key, template, values as JSON) rendered: key, text, error. A row that fails has its error instead of a text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, v in zip(b[key], b["template"], b["values"]):
                try:
                    out.append((k, render(t, json.loads(v) if v else {}, strict), None))
                except (ValueError, TypeError, AttributeError) as e:
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "text", "error"])

    return rows.select(key, "template", "values").mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string, error string")


def variables(template: Column) -> Column:
    """Distinct names used by a template, sorted: variables, conditions and loops."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{(?:#(?:if|each)\s+)?(\w+)\}\}"), F.lit(1))))


def template_hash(name: Column, version: Column, template: Column) -> Column:
    """12 hex digits over name, version and text."""
    return F.substring(F.sha2(F.concat_ws(":", name, version.cast("string"), template), 256), 1, 12)


def history(registrations: DataFrame) -> DataFrame:
    """Registrations (name, seq, template) with their place: back 0 is current. A name's versions are ranked within it, by their hashes; the texts don't move."""
    w = Window.partitionBy("name").orderBy(F.col("seq").desc())
    hashed = registrations.select("name", "seq", template_hash(F.col("name"), F.col("seq"), F.col("template")).alias("hash"))
    return hashed.select("name", "seq", (F.row_number().over(w) - 1).alias("back"), "hash")


def current(registrations: DataFrame) -> DataFrame:
    """The current registration of each name; combined map-side."""
    return registrations.groupBy("name").agg(F.max_by("template", "seq").alias("template"), F.max("seq").alias("seq"))


def by_tag(templates: DataFrame, tag: str) -> DataFrame:
    """Names of the templates (name, version, tags) that have a tag in their current version."""
    current_tags = templates.groupBy("name").agg(F.max_by("tags", "version").alias("tags"))
    return current_tags.where(F.array_contains("tags", tag)).select("name")


def version_of(templates: DataFrame, name: str, version: int | None = None) -> DataFrame:
    """The row of a template in a version, the newest without one; no row if there is none."""
    rows = templates.where(F.col("name") == name)
    return rows.where(F.col("version") == version) if version is not None else rows.orderBy(F.col("version").desc()).limit(1)


def completed(defaults: Column, given: Column) -> Column:
    """Variables with their defaults: a map of both in which what is given wins."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False))), F.coalesce(given, F.create_map().cast("map<string,string>")))


def filled(rows: DataFrame, dimensions: DataFrame, on: str) -> DataFrame:
    """Rows (key, on, values as map) with the template of their kind: key, text, error.

    dimensions (on, template) is the caller's, small; "{field}" in a template stands for a
    value. A row whose template lacks a value fails with the names of all that are
    missing; one without template fails, too.
    """
    known = rows.join(small(dimensions.select(on, "template")), on, "left")
    fields = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1)))
    lacking = F.filter(fields, lambda f: F.element_at("values", f).isNull())
    text = F.aggregate(fields, F.col("template"), lambda t, f: F.replace(t, F.concat(F.lit("{"), f, F.lit("}")), F.coalesce(F.element_at("values", f), F.lit(""))))
    error = F.when(F.col("template").isNull(), "no template").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(lacking), ", ")))
    return known.select("key", F.when(error.isNull(), text).alias("text"), error.alias("error"))
