"""Structured parts of model output: JSON, Markdown sections, lists, key-value lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fenced(text: Column) -> Column:
    """Content of the first fenced block, of one marked json first, if it starts like JSON; else null."""
    def block(pattern: str) -> Column:
        body = F.regexp_extract(text, pattern, 1)
        return F.when(body.rlike(r"^[{\[]"), body)

    return F.coalesce(block(r"```json\s*([\s\S]*?)\s*```"), block(r"```\s*([\s\S]*?)\s*```"))


def strict_json(text: Column) -> Column:
    """A text that is one JSON value as a variant; null for anything else, also for a value with more behind it."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1, F.try_variant_get(listed, "$[0]", "variant"))


def extracted_json(text: Column) -> Column:
    """JSON text inside a text: fenced, else the widest object, else the widest array, that parses; else null."""
    def valid(pattern: str) -> Column:
        body = F.regexp_extract(text, pattern, 1)
        return F.when((body != "") & strict_json(body).isNotNull(), body)

    return F.coalesce(fenced(text), valid(r"(\{[\s\S]*\})"), valid(r"(\[[\s\S]*\])"))


def parsed_json(text: Column) -> Column:
    """The whole text as JSON, else the JSON inside it, as a variant; null where neither parses (lenient)."""
    return F.coalesce(strict_json(F.trim(text)), strict_json(extracted_json(text)))


def parsed_list(text: Column, required: str | None = None) -> Column:
    """JSON of a text as array<variant>, leniently: a single value is a list of one, nothing readable an empty list.

    With required, only the items stay that are objects with that field.
    """
    v = parsed_json(text)
    listed = F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    rows = F.when(v.isNull(), F.array().cast("array<variant>")).otherwise(listed)
    return rows if required is None else F.filter(rows, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")) & F.try_variant_get(x, f"$.{required}", "string").isNotNull())


def lenient_section(text: Column) -> Column:
    """A section out of a model's answer: struct<parsed, title, content>.

    A fence around the answer is taken off; then the whole counts as JSON, else the
    widest object in it. What is no JSON becomes the content of a section "Section".
    """
    bare = _trimmed(text)
    lines = F.split(bare, "\n")
    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - F.when(F.element_at(lines, -1) == "```", 2).otherwise(1), F.lit(0)))
    body = _trimmed(F.when(F.startswith(bare, F.lit("```")), F.array_join(inner, "\n")).otherwise(bare))
    v = F.coalesce(strict_json(body), strict_json(F.nullif(F.regexp_extract(body, r"\{[\s\S]*\}", 0), F.lit(""))))
    of = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    return F.struct(v.isNotNull().alias("parsed"), F.when(v.isNull(), "Section").otherwise(of("title")).alias("title"), F.when(v.isNull(), body).otherwise(of("content")).alias("content"))


def _items(text: Column, pattern: str) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(found, lambda x: x != "")


def bullet_points(text: Column) -> Column:
    """Items of lines that start with -, * or a bullet."""
    return _items(text, r"(?m)^\s*[-*•]\s*(.+)$")


def numbered_items(text: Column) -> Column:
    """Items of lines that start with a number and . or )."""
    return _items(text, r"(?m)^\s*\d+[.)]\s*(.+)$")


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _pair(line: Column) -> Column:
    bold, colon, equals = r"^\*\*([^*]+)\*\*:\s*(.+)$", r"^([^:=]+):\s*(.+)$", r"^([^:=]+)=\s*(.+)$"
    def of(pattern: str) -> Column:
        key, value = _trimmed(F.regexp_extract(line, pattern, 1)), _trimmed(F.regexp_extract(line, pattern, 2))
        return F.struct(F.replace(F.lower(key), F.lit(" "), F.lit("_")).alias("key"), value.alias("value"))

    return F.when(line.rlike(bold), of(bold)).when(line.rlike(colon), of(colon)).when(line.rlike(equals), of(equals))


def key_values(text: Column) -> Column:
    """Map of key-value lines ("**K**: v", "K: v", "K = v"); keys in lower case with underscores, the last of equal keys stands."""
    pairs = F.filter(F.transform(F.split(text, "\n"), lambda x: _pair(_trimmed(x))), lambda p: p.isNotNull() & (p["key"] != "") & (p["value"] != ""))
    return F.map_from_entries(last_of_equal(pairs))


def last_of_equal(pairs: Column) -> Column:
    """Pairs (key, value) of which no later one has the same key, in order."""
    n = F.size(pairs)
    later = lambda p, i: F.exists(F.slice(pairs, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda q: q["key"] == p["key"])
    return F.filter(pairs, lambda p, i: ~later(p, i))


def markdown_sections(text: Column) -> Column:
    """Map from the titles of "#" to "###" headings (lower case) to what stands below them.

    Text before the first heading is "introduction"; a heading right before the
    next has no entry; the last of equal titles stands.
    """
    start = F.struct(F.lit("introduction").alias("key"), F.array().cast("array<string>").alias("lines"))
    init = F.struct(F.array().cast("array<struct<key:string,value:string>>").alias("done"), start.alias("now"))

    def closed(a: Column) -> Column:
        entry = F.struct(a["now"]["key"].alias("key"), _trimmed(F.array_join(a["now"]["lines"], "\n")).alias("value"))
        return F.when(F.size(a["now"]["lines"]) > 0, F.array_append(a["done"], entry)).otherwise(a["done"])

    def step(a: Column, line: Column) -> Column:
        title = F.regexp_extract(line, r"^#{1,3}\s+(.+)$", 1)
        opened = F.struct(closed(a).alias("done"), F.struct(_trimmed(F.lower(title)).alias("key"), F.array().cast("array<string>").alias("lines")).alias("now"))
        more = F.struct(a["done"].alias("done"), F.struct(a["now"]["key"].alias("key"), F.array_append(a["now"]["lines"], line).alias("lines")).alias("now"))
        return F.when(title != "", opened).otherwise(more)

    return F.map_from_entries(last_of_equal(F.aggregate(F.split(text, "\n"), init, step, closed)))


def shortened(text: Column, most: int, kept: int) -> Column:
    """A text over `most` characters cut to `kept` with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept), F.lit("..."))).otherwise(text)


def hex_rgb(colour: Column) -> Column:
    """Red, green and blue of "#rrggbb"; null for anything else."""
    bare = F.regexp_extract(colour, r"^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(bare, i, 2), 16, 10).cast("int")
    return F.when(bare != "", F.array(part(1), part(3), part(5)))


def schema_instructions(schema: T.StructType) -> str:
    """What a model is told about the JSON it has to answer with."""
    return "Answer with JSON only, of this schema:\n```json\n" + schema.json() + "\n```"


def checked(text: Column, schema: T.StructType, required: list[str]) -> Column:
    """JSON of a text as a struct; null where it doesn't parse or lacks a required field."""
    value = F.from_json(extracted_json(text), schema)
    return F.when(value.isNotNull() & F.array_size(F.array_compact(F.array(*[value[r].cast("string") for r in required]))).eqNullSafe(len(required)), value)
