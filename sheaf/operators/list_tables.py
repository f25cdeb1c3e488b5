"""Flat tables of page tables and of the lists inside cached model answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.nested import filled, flatten_typed, flatten_variant, json_variant
from sheaf.session import stored

#: Of each aspect: its list, the list inside each element, and the name of the result's rows.
LISTS = {"features": ("benefits", "benefit"), "use_cases": ("key_features_used", "key_feature")}

RESULT = ("item_kind", "parent_id", "pos_outer", "pos_inner")


def answer_list(answer: Column, name: str, inner: str) -> Column:
    """The list called name in an answer.

    It may stand at the top, under "data", be the whole answer, or the answer may
    be a single element that has the inner list itself.
    """
    data = F.try_variant_get(answer, "$.data", "variant")
    is_list = lambda v: F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    return (
        F.when(is_list(answer), answer)
        .when(F.try_variant_get(answer, f"$.{name}", "variant").isNotNull(), F.try_variant_get(answer, f"$.{name}", "variant"))
        .when(F.try_variant_get(answer, f"$.data.{name}", "variant").isNotNull(), F.try_variant_get(answer, f"$.data.{name}", "variant"))
        .when(data.isNotNull() & is_list(data), data)
        .when(F.try_variant_get(answer, f"$.{inner}", "variant").isNotNull(), answer)
    )


def parsed_answers(entries: DataFrame) -> DataFrame:
    """The answers of the aspects in LISTS, parsed once and stored: entry_id, _aspect, _answer."""
    aspect = F.lower(F.substring_index("key", ":", 1))
    return stored(entries.where(aspect.isin(list(LISTS))).select("entry_id", aspect.alias("_aspect"), json_variant(F.col("data")).alias("_answer")), "answers")


def answer_tables(answers: DataFrame, aspect: str) -> dict[str, DataFrame]:
    """Child tables of the parsed answers of one aspect, by path; "" is the aspect's own list.

    Entries of another aspect, with null, broken or cut off JSON give no rows.
    Rows sent twice give equal rows.
    """
    inner, _ = LISTS[aspect]
    mine = answers.where(F.col("_aspect") == aspect)
    return flatten_variant(mine.select("entry_id", answer_list(F.col("_answer"), aspect, inner).alias("_list")), "entry_id", "_list")


def table_cells(blocks: DataFrame) -> DataFrame:
    """Non-blank cells of table_data.rows: block_id, row, column, cell. Null tables, rows and cells give none."""
    slim = blocks.where("table_data.rows is not null").select("block_id", F.col("table_data.rows").alias("rows"))
    cells = flatten_typed(slim, "block_id").get("rows[]")
    return cells.where(F.regexp_like("value", F.lit(r"(?U)\S"))).select("block_id", F.get("_at", F.lit(0)).alias("row"), F.get("_at", F.lit(1)).alias("column"), F.col("value").alias("cell"))


def list_elements(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """All filled elements: item_kind, parent_id, pos_outer, pos_inner; distinct rows."""
    parts = [table_cells(blocks).select(F.lit("table_cell").alias("item_kind"), F.col("block_id").alias("parent_id"), F.col("row").cast("long").alias("pos_outer"), F.col("column").cast("long").alias("pos_inner"))]
    answers = parsed_answers(entries)
    for aspect, (inner, kind) in LISTS.items():
        level = answer_tables(answers, aspect).get(inner)
        if level is not None:
            at = [F.get("_at", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("pos_outer", "pos_inner"))]
            parts.append(level.where(filled(F.col("value"))).select(F.lit(kind).alias("item_kind"), F.col("entry_id").alias("parent_id"), *at))
    return reduce(DataFrame.unionByName, parts).distinct()
