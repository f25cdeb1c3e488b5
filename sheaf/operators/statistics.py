"""Statistics of model answers: features, benefits, use cases, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.list_tables import answer_list
from sheaf.operators.nested import as_list, json_variant
from sheaf.operators.rollups import CATEGORIES, coerced
from sheaf.session import stored

#: Of each aspect: its list, and a field by which a single element is known.
ELEMENTS = {"features": ("features", "benefits"), "use_cases": ("use_cases", "key_features_used"), "benefits": ("benefits", "headline")}
#: First elements that are named in statistics.
FIRST = 5


def answers(entries: DataFrame) -> DataFrame:
    """The entries of the aspects in ELEMENTS, parsed once and stored: entry_id, aspect, answer."""
    aspect = F.lower(F.substring_index("key", ":", 1))
    rows = entries.where(aspect.isin(list(ELEMENTS))).dropDuplicates(["entry_id"])
    return stored(rows.select("entry_id", aspect.alias("aspect"), json_variant(F.col("data")).alias("answer")), "answers")


def elements(parsed: DataFrame, aspect: str) -> DataFrame:
    """Elements of an aspect's list: entry_id, pos, value (variant); only objects count, their positions are those in the list."""
    name, inner = ELEMENTS[aspect]
    rows = parsed.where(F.col("aspect") == aspect).select("entry_id", F.posexplode(as_list(answer_list(F.col("answer"), name, inner))).alias("pos", "value"))
    return rows.where(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")))


def _text(path: str) -> Column:
    """A field as text; null for lists, objects and what is missing."""
    v = F.try_variant_get("value", path, "variant")
    return F.when(~F.schema_of_variant(v).rlike("^(?:OBJECT|ARRAY|VOID)"), F.try_variant_get("value", path, "string"))


def _texts(path: str) -> Column:
    return F.transform(as_list(F.try_variant_get("value", path, "variant")), lambda x: F.try_variant_get(x, "$", "string"))


def _listed(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, values: texts in the order of positions."""
    made = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))).alias("x"))
    return made.select(*by, F.transform("x", lambda x: x["v"]).alias("values"))


def flagship_names(features: DataFrame) -> DataFrame:
    """entry_id, values: names of the features marked is_flagship, in order."""
    return _listed(features.where(F.coalesce(F.try_variant_get("value", "$.is_flagship", "boolean"), F.lit(False)) & _text("$.name").isNotNull()), ["entry_id"], _text("$.name"))


def category_counts(features: DataFrame) -> DataFrame:
    """entry_id, category, features: features with a name by category; unknown categories belong to "other"."""
    named = features.where(_text("$.name").isNotNull())
    return named.groupBy("entry_id", coerced(_text("$.category"), CATEGORIES, "other").alias("category")).agg(F.count(F.lit(1)).alias("features"))


def first_texts(rows: DataFrame, path: str) -> DataFrame:
    """entry_id, values: a field of the first FIRST elements, in order; elements without it are left out."""
    return _listed(rows.where((F.col("pos") < FIRST) & _text(path).isNotNull()), ["entry_id"], _text(path))


def headlines_by_feature(benefits: DataFrame) -> DataFrame:
    """feature, headlines: how many benefits name a feature as their support (multi-valued membership)."""
    rows = benefits.select("entry_id", "pos", F.explode(F.array_distinct(_texts("$.supporting_features"))).alias("feature")).where("feature IS NOT NULL")
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("headlines"))


def headlines_by_audience(benefits: DataFrame) -> DataFrame:
    """entry_id, audience, values: headlines of each audience a benefit is meant for, in order."""
    rows = benefits.select("entry_id", "pos", _text("$.headline").alias("headline"), F.explode(_texts("$.target_audience")).alias("audience"))
    return _listed(rows.where("audience IS NOT NULL AND headline IS NOT NULL"), ["entry_id", "audience"], F.col("headline"))


def industries(use_cases: DataFrame) -> DataFrame:
    """entry_id, values: distinct industries, sorted."""
    rows = use_cases.select("entry_id", _text("$.industry_vertical").alias("i")).where("i <> ''")
    return rows.groupBy("entry_id").agg(F.array_sort(F.collect_set("i")).alias("values"))


def recomputed(parsed: DataFrame) -> DataFrame:
    """All statistics of answers as rows: entry_id, statistic, values (texts)."""
    features, benefits, cases = (elements(parsed, a) for a in ("features", "benefits", "use_cases"))
    counts = category_counts(features).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "category", "features"))).alias("values"))
    made = {
        "flagship_features": flagship_names(features), "features_by_category": counts, "top_benefits": first_texts(benefits, "$.headline"),
        "primary_use_cases": first_texts(cases, "$.title"), "industries": industries(cases),
    }
    return reduce(DataFrame.unionByName, [rows.select("entry_id", F.lit(name).alias("statistic"), "values") for name, rows in made.items()])
