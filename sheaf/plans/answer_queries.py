"""Queries over model answers as typed records: statistics, lenient parsing, names, model settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import parsing
from sheaf.operators import model, statistics
from sheaf.plans.data_queries import _as_list, _json
from sheaf.sources.tables import table

#: Models with their windows, and tasks with their models, as a caller would give them.
MODELS = [("small", 2_000), ("medium", 6_000), ("large", 20_000)]
TASKS = [("view", "small"), ("click", "medium"), ("purchase", "large")]


def _entries(spark, d):
    return table(spark, d, "cache_entries")


def _elements(spark, d, aspect):
    return statistics.elements(statistics.answers(_entries(spark, d)), aspect)


def feature_counts(spark, d):
    return statistics.category_counts(_elements(spark, d, "features"))


def top_features(spark, d):
    """Names of the first five features of each entry, in order."""
    return statistics.first_texts(_elements(spark, d, "features"), "$.name").select("entry_id", F.array_join("values", ", ").alias("names"))


def supporting_features(spark, d):
    """How many benefits each feature supports."""
    return statistics.headlines_by_feature(_elements(spark, d, "benefits"))


def answer_statistics(spark, d):
    return statistics.recomputed(statistics.answers(_entries(spark, d))).select("entry_id", "statistic", F.array_join("values", " | ").alias("values"))


def json_lists(spark, d):
    """Answers read as lists, leniently: all items, and those that are objects with a name."""
    rows = _entries(spark, d).dropDuplicates(["entry_id"])
    return rows.select("entry_id", F.size(parsing.parsed_list(F.col("data"))).alias("items"), F.size(parsing.parsed_list(F.col("data"), "name")).alias("named"))


def lenient_sections(spark, d):
    """Answers read as sections: whether they were JSON, and what became of those that were not."""
    rows = _entries(spark, d).dropDuplicates(["entry_id"]).where("data IS NOT NULL").select("entry_id", parsing.lenient_section(F.col("data")).alias("s"))
    return rows.select("entry_id", "s.parsed", "s.title", F.when(~F.col("s.parsed"), F.length("s.content")).alias("chars"))


def _first_words():
    """A namer for tests of the operator: the first three words of the text, an error where there are none."""
    def name(prompt: str) -> str:
        words = prompt.split("\n", 1)[1].split()[:3]
        if not words:
            raise ValueError("no words")
        return f'"{" ".join(words)}"'

    return name


def detected_names(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return model.detected_names(texts, _first_words).select(F.col("key").alias("doc_id"), "name")


def settled_models(spark, d):
    calls = table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("task"), F.col("user_id").alias("tokens"))
    made = model.settled(calls, spark.createDataFrame(MODELS, "model string, window long"), spark.createDataFrame(TASKS, "task string, model string"), "medium")
    return made.withColumnRenamed("key", "event_id")


QUERIES = {f.__name__: f for f in (feature_counts, top_features, supporting_features, answer_statistics, json_lists, lenient_sections, detected_names, settled_models)}

_WITH = ", ".join(f"'{a}'" for a in statistics.ELEMENTS)
_INNER = "CASE aspect " + " ".join(f"WHEN '{a}' THEN '{i}'" for a, (_, i) in statistics.ELEMENTS.items()) + " END"
_ELEMENTS = rf"""WITH t AS (SELECT DISTINCT entry_id, lower(split_part(key, ':', 1)) AS aspect, data FROM cache_entries),
  a AS (SELECT entry_id, aspect, {_json("data")} AS v FROM t WHERE aspect IN ({_WITH})),
  b AS (SELECT entry_id, aspect, CASE WHEN json_type(v) = 'VARCHAR' THEN {_json("json_extract_string(v, '$')")} ELSE v END AS v FROM a),
  c AS (SELECT *, json_extract(v, '$.' || aspect) AS own, json_extract(v, '$.data') AS data, json_extract(v, '$.data.' || aspect) AS below, {_INNER} AS inner_name FROM b),
  l AS (SELECT entry_id, aspect, CASE WHEN json_type(v) = 'ARRAY' THEN v WHEN own IS NOT NULL THEN own WHEN below IS NOT NULL THEN below
    WHEN json_type(data) = 'ARRAY' THEN data WHEN json_extract(v, '$.' || inner_name) IS NOT NULL THEN v END AS v FROM c),
  x AS (SELECT entry_id, aspect, unnest({_as_list("v")}) AS v, generate_subscripts({_as_list("v")}, 1) - 1 AS pos FROM l),
  o AS (SELECT * FROM x WHERE json_type(v) = 'OBJECT'),
  f AS (SELECT entry_id, pos, v, {{text}}(v, '$.name') AS name, {{text}}(v, '$.category') AS category FROM o WHERE aspect = 'features')"""
_TEXT = "CASE WHEN json_type({0}, '{1}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string({0}, '{1}') END"
_CATEGORIES = ", ".join(f"'{c}'" for c in statistics.CATEGORIES)
_O = _ELEMENTS.replace("{text}(v, '$.name')", _TEXT.format("v", "$.name")).replace("{text}(v, '$.category')", _TEXT.format("v", "$.category"))
_O += f""", k AS (SELECT entry_id, CASE WHEN lower(trim(category)) IN ({_CATEGORIES}) THEN lower(trim(category)) ELSE 'other' END AS category, count(*) AS features FROM f WHERE name IS NOT NULL GROUP BY ALL)"""
_FIRST = "SELECT entry_id, '{0}' AS statistic, string_agg(t, ' | ' ORDER BY pos) AS values FROM (SELECT entry_id, pos, {1} AS t FROM o WHERE aspect = '{2}' AND pos < 5) WHERE t IS NOT NULL GROUP BY entry_id"
_F1, _F2 = r"regexp_extract(data, '```json\s*([\s\S]*?)\s*```', 1)", r"regexp_extract(data, '```\s*([\s\S]*?)\s*```', 1)"
_WIDE = [r"regexp_extract(data, '(\{[\s\S]*\})', 1)", r"regexp_extract(data, '(\[[\s\S]*\])', 1)"]
_PARSED = (
    "CASE WHEN json_valid(trim(data)) THEN CAST(trim(data) AS JSON) ELSE TRY_CAST(coalesce("
    + ", ".join([f"CASE WHEN regexp_matches({x}, '^[{{\\[]') THEN {x} END" for x in (_F1, _F2)] + [f"CASE WHEN json_valid({x}) THEN {x} END" for x in _WIDE])
    + ") AS JSON) END"
)
_BLANK = r"[^\t-\r\x1c-\x1f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

ORACLE = {
    "feature_counts": _O + " SELECT entry_id, category, features FROM k",
    "top_features": _O + " SELECT entry_id, string_agg(name, ', ' ORDER BY pos) AS names FROM f WHERE pos < 5 AND name IS NOT NULL GROUP BY entry_id",
    "supporting_features": _O
    + f""", s AS (SELECT DISTINCT entry_id, pos, json_extract_string(unnest({_as_list("json_extract(v, '$.supporting_features')")}), '$') AS feature FROM o WHERE aspect = 'benefits')
      SELECT feature, count(*) AS headlines FROM s WHERE feature IS NOT NULL GROUP BY feature""",
    "answer_statistics": _O
    + f""" SELECT entry_id, 'flagship_features' AS statistic, string_agg(name, ' | ' ORDER BY pos) AS values FROM f WHERE name IS NOT NULL AND json_extract_string(v, '$.is_flagship') = 'true' GROUP BY entry_id
      UNION ALL SELECT entry_id, 'features_by_category', string_agg(category || ':' || features, ' | ' ORDER BY category || ':' || features) FROM k GROUP BY entry_id
      UNION ALL {_FIRST.format('top_benefits', _TEXT.format('v', '$.headline'), 'benefits')} UNION ALL {_FIRST.format('primary_use_cases', _TEXT.format('v', '$.title'), 'use_cases')}
      UNION ALL SELECT entry_id, 'industries', string_agg(DISTINCT i, ' | ' ORDER BY i) FROM (SELECT entry_id, {_TEXT.format('v', '$.industry_vertical')} AS i FROM o WHERE aspect = 'use_cases') WHERE i <> '' GROUP BY entry_id""",
    "json_lists": f"""WITH e AS (SELECT DISTINCT entry_id, data FROM cache_entries), p AS (SELECT entry_id, {_PARSED} AS v FROM e),
      l AS (SELECT entry_id, CASE WHEN v IS NULL THEN [] WHEN json_type(v) = 'ARRAY' THEN from_json(v, '["JSON"]') ELSE [v] END AS items FROM p)
      SELECT entry_id, CAST(len(items) AS INT) AS items, CAST(len(list_filter(items, lambda x: json_type(x) = 'OBJECT' AND json_type(x, '$.name') <> 'NULL')) AS INT) AS named FROM l""",
    "lenient_sections": f"""WITH e AS (SELECT DISTINCT entry_id, {_STRIP.format('data')} AS t FROM cache_entries WHERE data IS NOT NULL),
      s AS (SELECT entry_id, t, string_split(t, chr(10)) AS l FROM e),
      b AS (SELECT entry_id, {_STRIP.format("CASE WHEN starts_with(t, '```') THEN array_to_string(l[2:len(l) - CASE WHEN l[-1] = '```' THEN 1 ELSE 0 END], chr(10)) ELSE t END")} AS body FROM s),
      p AS (SELECT entry_id, body, CASE WHEN json_valid(body) THEN CAST(body AS JSON) WHEN json_valid(regexp_extract(body, '\\{{[\\s\\S]*\\}}')) THEN CAST(regexp_extract(body, '\\{{[\\s\\S]*\\}}') AS JSON) END AS v FROM b)
      SELECT entry_id, v IS NOT NULL AS parsed, CASE WHEN v IS NULL THEN 'Section' ELSE json_extract_string(v, '$.title') END AS title, CASE WHEN v IS NULL THEN CAST(length(body) AS INT) END AS chars FROM p""",
    "detected_names": f"""WITH w AS (SELECT doc_id, regexp_extract_all(substr(text, 1, 2000), '{_BLANK}')[1:3] AS w FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CASE WHEN len(w) = 0 THEN 'Unknown Product' ELSE regexp_replace(regexp_replace(array_to_string(w, ' '), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') END AS name FROM w""",
    "settled_models": f"""WITH m(model, size) AS (VALUES {', '.join(map(str, MODELS))}), t(task, model) AS (VALUES {', '.join(map(str, TASKS))}),
      c AS (SELECT event_id, user_id, coalesce(t.model, 'medium') AS model FROM events LEFT JOIN t ON t.task = event_type)
      SELECT event_id, c.model, coalesce(user_id <= size, true) AS fits FROM c LEFT JOIN m USING (model)""",
}
