"""Queries over model answers, the result cache, and logs of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import parsing
from sheaf.operators import cache_table as cache
from sheaf.operators import rollups
from sheaf.sources.tables import table

NOW = 1_720_000_000.0
RATES = [("view", 3.0, 15.0), ("click", 0.8, 4.0), ("purchase", 15.0, 75.0)]


def _entries(spark, d):
    return table(spark, d, "cache_entries").dropDuplicates(["entry_id"])


def _sections(spark, d):
    return table(spark, d, "pitch_sections").dropDuplicates(["section_id"])


def json_fenced(spark, d):
    return _entries(spark, d).select("entry_id", parsing.fenced(F.col("data")).alias("json"))


def json_parsed(spark, d):
    v = parsing.parsed_json(F.col("data"))
    return _entries(spark, d).select("entry_id", v.isNotNull().alias("parsed"), F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0).alias("kind"))


def event_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


def parse_bullets(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(parsing.bullet_points(F.col("text"))).alias("bullets"), F.array_join(parsing.bullet_points(F.col("text")), "|").alias("items"))


def parse_numbered(spark, d):
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(parsing.numbered_items(lines)).alias("items"))


def parse_key_values(spark, d):
    pairs = F.map_entries(parsing.key_values(F.col("content")))
    return _sections(spark, d).where("content IS NOT NULL").select("section_id", F.explode(pairs).alias("p")).select("section_id", "p.key", "p.value")


def parse_sections(spark, d):
    m = F.map_entries(parsing.markdown_sections(F.col("text")))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(m).alias("m")).select("doc_id", F.col("m.key").alias("section"), F.length("m.value").alias("chars"))


def cache_files(spark, d):
    return _entries(spark, d).select("entry_id", cache.file_name(F.col("key")).alias("file"), cache.aspect_of(F.col("key")).alias("aspect"))


def cache_expired(spark, d):
    return _entries(spark, d).select("entry_id", cache.expired(F.col("expires_at"), F.lit(NOW)).alias("expired"), cache.expiry(F.col("created_at"), F.when(F.col("entry_id") % 3 == 0, -1).when(F.col("entry_id") % 3 == 1, 0), 86400).alias("new_expiry"))


def cache_latest(spark, d):
    return cache.latest(_entries(spark, d).select("key", "entry_id", "created_at", "expires_at"))


def _probes(spark, d):
    known = table(spark, d, "cache_entries").select("content_hash").distinct()
    asked = known.select(F.explode(F.array(*[F.lit(a) for a in ("features", "use_cases", "benefits", "pricing")])).alias("aspect"), "content_hash")
    return cache.probe(asked, table(spark, d, "cache_entries"), F.lit(NOW))


def cache_probe(spark, d):
    return _probes(spark, d).select("aspect", "content_hash", "hit")


def cache_hit_rate(spark, d):
    return cache.hit_statistics(_probes(spark, d), "aspect")


def cache_lru_keep(spark, d):
    uses = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return cache.kept_by_use(uses, 100).select("key", "hit_count")


def cache_left(spark, d):
    old = table(spark, d, "cache_entries").where(F.col("created_at") < NOW - 5e6).select("content_hash").distinct()
    return cache.without(_entries(spark, d), content_hashes=old).select("entry_id")


def cached_aspects(spark, d):
    return cache.cached_aspects(table(spark, d, "cache_entries")).select("content_hash", F.array_join("aspects", ",").alias("aspects"))


def cache_size(spark, d):
    return cache.size_report(_entries(spark, d), F.lit(NOW))


def _items(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", (F.col("event_type") != "error").alias("success"), F.length("props").alias("tokens"), F.col("value").alias("amount"))


def batch_totals(spark, d):
    return rollups.batch_totals(_items(spark, d), "user_id")


def retry_outcomes(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"))
    return rollups.retry_outcomes(log, 2)


def progress(spark, d):
    return rollups.progress(table(spark, d, "events").select("event_type", F.col("value").alias("seconds")), 5000, "event_type")


def usage_cost(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return rollups.usage_cost(calls, spark.createDataFrame(RATES, "model string, input_per_m double, output_per_m double"), "view")


QUERIES = {f.__name__: f for f in (
    json_fenced, json_parsed, event_properties, parse_bullets, parse_numbered, parse_key_values, parse_sections, cache_files, cache_expired, cache_latest, cache_probe, cache_hit_rate, cache_lru_keep,
    cache_left, cached_aspects, cache_size, batch_totals, retry_outcomes, progress, usage_cost,
)}

E = "e AS (SELECT * FROM cache_entries QUALIFY row_number() OVER (PARTITION BY entry_id) = 1)"
S = "s AS (SELECT * FROM pitch_sections QUALIFY row_number() OVER (PARTITION BY section_id) = 1)"
_F1, _F2 = r"regexp_extract(data, '```json\s*([\s\S]*?)\s*```', 1)", r"regexp_extract(data, '```\s*([\s\S]*?)\s*```', 1)"
_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_PROBE = f"""WITH h AS (SELECT DISTINCT content_hash FROM cache_entries), q AS (SELECT unnest(['features', 'use_cases', 'benefits', 'pricing']) AS aspect, content_hash FROM h),
  v AS (SELECT DISTINCT key FROM cache_entries WHERE expires_at IS NULL OR expires_at >= {NOW}), p AS (SELECT aspect, content_hash, v.key IS NOT NULL AS hit FROM q LEFT JOIN v ON v.key = aspect || ':' || content_hash)"""
_B, _C, _Q = r"'^\*\*([^*]+)\*\*:\s*(.+)$'", r"'^([^:=]+):\s*(.+)$'", r"'^([^:=]+)=\s*(.+)$'"

_WIDEST = [r"regexp_extract(data, '(\{[\s\S]*\})', 1)", r"regexp_extract(data, '(\[[\s\S]*\])', 1)"]
_INSIDE = ", ".join([f"CASE WHEN regexp_matches({x}, '^[{{\\[]') THEN {x} END" for x in (_F1, _F2)] + [f"CASE WHEN json_valid({x}) THEN {x} END" for x in _WIDEST])

ORACLE = {
    "json_parsed": f"""WITH {E}, p AS (SELECT entry_id, CASE WHEN json_valid(trim(data)) THEN CAST(trim(data) AS JSON) ELSE TRY_CAST(coalesce({_INSIDE}) AS JSON) END AS v FROM e)
      SELECT entry_id, v IS NOT NULL AS parsed, CASE json_type(v) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'NULL' THEN 'VOID' ELSE json_type(v) END AS kind FROM p""",
    "json_fenced": f"WITH {E} SELECT entry_id, coalesce(CASE WHEN regexp_matches({_F1}, '^[{{\\[]') THEN {_F1} END, CASE WHEN regexp_matches({_F2}, '^[{{\\[]') THEN {_F2} END) AS json FROM e",
    "event_properties": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "parse_bullets": rf"""WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?m)^\s*[-*•]\s*(.+)$', 1), lambda i: {_TRIM.format('i')}), lambda i: i <> '') AS b FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(len(b) AS INT) AS bullets, array_to_string(b, '|') AS items FROM x""",
    "parse_numbered": rf"""WITH l AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i::VARCHAR || '. ' || x), chr(10)) AS t FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(len(list_filter(list_transform(regexp_extract_all(t, '(?m)^\s*\d+[.)]\s*(.+)$', 1), lambda i: {_TRIM.format('i')}), lambda i: i <> '')) AS INT) AS items FROM l""",
    "parse_key_values": rf"""WITH {S}, l AS (SELECT section_id, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM s WHERE content IS NOT NULL),
      t AS (SELECT section_id, i, {_TRIM.format('raw')} AS x FROM l),
      p AS (SELECT section_id, i, CASE WHEN regexp_matches(x, {_B}) THEN regexp_extract(x, {_B}, 1) WHEN regexp_matches(x, {_C}) THEN regexp_extract(x, {_C}, 1) ELSE regexp_extract(x, {_Q}, 1) END AS k,
        CASE WHEN regexp_matches(x, {_B}) THEN regexp_extract(x, {_B}, 2) WHEN regexp_matches(x, {_C}) THEN regexp_extract(x, {_C}, 2) ELSE regexp_extract(x, {_Q}, 2) END AS v FROM t),
      c AS (SELECT section_id, i, replace(lower({_TRIM.format('k')}), ' ', '_') AS key, {_TRIM.format('v')} AS value FROM p)
      SELECT section_id, key, value FROM c WHERE key <> '' AND value <> '' QUALIFY row_number() OVER (PARTITION BY section_id, key ORDER BY i DESC) = 1""",
    "parse_sections": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
      h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,3}}\s+(.+)$') THEN {_TRIM.format("lower(regexp_extract(line, '^#{1,3}\\s+(.+)$', 1))")} END AS title FROM l),
      n AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM h),
      g AS (SELECT doc_id, no, coalesce(max(title), 'introduction') AS section, string_agg(line, chr(10) ORDER BY i) FILTER (title IS NULL) AS body FROM n GROUP BY doc_id, no)
      SELECT doc_id, section, CAST(length({_TRIM.format('body')}) AS INT) AS chars FROM g WHERE body IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY no DESC) = 1""",
    "cache_files": f"WITH {E} SELECT entry_id, md5(key) || '.json' AS file, string_split(key, ':')[1] AS aspect FROM e",
    "cache_expired": f"WITH {E} SELECT entry_id, coalesce(expires_at < {NOW}, false) AS expired, CASE entry_id % 3 WHEN 0 THEN created_at - 1 WHEN 2 THEN created_at + 86400 END AS new_expiry FROM e",
    "cache_latest": f"WITH {E} SELECT key, entry_id, created_at, expires_at FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, entry_id DESC) = 1",
    "cache_probe": _PROBE + " SELECT aspect, content_hash, hit FROM p",
    "cache_hit_rate": _PROBE + " SELECT aspect, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate FROM p GROUP BY aspect",
    "cache_lru_keep": "SELECT user_id AS key, count(*) AS hit_count FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 100",
    "cache_left": f"WITH {E} SELECT entry_id FROM e WHERE content_hash NOT IN (SELECT content_hash FROM cache_entries WHERE created_at < {NOW - 5e6} AND content_hash IS NOT NULL) OR content_hash IS NULL",
    "cached_aspects": "SELECT content_hash, array_to_string(list_sort(list(DISTINCT string_split(key, ':')[1])), ',') AS aspects FROM cache_entries GROUP BY content_hash",
    "cache_size": f"WITH {E} SELECT count(*) AS entries, count(DISTINCT key) AS keys, count(*) FILTER (expires_at < {NOW}) AS expired, CAST(sum(coalesce(strlen(data), 0)) AS BIGINT) AS bytes FROM e",
    "batch_totals": """SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type <> 'error') / count(*), 4) AS success_rate,
      CAST(coalesce(sum(length(props)) FILTER (event_type <> 'error'), 0) AS BIGINT) AS tokens, round(coalesce(sum(value) FILTER (event_type <> 'error'), 0), 2) AS amount FROM events GROUP BY user_id""",
    "retry_outcomes": """WITH r AS (SELECT user_id AS item, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT item, min(n - 1) FILTER (ok) AS r FROM r WHERE n <= 3 GROUP BY item) SELECT item, r IS NOT NULL AS success, CAST(coalesce(r, 3) AS INT) AS retries FROM f""",
    "progress": "SELECT event_type, round(100 * count(*) / 5000, 1) AS percent, round(avg(value), 4) AS mean_seconds, round(avg(value) * greatest(5000 - count(*), 0), 2) AS seconds_left FROM events GROUP BY event_type",
    "usage_cost": f"""WITH r(model, i, o) AS (VALUES {', '.join(map(str, RATES))}), c AS (SELECT event_type AS model, event_id AS x, user_id AS y, coalesce(r.i, 3.0) AS i, coalesce(r.o, 15.0) AS o FROM events LEFT JOIN r ON r.model = event_type)
      SELECT model, count(*) AS requests, CAST(sum(x + y) AS BIGINT) AS tokens, round(sum((x * i + y * o) / 1e6), 4) AS cost FROM c GROUP BY ROLLUP (model)""",
}
