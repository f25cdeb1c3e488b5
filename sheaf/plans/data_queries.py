"""Queries of the general data operators: snapshot changes and nested records."""

from __future__ import annotations

from sheaf.operators import list_tables, snapshot_cells
from sheaf.sources.tables import table


def p4_found(spark, d):
    changes = snapshot_cells.page_changes(table(spark, d, "snapshot_pages"), fields=["content_hash"])
    return changes.select("product_id", "from_extraction", "to_extraction", "url_key", "change")


def p4_changed_fields(spark, d):
    changes = snapshot_cells.page_changes(table(spark, d, "snapshot_pages"))
    return changes.selectExpr("product_id", "from_extraction", "to_extraction", "url_key", "change", "array_join(fields, ',') AS fields")


def p5_found(spark, d):
    return list_tables.list_elements(table(spark, d, "content_blocks"), table(spark, d, "cache_entries"))


def p5_cells(spark, d):
    return list_tables.table_cells(table(spark, d, "content_blocks")).distinct()


_PAGES = r"""
WITH given AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '') AS bare,
    regexp_extract(regexp_replace(lower(content_hash), '^\s*(sha-?256|0x)[\s:=-]*', ''), '^\s*([0-9a-f]{32})', 1) AS digits
  FROM snapshot_pages WHERE url IS NOT NULL
), keyed AS (
  SELECT product_id, extraction_id, started_at, extracted_at, loaded_at, title,
    lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1))
      || substr(bare, length(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) + 1) AS url_key,
    CASE WHEN length(digits) = 32 THEN digits
      ELSE substr(sha256(trim(regexp_replace(lower(coalesce(page_text, '')), '[\t-\r \x{85}\p{Z}]+', ' ', 'g'))), 1, 32) END AS hash
  FROM given
), pages AS (
  SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY product_id, extraction_id, url_key
    ORDER BY extracted_at DESC, loaded_at DESC, hash DESC, title DESC) = 1
), snaps AS (
  SELECT product_id, extraction_id, lag(extraction_id) OVER w AS before
  FROM (SELECT product_id, extraction_id, min(started_at) AS began FROM keyed GROUP BY ALL)
  WINDOW w AS (PARTITION BY product_id ORDER BY began, extraction_id)
), later AS (
  SELECT p.product_id, s.before AS f, s.extraction_id AS t, url_key, hash, title
  FROM pages p JOIN snaps s USING (product_id, extraction_id) WHERE s.before IS NOT NULL
), earlier AS (
  SELECT p.product_id, s.before AS f, s.extraction_id AS t, url_key, hash, title
  FROM pages p JOIN snaps s ON p.product_id = s.product_id AND p.extraction_id = s.before
), both_sides AS (
  SELECT coalesce(l.product_id, e.product_id) AS product_id, coalesce(l.f, e.f) AS from_extraction, coalesce(l.t, e.t) AS to_extraction,
    coalesce(l.url_key, e.url_key) AS url_key, l.url_key IS NOT NULL AS here, e.url_key IS NOT NULL AS there,
    l.hash IS DISTINCT FROM e.hash AS hash_differs, l.title IS DISTINCT FROM e.title AS title_differs
  FROM later l FULL JOIN earlier e ON l.product_id = e.product_id AND l.f = e.f AND l.t = e.t AND l.url_key = e.url_key
)
"""

def _json(text: str) -> str:
    """SQL for the JSON value in a text: the whole, else from the first bracket that starts a line (else the first at all) to the last of its kind."""
    bare = rf"regexp_replace({text}, '^[\s\x{{FEFF}}]+|[\s\x{{FEFF}}]+$', '', 'g')"
    lined = rf"regexp_extract({bare}, '(?ms)^[ \t]*([\[{{].*)\z', 1)"
    start = rf"CASE WHEN {lined} <> '' THEN {lined} ELSE regexp_extract({bare}, '(?s)([\[{{].*)\z', 1) END"
    upto = rf"regexp_extract({start}, CASE WHEN starts_with({start}, '{{') THEN '(?s)\A(.*\}})' ELSE '(?s)\A(.*\])' END, 1)"
    return f"CASE WHEN json_valid({bare}) THEN CAST({bare} AS JSON) WHEN json_valid({upto}) THEN CAST({upto} AS JSON) END"


def _as_list(value: str) -> str:
    return f"CASE WHEN json_type({value}) = 'ARRAY' THEN from_json({value}, '[\"JSON\"]') WHEN {value} IS NOT NULL AND json_type({value}) <> 'NULL' THEN [{value}] END"


_LISTS = rf"""
WITH t AS (SELECT DISTINCT entry_id, lower(split_part(key, ':', 1)) AS aspect, data FROM cache_entries),
  a AS (SELECT entry_id, aspect, {_json("data")} AS v FROM t WHERE aspect IN ('features', 'use_cases')),
  b AS (SELECT entry_id, aspect, CASE WHEN json_type(v) = 'VARCHAR' THEN {_json("json_extract_string(v, '$')")} ELSE v END AS v FROM a),
  c AS (SELECT entry_id, aspect, v, json_extract(v, '$.' || aspect) AS own, json_extract(v, '$.data') AS data, json_extract(v, '$.data.' || aspect) AS below,
    CASE aspect WHEN 'features' THEN 'benefits' ELSE 'key_features_used' END AS inner_name FROM b),
  l AS (SELECT entry_id, aspect, inner_name, CASE WHEN json_type(v) = 'ARRAY' THEN v WHEN own IS NOT NULL THEN own WHEN below IS NOT NULL THEN below
    WHEN json_type(data) = 'ARRAY' THEN data WHEN json_extract(v, '$.' || inner_name) IS NOT NULL THEN v END AS v FROM c),
  o AS (SELECT entry_id, aspect, inner_name, unnest({_as_list("v")}) AS v, generate_subscripts({_as_list("v")}, 1) - 1 AS pos_outer FROM l),
  n AS (SELECT entry_id, aspect, pos_outer, json_extract(v, '$.' || inner_name) AS v FROM o WHERE json_type(v) = 'OBJECT'),
  i AS (SELECT entry_id, aspect, pos_outer, unnest({_as_list("v")}) AS v, generate_subscripts({_as_list("v")}, 1) - 1 AS pos_inner FROM n),
  r AS (SELECT block_id, unnest(table_data.rows) AS cells, generate_subscripts(table_data.rows, 1) - 1 AS row FROM content_blocks),
  x AS (SELECT block_id, row, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS "column" FROM r)
SELECT DISTINCT 'table_cell' AS item_kind, block_id AS parent_id, CAST(row AS BIGINT) AS pos_outer, CAST("column" AS BIGINT) AS pos_inner FROM x WHERE regexp_matches(cell, '\S')
UNION ALL SELECT DISTINCT CASE aspect WHEN 'features' THEN 'benefit' ELSE 'key_feature' END, entry_id, CAST(pos_outer AS BIGINT), CAST(pos_inner AS BIGINT)
FROM i WHERE json_type(v) <> 'NULL' AND (json_type(v) <> 'VARCHAR' OR regexp_matches(json_extract_string(v, '$'), '\S'))"""

_CHANGE = "CASE WHEN NOT there THEN 'added' WHEN NOT here THEN 'removed' ELSE 'changed' END AS change"

QUERIES = {"p4_found": p4_found, "p4_changed_fields": p4_changed_fields, "p5_found": p5_found, "p5_cells": p5_cells}

ORACLE = {
    "p5_found": _LISTS,
    "p4_found": _PAGES + f"SELECT product_id, from_extraction, to_extraction, url_key, {_CHANGE} FROM both_sides WHERE NOT here OR NOT there OR hash_differs",
    "p4_changed_fields": _PAGES
    + f"""SELECT product_id, from_extraction, to_extraction, url_key, {_CHANGE},
        CASE WHEN here AND there THEN concat_ws(',', CASE WHEN hash_differs THEN 'content_hash' END, CASE WHEN title_differs THEN 'title' END) ELSE '' END AS fields
      FROM both_sides WHERE NOT here OR NOT there OR hash_differs OR title_differs""",
    "p5_cells": r"""
      WITH r AS (SELECT block_id, unnest(table_data.rows) AS cells, generate_subscripts(table_data.rows, 1) - 1 AS row FROM content_blocks),
      c AS (SELECT block_id, row, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS "column" FROM r)
      SELECT DISTINCT block_id, CAST(row AS INT) AS row, CAST("column" AS INT) AS "column", cell FROM c WHERE regexp_matches(cell, '\S')""",
}
