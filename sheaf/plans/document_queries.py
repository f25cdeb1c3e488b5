"""Queries that build an asset inventory, documents and snapshot reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.functions.fingerprints import text_hash
from sheaf.functions.parsing import hex_rgb, shortened
from sheaf.functions.urls import netloc
from sheaf.operators import assembly, html, snapshot_cells, snapshots, templates, visuals
from sheaf.plans.page_queries import _IMG, B
from sheaf.plans.record_queries import S, _sections
from sheaf.sources.tables import table


def _blocks(spark, d):
    return table(spark, d, "content_blocks").dropDuplicates(["block_id"])


def snapshot_diff(spark, d):
    """Every page of the newest two snapshots of each product: added, removed, modified or unchanged."""
    return snapshots.newest_diff(snapshot_cells.snapshot_page_rows(table(spark, d, "snapshot_pages")))


def snapshot_diff_counts(spark, d):
    return snapshot_diff(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


def first_snapshots(spark, d):
    """The first snapshot of each product, against nothing: all its pages are added."""
    pages = snapshot_cells.snapshot_page_rows(table(spark, d, "snapshot_pages"))
    counts = pages.groupBy("product_id", "extraction_id").agg(F.min("started_at").alias("at"), F.count(F.lit(1)).alias("added"))
    return counts.groupBy("product_id").agg(F.min_by("added", F.struct("at", "extraction_id")).alias("added"))


def visual_inventory(spark, d):
    return visuals.inventory(_blocks(spark, d)).select("owner", "asset_id", "asset_type", "kind")


def visual_totals(spark, d):
    return visuals.inventory_totals(visuals.inventory(_blocks(spark, d)))


def visual_candidates(spark, d):
    wanted = _blocks(spark, d).select(F.col("extraction_id").alias("owner"), F.explode(F.array(*[F.lit(s) for s in (*visuals.PREFERRED, "problem")])).alias("section_type"))
    rows = visuals.candidates(wanted, visuals.inventory(_blocks(spark, d)))
    return rows.select("owner", "section_type", "asset_id", "place", visuals.placement(F.col("section_type"), F.col("place"), F.col("asset_type")).alias("placement"))


def image_files(spark, d):
    rows = _blocks(spark, d).select(F.explode("media_assets").alias("m")).where("m.url IS NOT NULL")
    return rows.select(F.col("m.url").alias("url"), visuals.image_file(F.col("m.url")).alias("file")).distinct()


def mapping_validate(spark, d):
    """The assets that go with each section, an unknown id in front, checked against the inventory."""
    chosen = visual_candidates(spark, d).groupBy(F.concat_ws("/", "owner", "section_type").alias("name")).agg(F.array_sort(F.collect_list(F.struct("place", "asset_id"))).alias("x"))
    asked = chosen.select("name", F.concat(F.array(F.lit("missing")), F.transform("x", lambda x: x["asset_id"])).alias("asset_ids"))
    return visuals.valid_mapping(asked, visuals.inventory(_blocks(spark, d))).select("name", F.array_join("asset_ids", ",").alias("asset_ids"))


def section_plan(spark, d):
    return assembly.chosen_sections(_sections(spark, d), None, left_out=("pricing",)).select("pitch_id", "section_id", "section_type")


def pitch_markdown(spark, d):
    return assembly.markdown(_sections(spark, d))


def pitch_text(spark, d):
    return assembly.plain_text(_sections(spark, d))


def pitch_totals(spark, d):
    return assembly.totals(_sections(spark, d))


def pitch_outline(spark, d):
    return assembly.outline(_sections(spark, d))


def pitch_slides(spark, d):
    return assembly.slides(_sections(spark, d)).select("pitch_id", "slide_no", "kind", "title", F.size("bullets").alias("bullets"), F.length("notes").alias("notes"))


def pitch_contents(spark, d):
    return assembly.contents(_sections(spark, d))


def assets_by_ids(spark, d):
    """The assets that are no plain pictures, asked for by their ids, in the order of each inventory."""
    assets = visuals.inventory(_blocks(spark, d))
    return visuals.assets_by_ids(assets, assets.where("kind <> 'image'").select("asset_id"))


def pitch_calls(spark, d):
    return assembly.call_to_action(_sections(spark, d))


def short_titles(spark, d):
    return table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", shortened(F.col("title"), 20, 17).alias("title"), F.array_join(hex_rgb(F.concat(F.lit("#"), F.substring(F.md5("title"), 1, 6))).cast("array<string>"), " ").alias("rgb"))


def template_history(spark, d):
    """Registrations of section templates, the newest current: a section type is a name, each section a version."""
    rows = _sections(spark, d).select(F.col("section_type").alias("name"), F.col("section_id").alias("seq"), F.coalesce("content", F.lit("")).alias("template"))
    return templates.history(rows).select("name", "seq", "back", "hash")


def template_variables(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(templates.variables(F.concat(F.lit("{{title}} {{lang}} {{title}} "), "text")), ",").alias("variables"))


def templates_rendered(spark, d):
    """A fixed template filled from each document's fields, by the general renderer."""
    template = "{{#if title}}# {{title}}{{/if}}\n\n\n\n{{#each words}}{{index}}. {{item}}\n{{/each}}\nSource: {{source}}"
    rows = table(spark, d, "documents").select("doc_id", F.to_json(F.struct("title", F.coalesce("source", F.lit("none")).alias("source"), F.slice(F.split(F.coalesce("title", F.lit("")), " "), 1, 3).alias("words"))).alias("values"))
    return templates.rendered(rows.withColumn("template", F.lit(template)), "doc_id", strict=False)


#: Templates of some section types, as a caller would give them.
SECTION_TEMPLATES = [("hook", "Open with {title}, {minutes} minutes."), ("features", "{title} ({style}): name {points} points."), ("cta", "Close: {title}")]
STYLES = ("formal", "plain")


def sections_filled(spark, d):
    """Each section's prompt from the template of its type; the style is a default that some sections override."""
    text = lambda c: F.col(c).cast("string")
    given = F.create_map(F.lit("title"), text("title"), F.lit("minutes"), F.floor(F.col("duration_seconds") / 60).cast("string"), F.lit("points"), F.when(F.size("key_points") > 0, F.size("key_points")).cast("string"))
    given = F.when(F.col("section_id") % 2 == 0, F.map_concat(given, F.create_map(F.lit("style"), F.lit(STYLES[0])))).otherwise(given)
    rows = _sections(spark, d).select(F.col("section_id").alias("key"), "section_type", templates.completed(F.create_map(F.lit("style"), F.lit(STYLES[1])), given).alias("values"))
    return templates.filled(rows, spark.createDataFrame(SECTION_TEMPLATES, "section_type string, template string"), "section_type").withColumnRenamed("key", "section_id")


def html_blocks(spark, d):
    """Blocks parsed back from the html of blocks."""
    pages = _blocks(spark, d).where("html IS NOT NULL").select(F.col("block_id").alias("page_id"), "html")
    return html.page_blocks(pages).select("page_id", "block_no", "kind", "text")


def title_hash_groups(spark, d):
    return table(spark, d, "documents").where("title IS NOT NULL").groupBy(text_hash(F.col("title")).alias("hash")).agg(F.count(F.lit(1)).alias("documents"))


def site_analysis(spark, d):
    """Analysis of each site from its blocks' urls, html and selectors."""
    selector = lambda part: F.when(F.startswith("source_selector", F.lit(part)), F.col("source_selector"))
    rows = _blocks(spark, d).where("url IS NOT NULL").select(F.lower(netloc(F.col("url"))).alias("site"), "page_id", "url", "html", "text", selector("main").alias("main"), selector("nav").alias("navigation"))
    return snapshots.site_analysis(rows)


def html_structure(spark, d):
    """Parts and interactive elements of each block's html."""
    rows = _blocks(spark, d).where("html IS NOT NULL").select(F.col("block_id").alias("page_id"), "html")
    return html.pages(rows).select("page_id", "structure.main", "structure.navigation", "structure.tabs", F.size("links").alias("links"), F.size("tables").alias("tables"))


def section_contexts(spark, d):
    """The prompt variables of each product, from its pitch sections as features."""
    feature = F.struct(F.coalesce("title", F.lit("")).alias("name"), F.coalesce("content", F.lit("")).alias("description"), F.coalesce("key_points", F.array().cast("array<string>")).alias("benefits"))
    benefit = F.struct(F.coalesce("title", F.lit("")).alias("headline"), F.lit("").alias("description"))
    # the first ten of each product, ranked in salted parts first
    first = _sections(spark, d)
    for parts in (["product_id", F.pmod("section_id", F.lit(64))], ["product_id"]):
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*parts).orderBy("section_id"))).where("n <= 10")
    rows = first.groupBy(F.col("product_id").alias("product")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("section_id", feature.alias("f")))), lambda x: x["f"]).alias("features"), F.transform(F.array_sort(F.collect_list(F.struct("section_id", benefit.alias("b")))), lambda x: x["b"]).alias("benefits")
    )
    none = F.lit(None).cast("string")
    return assembly.context(rows.select("product", "features", "benefits", none.alias("audience"), none.alias("industry"), none.alias("company"), F.array().cast("array<string>").alias("pain_points")))


def feature_highlights(spark, d):
    rows = _sections(spark, d).where("content IS NOT NULL").select(F.col("pitch_id").alias("owner"), F.col("section_order").alias("pos"), F.concat_ws("-", "section_type", "section_id").alias("name"), F.col("content").alias("description"), F.col("key_points").alias("benefits"))
    return assembly.highlights(rows, 3)


QUERIES = {f.__name__: f for f in (
    snapshot_diff, snapshot_diff_counts, first_snapshots, visual_inventory, visual_totals, visual_candidates, image_files, mapping_validate, section_plan, pitch_markdown, pitch_text, pitch_totals, pitch_outline,
    pitch_slides, pitch_contents, assets_by_ids, pitch_calls, short_titles, template_history, template_variables, templates_rendered, sections_filled, html_blocks, title_hash_groups, site_analysis, html_structure, section_contexts, feature_highlights,
)}

from sheaf.plans.data_queries import _PAGES  # noqa: E402
from sheaf.plans.page_queries import _T, _has, _hash  # noqa: E402
from sheaf.functions import rules  # noqa: E402

_NEWEST = _PAGES + """, n AS (SELECT product_id, extraction_id, before, row_number() OVER (PARTITION BY product_id ORDER BY began DESC, extraction_id DESC) AS back FROM (SELECT s.*, k.began FROM snaps s JOIN (SELECT extraction_id, min(started_at) AS began FROM keyed GROUP BY 1) k USING (extraction_id))),
  a AS (SELECT p.product_id, url_key, hash FROM pages p JOIN n USING (product_id, extraction_id) WHERE back = 1), o AS (SELECT p.product_id, url_key, hash FROM pages p JOIN n USING (product_id, extraction_id) WHERE back = 2),
  f AS (SELECT coalesce(a.product_id, o.product_id) AS product_id, coalesce(a.url_key, o.url_key) AS url_key, CASE WHEN o.url_key IS NULL THEN 'added' WHEN a.url_key IS NULL THEN 'removed' WHEN a.hash <> o.hash THEN 'modified' ELSE 'unchanged' END AS status
    FROM a FULL JOIN o ON a.product_id = o.product_id AND a.url_key = o.url_key)"""
_INV = _IMG + ", " + _T.removeprefix(f"WITH {B}, ").replace("SELECT block_id, table_data", "SELECT extraction_id, block_id, table_data") + f""",
  p AS (SELECT b.extraction_id AS owner, substr(md5(i.url), 1, 12) AS asset_id, 'image' AS asset_type, CASE WHEN is_logo THEN 'logo' WHEN is_icon THEN 'icon' WHEN is_screenshot THEN 'screenshot' WHEN is_diagram THEN 'diagram' ELSE 'image' END AS kind, i.block_id, i.pos
      FROM i JOIN b ON b.block_id = i.block_id WHERE is_logo OR is_icon OR NOT (w > 0 AND h > 0 AND (w < 50 OR h < 50))
    UNION ALL SELECT extraction_id, substr(md5(array_to_string(heads, '|') || chr(10) || array_to_string(list_transform(rs[1:3], lambda r: array_to_string(r, '|')), chr(10))), 1, 12), 'table',
      CASE WHEN {_has('words', rules.PRICE_WORDS)} OR ({' + '.join(f"CAST(regexp_matches(lower(array_to_string(cells, ' ')), '{x}') AS INT)" for x in rules.PRICE_MARKS)}) >= 2 THEN 'price'
        WHEN {_has('words', rules.COMPARISON_WORDS)} OR (len(five) > 0 AND len(list_filter(five, lambda c: list_contains({rules.COMPARISON_CELLS}, lower(trim(c))))) * 10 > len(five) * 3) THEN 'comparison' ELSE 'table' END, block_id, 0 FROM t WHERE len(rs) > 0 AND (len(hd) > 0 OR len(rs) >= 2)),
  inv AS (SELECT owner, asset_id, asset_type, kind FROM p QUALIFY row_number() OVER (PARTITION BY owner, asset_id ORDER BY block_id, pos, asset_type) = 1)"""
_WORDS = r"len(regexp_extract_all({0}, '[^\t-\r ]+'))"

_PREFERRED = ", ".join(f"('{s}', '{k}', {i})" for s, kinds in visuals.PREFERRED.items() for i, k in enumerate(kinds))
_MOST = ", ".join(f"('{s}', {n})" for s, n in visuals.MOST.items())
_NAMES = ", ".join(f"('{s}')" for s in (*visuals.PREFERRED, "problem"))
_FULL = "SELECT owner, asset_id, asset_type, kind, block_id, pos FROM p QUALIFY row_number() OVER (PARTITION BY owner, asset_id ORDER BY block_id, pos, asset_type) = 1"
_SENTENCES = r"list_filter(string_split(regexp_replace(replace(coalesce({0}, ''), chr(10), chr(1)), '([.!?])[\t-\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0)"

ORACLE = {
    "visual_candidates": _INV + f""", v AS ({_FULL}), w AS (SELECT DISTINCT extraction_id AS owner, s.section_type FROM b, (VALUES {_NAMES}) s(section_type) WHERE extraction_id IS NOT NULL),
      top AS (SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY block_id, pos, asset_id) AS n FROM v QUALIFY n <= 10),
      liked AS (SELECT w.owner, w.section_type, asset_id, asset_type, pr.i, n FROM w JOIN (VALUES {_PREFERRED}) pr(section_type, kind, i) USING (section_type) JOIN top ON top.owner = w.owner AND top.kind = pr.kind),
      every AS (SELECT * FROM liked UNION ALL SELECT w.owner, w.section_type, asset_id, asset_type, 9, n FROM w JOIN top ON top.owner = w.owner AND top.kind = 'image' WHERE (w.owner, w.section_type) NOT IN (SELECT owner, section_type FROM liked)),
      r AS (SELECT owner, every.section_type, asset_id, asset_type, row_number() OVER (PARTITION BY owner, every.section_type ORDER BY i, n, asset_id) AS place, least(coalesce(m.most, 2), 3) AS most FROM every LEFT JOIN (VALUES {_MOST}) m(section_type, most) ON m.section_type = every.section_type)
      SELECT owner, section_type, asset_id, CAST(place AS INT) AS place, CASE WHEN place = 1 AND section_type IN ('hook', 'solution') THEN 'hero' WHEN asset_type = 'table' THEN 'comparison' ELSE 'inline' END AS placement FROM r WHERE place <= most""",
    "assets_by_ids": _INV + f""", v AS ({_FULL}), s AS (SELECT asset_id FROM v WHERE kind <> 'image')
      SELECT owner, asset_id, asset_type, CAST(row_number() OVER (PARTITION BY owner ORDER BY CASE asset_type WHEN 'image' THEN 1 ELSE 2 END, block_id, pos, asset_id) - 1 AS INT) AS place FROM v SEMI JOIN s USING (asset_id)""",
    "pitch_contents": f"""WITH {S}, o AS (SELECT pitch_id, section_order, section_id, coalesce(title, '') AS entry FROM s), e AS (SELECT DISTINCT pitch_id, -1000000 AS section_order, CAST(0 AS BIGINT) AS section_id, 'Executive Summary' AS entry FROM s
        UNION ALL SELECT * FROM o UNION ALL SELECT DISTINCT pitch_id, 1000000, CAST(0 AS BIGINT), 'Next Steps' FROM s WHERE section_type IN ('cta', 'call_to_action') AND len(key_points) > 0)
      SELECT pitch_id, CAST(row_number() OVER (PARTITION BY pitch_id ORDER BY section_order NULLS FIRST, section_id) AS INT) AS number, entry FROM e""",
    "pitch_slides": f"""WITH {S}, o AS (SELECT pitch_id, coalesce(title, '') AS title, CASE WHEN section_type IN ('cta', 'call_to_action') THEN 'cta' ELSE 'content' END AS kind,
        CAST(least(6, CASE WHEN len(key_points) > 0 THEN len(key_points) ELSE len({_SENTENCES.format('content')}) END) AS INT) AS bullets, CAST(length(array_to_string(list_filter(coalesce(talking_points, []), lambda x: x IS NOT NULL), chr(10))) AS INT) AS notes,
        row_number() OVER (PARTITION BY pitch_id ORDER BY CAST(coalesce(section_type IN ('cta', 'call_to_action'), false) AS INT), section_order, section_id) AS slide_no FROM s)
      SELECT pitch_id, CAST(slide_no AS INT) AS slide_no, kind, title, bullets, notes FROM o UNION ALL SELECT pitch_id, 0, 'title', title, 0, 0 FROM o WHERE slide_no = 1""",
    "snapshot_diff": _NEWEST + " SELECT product_id, url_key, status FROM f",
    "snapshot_diff_counts": _NEWEST + " SELECT status, count(*) AS pages FROM f GROUP BY status",
    "first_snapshots": _PAGES + ", c AS (SELECT product_id, extraction_id, min(started_at) AS began, count(*) AS added FROM pages GROUP BY ALL) SELECT product_id, added FROM c QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY began, extraction_id) = 1",
    "visual_inventory": _INV + " SELECT owner, asset_id, asset_type, kind FROM inv",
    "visual_totals": _INV + " SELECT owner, kind, count(*) AS assets FROM inv GROUP BY ALL",
    "image_files": _IMG + r""" SELECT DISTINCT url, substr(md5(url), 1, 12) || CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '\.[A-Za-z0-9]{1,5}$') THEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[A-Za-z0-9]{1,5})$', 1)) ELSE '.jpg' END AS file FROM i""",
    "templates_rendered": """WITH w AS (SELECT doc_id, title, source, string_split(coalesce(title, ''), ' ')[1:3] AS w FROM documents),
      t AS (SELECT doc_id, CASE WHEN title <> '' THEN '# ' || title ELSE '' END || chr(10) || chr(10) || array_to_string(list_transform(w, lambda x, i: trim((i - 1) || '. ' || x)), chr(10)) || chr(10) || 'Source: ' || coalesce(source, 'none') AS t FROM w)
      SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text, CAST(NULL AS VARCHAR) AS error FROM t""",
    "sections_filled": f"""WITH {S}, v AS (SELECT section_id, section_type, title, CAST(duration_seconds // 60 AS VARCHAR) AS minutes, CASE WHEN len(key_points) > 0 THEN CAST(len(key_points) AS VARCHAR) END AS points, CASE WHEN section_id % 2 = 0 THEN 'formal' ELSE 'plain' END AS style FROM s),
      x AS (SELECT section_id, CASE section_type WHEN 'hook' THEN 'Open with ' || title || ', ' || minutes || ' minutes.' WHEN 'features' THEN title || ' (' || style || '): name ' || points || ' points.' WHEN 'cta' THEN 'Close: ' || title END AS text,
        CASE section_type WHEN 'hook' THEN concat_ws(', ', CASE WHEN minutes IS NULL THEN 'minutes' END, CASE WHEN title IS NULL THEN 'title' END)
          WHEN 'features' THEN concat_ws(', ', CASE WHEN points IS NULL THEN 'points' END, CASE WHEN title IS NULL THEN 'title' END) WHEN 'cta' THEN CASE WHEN title IS NULL THEN 'title' ELSE '' END END AS m FROM v)
      SELECT section_id, text, CASE WHEN m IS NULL THEN 'no template' WHEN m <> '' THEN 'missing: ' || m END AS error FROM x""",
    "section_contexts": f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY section_id) AS n FROM s QUALIFY n <= 10),
      l AS (SELECT product_id, n, coalesce(title, '') AS name, n || '. ' || coalesce(title, '') || ': ' || coalesce(content, '') || CASE WHEN len(key_points) > 0 THEN chr(10) || '   Benefits: ' || array_to_string(key_points[1:2], ', ') ELSE '' END AS f FROM r)
      SELECT product_id AS product, 'general business audience' AS target_audience, 'general' AS industry, 'your company' AS company_name, 'common industry challenges' AS pain_points, string_agg(f, chr(10) ORDER BY n) AS features_list,
        string_agg(n || '. ' || name || ': ', chr(10) ORDER BY n) AS benefits_list, string_agg(name, ', ' ORDER BY n) FILTER (n <= 5) AS key_features FROM l GROUP BY product_id""",
    "section_plan": f"WITH {S} SELECT pitch_id, section_id, section_type FROM s WHERE section_type IS DISTINCT FROM 'pricing'",
    "pitch_markdown": f"""WITH {S}, t AS (SELECT pitch_id, section_order, section_id, '## ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '')
        || CASE WHEN len(key_points) > 0 THEN chr(10) || chr(10) || array_to_string(list_transform(key_points, lambda k: '- ' || coalesce(k, '')), chr(10)) ELSE '' END AS x FROM s)
      SELECT pitch_id, string_agg(x, chr(10) || chr(10) ORDER BY section_order, section_id) AS text FROM t GROUP BY pitch_id""",
    "pitch_text": f"WITH {S}, t AS (SELECT pitch_id, section_order, section_id, coalesce(title, '') || chr(10) || repeat('=', length(coalesce(title, ''))) || chr(10) || coalesce(content, '') AS x FROM s) SELECT pitch_id, string_agg(x, chr(10) || chr(10) ORDER BY section_order, section_id) AS text FROM t GROUP BY pitch_id",
    "pitch_totals": f"""WITH {S}, w AS (SELECT pitch_id, content, coalesce({_WORDS.format('content')}, 0) + coalesce(list_sum(list_transform(key_points, lambda k: coalesce({_WORDS.format('k')}, 0))), 0) AS n FROM s)
      SELECT pitch_id, count(*) AS sections, CAST(sum(n) AS BIGINT) AS words, round(sum(n) / 150, 2) AS minutes, round(avg(CAST(length(content) > 0 AS INT)), 4) AS confidence FROM w GROUP BY pitch_id""",
    "pitch_outline": f"""WITH {S}, o AS (SELECT pitch_id, coalesce(title, '') AS title, CASE WHEN section_type IN ('cta', 'call_to_action') THEN 'cta' ELSE 'content' END AS kind,
        row_number() OVER (PARTITION BY pitch_id ORDER BY CAST(coalesce(section_type IN ('cta', 'call_to_action'), false) AS INT), section_order, section_id) AS slide_no FROM s)
      SELECT pitch_id, CAST(slide_no AS INT) AS slide_no, kind, title FROM o UNION ALL SELECT pitch_id, 0, 'title', title FROM o WHERE slide_no = 1""",
    "pitch_calls": f"""WITH {S}, c AS (SELECT pitch_id, coalesce(key_points, []) AS k FROM s WHERE section_type IN ('cta', 'call_to_action') QUALIFY row_number() OVER (PARTITION BY pitch_id ORDER BY section_order, section_id) = 1)
      SELECT pitch_id, coalesce(k[1], 'Learn more') AS first_call, k[2] AS second_call, array_to_string(k[3:], ' | ') AS steps FROM c""",
    "short_titles": "SELECT doc_id, CASE WHEN length(title) > 20 THEN substr(title, 1, 17) || '...' ELSE title END AS title, concat_ws(' ', CAST('0x' || substr(md5(title), 1, 2) AS INT), CAST('0x' || substr(md5(title), 3, 2) AS INT), CAST('0x' || substr(md5(title), 5, 2) AS INT)) AS rgb FROM documents WHERE title IS NOT NULL",
    "template_history": f"WITH {S} SELECT section_type AS name, section_id AS seq, CAST(row_number() OVER (PARTITION BY section_type ORDER BY section_id DESC) - 1 AS INT) AS back, substr(sha256(section_type || ':' || section_id || ':' || coalesce(content, '')), 1, 12) AS hash FROM s",
    "template_variables": r"""WITH v AS (SELECT doc_id, regexp_extract_all('{{title}} {{lang}} {{title}} ' || text, '\{\{(?:#(?:if|each)\s+)?(\w+)\}\}', 1) AS v FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_sort(list_distinct(v)), ',') AS variables FROM v""",
    "feature_highlights": f"""WITH {S}, r AS (SELECT pitch_id AS owner, row_number() OVER (PARTITION BY pitch_id ORDER BY section_order, concat_ws('-', section_type, section_id)) AS place, concat_ws('-', section_type, section_id) AS name, substr(content, 1, 100) AS headline, coalesce(key_points[1], '') AS benefit FROM s WHERE content IS NOT NULL)
      SELECT owner, CAST(place AS INT) AS place, name, headline, benefit FROM r WHERE place <= 3""",
    "title_hash_groups": f"SELECT {_hash('title')} AS hash, count(*) AS documents FROM documents WHERE title IS NOT NULL GROUP BY 1",
}
ORACLE["mapping_validate"] = f"SELECT owner || '/' || section_type AS name, string_agg(asset_id, ',' ORDER BY place) AS asset_ids FROM ({ORACLE['visual_candidates']}) GROUP BY ALL"
