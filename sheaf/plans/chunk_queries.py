"""Queries that cut documents and snapshots into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import tables
from sheaf.operators import chunking
from sheaf.plans.page_queries import B
from sheaf.sources.tables import table


def _blocks(spark, d):
    text = chunking.block_text(F.col("content_type"), F.col("text"), F.col("heading_level"), F.col("list_items"), F.when(F.col("table_data").isNotNull(), tables.markdown(F.col("table_data"))))
    return table(spark, d, "content_blocks").dropDuplicates(["block_id"]).select("block_id", "extraction_id", "page_id", "block_order", "content_type", "heading_level", "text", text.alias("markdown"))


def chunk_sliding(spark, d):
    return chunking.sliding(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "total_chunks", "start", "end")


def _snapshot_texts(spark, d):
    """The pages of each snapshot in the order of their urls behind its product's name: extraction_id, place, text."""
    pages = table(spark, d, "snapshot_pages").where("url IS NOT NULL").groupBy("extraction_id", "url").agg(F.max_by("page_text", F.struct("extracted_at", "loaded_at", F.coalesce("page_text", F.lit("")))).alias("text"), F.min("product_name").alias("product_name"))
    titles = pages.groupBy("extraction_id").agg(F.min("product_name").alias("product_name")).where("product_name <> ''")
    return pages.select("extraction_id", F.concat(F.lit("p"), "url").alias("place"), "text").unionByName(titles.select("extraction_id", F.lit("").alias("place"), F.concat(F.lit("# "), "product_name").alias("text")))


def chunk_fixed(spark, d):
    """Fixed-size chunks of whole snapshots, with the number of urls that each goes with."""
    urls = table(spark, d, "snapshot_pages").groupBy("extraction_id").agg(F.countDistinct("url").alias("urls"))
    return chunking.fixed_snapshots(_snapshot_texts(spark, d)).select("extraction_id", "chunk_index", "start", "end", F.length("content").alias("chars")).join(urls, "extraction_id")


def chunk_windows(spark, d):
    return chunking.fixed(table(spark, d, "documents"), "doc_id", "text", 1000, 800)


def block_markdown(spark, d):
    return _blocks(spark, d).select("block_id", "markdown")


def chunk_sections(spark, d):
    return chunking.sections(_blocks(spark, d)).select("extraction_id", "section", "header", "content", "pages")


def chunk_packed(spark, d):
    return chunking.packed(chunking.sections(_blocks(spark, d)))


def chunk_hybrid(spark, d):
    return chunking.hybrid(chunking.sections(_blocks(spark, d))).select("extraction_id", "chunk_index", "content", F.array_join("headers", " | ").alias("headers"))


def chunk_by_page(spark, d):
    return chunking.by_page(_blocks(spark, d))


def page_texts(spark, d):
    return chunking.page_texts(_blocks(spark, d)).select("page_id", "text")


def chunks_combined(spark, d):
    return chunking.combined(table(spark, d, "content_chunks").dropDuplicates(["chunk_id"]))


def chunk_facts(spark, d):
    """Derived fields of stored chunks, with those that are stale."""
    from sheaf.functions.fingerprints import short_id, token_estimate

    c = table(spark, d, "content_chunks").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", F.length("content").alias("chars"), token_estimate(F.col("content")).alias("tokens"), short_id(F.col("content")).alias("hash"), F.coalesce(F.col("char_count") != F.length("content"), F.lit(True)).alias("stale"))


QUERIES = {f.__name__: f for f in (chunk_sliding, chunk_fixed, chunk_windows, block_markdown, chunk_sections, chunk_packed, chunk_hybrid, chunk_by_page, page_texts, chunks_combined, chunk_facts)}

_LINE = "('| ' || array_to_string(list_transform({0}, lambda c: coalesce(c, '')), ' | ') || ' |')"
_TABLE = (
    "array_to_string(list_concat(CASE WHEN len(table_data.headers) > 0 THEN [" + _LINE.format("table_data.headers") + ", '| ' || array_to_string(list_transform(table_data.headers, lambda x: '---'), ' | ') || ' |'] ELSE [] END, "
    "list_transform(list_filter(coalesce(table_data.rows, []), lambda r: r IS NOT NULL), lambda r: " + _LINE.format("r") + ")), chr(10))"
)
_MD = f"""CASE WHEN content_type = 'heading' THEN repeat('#', least(coalesce(heading_level, 2), 6)) || ' ' || text
  WHEN content_type = 'list' THEN array_to_string(list_transform(CASE WHEN len(list_items) > 0 THEN list_items ELSE [coalesce(text, '')] END, lambda x: '- ' || coalesce(x, '')), chr(10))
  WHEN content_type = 'table' AND table_data IS NOT NULL THEN {_TABLE} WHEN content_type = 'code' THEN '```' || chr(10) || text || chr(10) || '```' WHEN content_type = 'quote' THEN '> ' || text ELSE text END"""
_SECTIONS = f"""WITH RECURSIVE {B}, m AS (SELECT *, {_MD} AS md, CAST(coalesce(content_type = 'heading' AND heading_level IN (1, 2), false) AS INT) AS st FROM b),
  n AS (SELECT *, CAST(sum(st) OVER (PARTITION BY extraction_id ORDER BY page_id, block_order, block_id) AS BIGINT) AS section FROM m),
  s AS (SELECT extraction_id, section, CASE WHEN section = 0 THEN 'Introduction' ELSE coalesce(max(text) FILTER (st = 1), '') END AS header,
    string_agg(coalesce(md, ''), chr(10) || chr(10) ORDER BY page_id, block_order, block_id) FILTER (st = 0) AS content, count(DISTINCT page_id) AS pages FROM n GROUP BY extraction_id, section HAVING count(*) FILTER (st = 0) > 0)"""


def _rfind(mark: str, low: str) -> str:
    """Last place of a mark in t between low and e (0-based), -1 for none, by characters."""
    part = f"substr(t, {low} + 1, greatest(e - ({low}), 0))"
    return f"CASE WHEN contains({part}, {mark}) THEN {low} + length(regexp_extract({part}, '(?s)^(.*)' || regexp_escape({mark}), 1)) ELSE -1 END"


_NL = "chr(10)"
_ENDS = ["'. '", "'! '", "'? '", f"'.' || {_NL}", f"'!' || {_NL}", f"'?' || {_NL}"]
_BREAK = f"CASE WHEN e >= n THEN n WHEN {_rfind(f'({_NL} || {_NL})', 's')} > s + 500 THEN {_rfind(f'({_NL} || {_NL})', 's')} + 2 " + " ".join(f"WHEN {_rfind(f'({m})', 's + 500')} > 0 THEN least(e, {_rfind(f'({m})', 's + 500')} + 2)" for m in _ENDS) + f" WHEN {_rfind(chr(39) + ' ' + chr(39), 's + 500')} > 0 THEN {_rfind(chr(39) + ' ' + chr(39), 's + 500')} + 1 ELSE e END"

_GAP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"

ORACLE = {
    "chunk_sliding": f"""WITH RECURSIVE base AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE text IS NOT NULL),
      c AS (SELECT doc_id, 0 AS k, 0 AS s, CAST({_BREAK} AS INT) AS stop FROM (SELECT *, 0 AS s, 2000 AS e FROM base)
        UNION ALL SELECT doc_id, k + 1, s, CAST({_BREAK} AS INT) FROM (SELECT c.doc_id, c.k, c.stop - 200 AS s, c.stop - 200 + 2000 AS e, base.t, base.n FROM c JOIN base USING (doc_id) WHERE c.stop < base.n))
      SELECT doc_id, CAST(k AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks, CAST(s AS INT) AS start, stop AS "end" FROM c""",
    "chunk_fixed": f"""WITH RECURSIVE g AS (SELECT * FROM snapshot_pages WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY extraction_id, url ORDER BY extracted_at DESC, loaded_at DESC, coalesce(page_text, '') DESC) = 1),
      u AS (SELECT extraction_id, count(DISTINCT url) AS urls FROM snapshot_pages GROUP BY extraction_id),
      y AS (SELECT extraction_id, 'p' || url AS place, coalesce(page_text, '') AS t FROM g UNION ALL SELECT extraction_id, '', '# ' || min(product_name) FROM snapshot_pages WHERE url IS NOT NULL GROUP BY extraction_id HAVING min(product_name) <> ''),
      base AS (SELECT extraction_id, string_agg(t, {_GAP} ORDER BY place) AS t, length(string_agg(t, {_GAP} ORDER BY place)) AS n FROM y GROUP BY extraction_id),
      c AS (SELECT extraction_id, 0 AS k, 0 AS s, CAST({_BREAK} AS INT) AS stop FROM (SELECT *, 0 AS s, 2000 AS e FROM base)
        UNION ALL SELECT extraction_id, k + 1, s, CAST({_BREAK} AS INT) FROM (SELECT c.extraction_id, c.k, c.stop - 200 AS s, c.stop - 200 + 2000 AS e, base.t, base.n FROM c JOIN base USING (extraction_id) WHERE c.stop < base.n)),
      z AS (SELECT extraction_id, k, s, stop, n, substr(t, s + 1, stop - s) AS x FROM c JOIN base USING (extraction_id))
      SELECT extraction_id, CAST(k AS INT) AS chunk_index, CAST(s AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end",
        CAST(length(CASE WHEN n <= 2000 THEN x ELSE regexp_replace(x, '^[\\s\\x{{85}}\\p{{Z}}]+|[\\s\\x{{85}}\\p{{Z}}]+$', '', 'g') END) AS INT) AS chars, urls FROM z JOIN u USING (extraction_id)""",
    "chunk_by_page": f"""WITH RECURSIVE {B}, m AS (SELECT *, {_MD} AS md FROM b), base AS (SELECT extraction_id, page_id, t, length(t) AS n FROM (
        SELECT extraction_id, page_id, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY block_order, block_id) FILTER (length(md) > 0), '') AS t FROM m GROUP BY ALL)),
      c AS (SELECT extraction_id, page_id, 0 AS k, 0 AS s, CAST({_BREAK} AS INT) AS stop FROM (SELECT *, 0 AS s, 2000 AS e FROM base)
        UNION ALL SELECT extraction_id, page_id, k + 1, s, CAST({_BREAK} AS INT) FROM (SELECT c.extraction_id, c.page_id, c.k, c.stop - 200 AS s, c.stop - 200 + 2000 AS e, base.t, base.n FROM c JOIN base USING (extraction_id, page_id) WHERE c.stop < base.n))
      SELECT extraction_id, page_id, CAST(row_number() OVER (PARTITION BY extraction_id ORDER BY page_id, k) - 1 AS INT) AS chunk_index,
        CASE WHEN n <= 2000 THEN t ELSE regexp_replace(substr(t, s + 1, stop - s), '^[\\s\\x{{85}}\\p{{Z}}]+|[\\s\\x{{85}}\\p{{Z}}]+$', '', 'g') END AS content FROM c JOIN base USING (extraction_id, page_id)""",
    "chunk_windows": """WITH p AS (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS a FROM documents WHERE length(text) > 0)
      SELECT doc_id, CAST(a // 800 AS INT) AS chunk_index, substr(text, a + 1, 1000) AS content FROM p""",
    "block_markdown": f"WITH {B} SELECT block_id, {_MD} AS markdown FROM b",
    "chunk_sections": _SECTIONS + " SELECT extraction_id, section, header, content, pages FROM s",
    "chunk_packed": _SECTIONS + """, o AS (SELECT extraction_id, section, length(header) + length(content) + 7 AS len, row_number() OVER (PARTITION BY extraction_id ORDER BY section) AS i FROM s),
      f AS (SELECT extraction_id, section, i, len AS size, 0 AS chunk FROM o WHERE i = 1
        UNION ALL SELECT o.extraction_id, o.section, o.i, CASE WHEN f.size + o.len > 2000 THEN o.len ELSE f.size + o.len END, CASE WHEN f.size + o.len > 2000 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN o ON o.extraction_id = f.extraction_id AND o.i = f.i + 1)
      SELECT extraction_id, section, CAST(chunk AS INT) AS chunk_index FROM f""",
    "page_texts": f"WITH {B}, m AS (SELECT *, {_MD} AS md FROM b) SELECT page_id, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY block_order, block_id) FILTER (length(md) > 0), '') AS text FROM m GROUP BY page_id",
    "chunks_combined": """WITH c AS (SELECT * FROM content_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1)
      SELECT extraction_id, string_agg(CASE WHEN len(section_headers) > 0 THEN '[Sections: ' || array_to_string(section_headers, ', ') || ']' || chr(10) || content ELSE content END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index, chunk_id) AS text FROM c GROUP BY extraction_id""",
    "chunk_facts": """WITH c AS (SELECT * FROM content_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1)
      SELECT chunk_id, CAST(length(content) AS INT) AS chars, CAST(length(content) // 4 AS INT) AS tokens, substr(md5(content), 1, 12) AS hash, coalesce(char_count <> length(content), true) AS stale FROM c""",
}
