"""Queries over crawled pages: urls, links, fingerprints, classes, images, tables, totals."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sheaf.functions import fingerprints as fp
from sheaf.functions import rules, tables, urls
from sheaf.operators import snapshots
from sheaf.sources.tables import table

BASE = "https://base.example"
BASE_PATH = "/docs"
BASE_FILE = "/help/index.html"


def blocks(spark, d, *columns):
    """Each block once."""
    return table(spark, d, "content_blocks").dropDuplicates(["block_id"]).select("block_id", *columns)


def _page_urls(spark, d):
    return table(spark, d, "snapshot_pages").select("url").union(table(spark, d, "content_blocks").select("url")).where("url IS NOT NULL").distinct()


def url_normalized(spark, d):
    return _page_urls(spark, d).select("url", urls.normalized(F.col("url"), F.lit(BASE)).alias("normalized"))


def url_category(spark, d):
    return _page_urls(spark, d).select("url", urls.category(F.col("url")).alias("category"))


def url_child_filter(spark, d):
    u, p = F.col("url"), urls.path(F.col("url"))
    return _page_urls(spark, d).select(
        "url", urls.is_child_path(p, F.lit(BASE_PATH)).alias("below"), urls.is_child_path(p, F.lit(BASE_FILE)).alias("below_file"),
        urls.is_internal(u, F.lit("www.rofilu.example"), F.lit(BASE_PATH)).alias("internal"),
    )


def _links(spark, d):
    return blocks(spark, d, "page_id", "url", F.explode("links").alias("link")).where("link.url IS NOT NULL AND link.url <> ''")


def page_links(spark, d):
    kind = F.when(urls.netloc("link.url").isin("") | (F.lower(urls.netloc("link.url")) == F.lower(urls.netloc("url"))), "internal").otherwise("external")
    rows = _links(spark, d).where("url IS NOT NULL AND NOT startswith(link.url, 'javascript:') AND NOT startswith(link.url, '#')")
    return rows.groupBy("page_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("link.url").alias("distinct_links"))


def link_host_totals(spark, d):
    return _links(spark, d).groupBy(F.lower(urls.netloc(F.col("link.url"))).alias("host")).agg(F.count(F.lit(1)).alias("links"))


def crawl_plan(spark, d):
    """Per site the pages to visit: up to 10 feature, 2 price and 5 documentation pages, others up to 20, by first page_id."""
    pages = table(spark, d, "content_blocks").where("url IS NOT NULL").select("page_id", F.lower(urls.netloc(F.col("url"))).alias("site"), urls.normalized(F.col("url"), F.lit("")).alias("path"), urls.category(F.col("url")).alias("category"))
    first = pages.where("path <> ''").groupBy("site", "path", "category").agg(F.min("page_id").alias("page_id"))
    return snapshots.crawl_plan(first)


def site_confidence(spark, d):
    pages = table(spark, d, "content_blocks").where("url IS NOT NULL").select(F.lower(urls.netloc(F.col("url"))).alias("site"), "page_id", urls.category(F.col("url")).alias("category"), "source_selector")
    sites = pages.groupBy("site").agg(
        F.max(F.when(F.startswith("source_selector", F.lit("main")), F.col("source_selector"))).alias("main"), F.max(F.when(F.startswith("source_selector", F.lit("nav")), F.col("source_selector"))).alias("navigation"),
        F.countDistinct("page_id").alias("pages"), F.countDistinct(F.when(F.col("category") == "features", F.col("page_id"))).alias("feature_pages"),
    )
    return sites.select("site", F.round(urls.site_confidence(F.col("main"), F.col("navigation"), F.col("pages"), F.col("feature_pages"), F.lit(None).cast("string")), 4).alias("confidence"))


def text_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", fp.text_hash(F.col("text")).alias("hash"), fp.short_id(F.coalesce("url", F.lit(""))).alias("url_id"))


def exact_duplicates(spark, d):
    """Copies: every document whose hash an earlier one has, with that one."""
    docs = table(spark, d, "documents").select("doc_id", fp.text_hash(F.col("text")).alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "hash").where("doc_id <> first_id").select("doc_id", "first_id")


def title_rolling_hash(spark, d):
    return table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", fp.rolling_hash(F.col("title")).alias("hash"))


def block_hashes(spark, d):
    return blocks(spark, d, fp.block_hash(F.col("content_type"), F.col("text"), F.col("list_items")).alias("hash"))


def page_fingerprints(spark, d):
    rows = blocks(spark, d, "page_id", "block_order", fp.block_hash(F.col("content_type"), F.col("text"), F.col("list_items")).alias("hash"))
    return snapshots.page_fingerprints(rows)


def snapshot_fingerprints(spark, d):
    pages = table(spark, d, "snapshot_pages").select("extraction_id", F.concat_ws(":", F.coalesce("url", F.lit("")), fp.text_hash(F.col("page_text"))).alias("line"))
    return snapshots.snapshot_fingerprints(pages)


def block_classes(spark, d):
    return blocks(spark, d, "content_type", rules.content_class(F.col("content_type"), F.col("text"), F.col("parent_section")).alias("class"))


def class_counts(spark, d):
    return block_classes(spark, d).groupBy("class").count().withColumnRenamed("count", "blocks")


def _images(spark, d):
    m = F.col("m")
    rows = blocks(spark, d, "page_id", "block_order", F.posexplode("media_assets").alias("pos", "m")).where("m.url IS NOT NULL")
    return rows.select("block_id", "page_id", "block_order", "pos", "m.*", *rules.image_flags(m["source_selector"], m["url"]))


def image_flags(spark, d):
    return _images(spark, d).select("block_id", "pos", *rules.IMAGES)


def image_filter(spark, d):
    return _images(spark, d).select("block_id", "pos", rules.keeps_image(F.col("url"), F.col("width"), F.col("height")).alias("keeps"))


def image_first_of_page(spark, d):
    """Images of a page without repeats, the first stands."""
    w = Window.partitionBy("page_id", "url").orderBy(F.col("block_order").asc_nulls_last(), "block_id", "pos")
    return _images(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("page_id", "url", "block_id", "pos")


def media_enriched(spark, d):
    """Block images completed from the first image of the same url (without trailing slash) that has a local copy."""
    images = _images(spark, d)
    return snapshots.enriched_media(images.select("block_id", "pos", "url", "local_path", "file_size"), images.where("local_path IS NOT NULL").select("url", "local_path", "file_size"))


def frameworks(spark, d):
    h = F.col("html")
    rows = blocks(spark, d, "text", F.when(F.col("block_id") % 5 == 0, F.concat(F.lit('<div data-v-app>'), h)).when(F.col("block_id") % 5 == 1, F.concat(F.lit('<div id="root">'), h)).when(F.col("block_id") % 5 == 2, F.concat(F.lit('<div id="__next" data-reactroot>'), h)).otherwise(h).alias("html")).where("html IS NOT NULL")
    return rows.select("block_id", rules.framework(h).alias("framework"), rules.site_framework(h, F.col("text")).alias("site_framework"), (rules.lazy_marks(h) > 3).alias("lazy"), rules.endless_scroll(h).alias("endless"))


def _tables(spark, d, *columns: Column):
    return blocks(spark, d, "table_data").where("table_data IS NOT NULL").select("block_id", *columns)


def table_shapes(spark, d):
    t = F.col("table_data")
    return _tables(spark, d, F.to_json(tables.normalized_rows(t)).alias("rows"), tables.meaningful(t).alias("meaningful"), tables.kept(t).alias("kept"))


def table_kinds(spark, d):
    t = F.col("table_data")
    return _tables(spark, d, tables.is_comparison(t).alias("comparison"), tables.is_price_table(t).alias("price"), tables.is_offer(t).alias("offer"))


def table_markdown(spark, d):
    t = F.col("table_data")
    return _tables(spark, d, tables.markdown(t).alias("plain"), tables.escaped_markdown(t).alias("escaped"), tables.padded_markdown(t).alias("padded"))


def page_totals(spark, d):
    rows = blocks(spark, d, "extraction_id", "page_id", fp.words(F.col("text")).alias("words"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.coalesce(F.size("media_assets"), F.lit(0)).alias("images"), F.col("table_data").isNotNull().cast("int").alias("tables"))
    return rows.groupBy("extraction_id", "page_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("words").cast("long").alias("words"), F.floor(F.sum("chars") / 4).cast("long").alias("tokens"),
        F.sum(F.greatest("images", F.lit(0))).cast("long").alias("images"), F.sum("tables").cast("long").alias("tables"), (F.sum("words") > 50).alias("shown"),
    )


def site_totals(spark, d):
    pages = page_totals(spark, d)
    return pages.groupBy("extraction_id").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).alias(c) for c in ("blocks", "words", "images", "tables")], F.round(F.avg(F.col("shown").cast("int")), 4).alias("success_rate"))


def heading_carried(spark, d):
    """Each block with the last heading before it on its page."""
    w = Window.partitionBy("page_id").orderBy("block_order", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks(spark, d, "page_id", "block_order", F.when(F.col("content_type") == "heading", F.col("text")).alias("heading"))
    return rows.select("block_id", F.last("heading", ignorenulls=True).over(w).alias("section"))


def page_full_texts(spark, d):
    """All text of each page: of each block its text, then its list items."""
    b = blocks(spark, d, "page_id", "block_order", F.concat(F.array(F.nullif("text", F.lit(""))), F.coalesce("list_items", F.array().cast("array<string>"))).alias("t"))
    listed = F.array_sort(F.collect_list(F.struct("block_order", "block_id", F.array_compact("t").alias("t"))))
    rows = b.groupBy("page_id").agg(F.flatten(F.transform(listed, lambda x: x["t"])).alias("t")).where(F.size("t") > 0)
    return rows.select("page_id", F.array_join("t", "\n\n").alias("text"))


def page_headings(spark, d):
    rows = blocks(spark, d, "page_id", "block_order", "text").join(blocks(spark, d, "content_type").where("content_type = 'heading'").select("block_id"), "block_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("block_order", "block_id", "text")))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " | ").alias("headings"))


def latest_snapshot(spark, d):
    snaps = table(spark, d, "snapshot_pages").groupBy("product_id", "extraction_id").agg(F.min("started_at").alias("at"))
    return snaps.groupBy("product_id").agg(F.max_by("extraction_id", F.struct("at", "extraction_id")).alias("extraction_id"))


def block_diff(spark, d):
    """New and removed block hashes of the newest snapshot of each product, as line hashes of its pages."""
    return snapshots.line_changes(table(spark, d, "snapshot_pages"))


def clean_titles(spark, d):
    t = F.col("title")
    for mark in (" | ", " - ", " – "):
        t = F.substring_index(t, mark, 1)
    return table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", t.alias("title"))


QUERIES = {f.__name__: f for f in (
    url_normalized, url_category, url_child_filter, page_links, link_host_totals, crawl_plan, site_confidence, text_hashes, exact_duplicates, title_rolling_hash, block_hashes, page_fingerprints,
    snapshot_fingerprints, block_classes, class_counts, image_flags, image_filter, image_first_of_page, media_enriched, frameworks, table_shapes, table_kinds, table_markdown, page_totals, site_totals,
    heading_carried, page_headings, page_full_texts, latest_snapshot, block_diff, clean_titles,
)}


# --- the same in SQL

B = "b AS (SELECT * FROM content_blocks QUALIFY row_number() OVER (PARTITION BY block_id) = 1)"
U = "u AS (SELECT DISTINCT url FROM (SELECT url FROM snapshot_pages UNION ALL SELECT url FROM content_blocks) WHERE url IS NOT NULL)"


def _path(u: str) -> str:
    return rf"regexp_replace(regexp_replace({u}, '^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', ''), '[?#].*$', '')"


def _netloc(u: str) -> str:
    return rf"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def _category(u: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({_path(u)}), '{'|'.join(p)}') THEN '{n}'" for n, p in urls.CATEGORIES.items()) + " END"


def _normal(u: str, base: str) -> str:
    own = f"rtrim({_path(u)}, '/')"
    return f"CASE WHEN NOT regexp_matches({own}, '{urls.NO_PAGE}') THEN '{base}' || {own} END"


def _child(p: str, base: str) -> str:
    stem = base.rsplit(".", 1)[0]
    own = f"rtrim({p}, '/')"
    more = f" OR starts_with({own}, '{stem}/')" if stem != base else ""
    return f"({own} = '{base}' OR starts_with({own}, '{base}/'){more})"


def _hash(text: str, n: int = 16) -> str:
    return rf"substr(sha256(trim(regexp_replace(lower(coalesce({text}, '')), '[\t-\r \x{{85}}\p{{Z}}]+', ' ', 'g'))), 1, {n})"


_BLOCK_HASH = _hash("coalesce(content_type, '') || ':' || coalesce(text, '') || CASE WHEN len(list_items) > 0 THEN ':' || coalesce(list_aggregate(list_items, 'string_agg', '|'), '') ELSE '' END")
_LINKS = f"WITH {B}, l AS (SELECT page_id, url, unnest(links) AS link FROM b), k AS (SELECT page_id, url, link.url AS target FROM l WHERE link.url IS NOT NULL AND link.url <> '')"
_LOW = "lower(coalesce(text, '')) || ' ' || lower(coalesce(parent_section, ''))"
_CLASS = "CASE WHEN content_type = 'heading' THEN content_type " + " ".join(f"WHEN regexp_matches({_LOW}, '{rules.any_of(p)}') THEN '{n}'" for n, p in reversed(rules.CONTENT.items())) + " ELSE content_type END"
_IMG = f"""WITH {B}, e AS (SELECT block_id, page_id, block_order, unnest(media_assets) AS m, generate_subscripts(media_assets, 1) - 1 AS pos FROM b),
  i AS (SELECT block_id, page_id, block_order, CAST(pos AS INT) AS pos, m.url AS url, m.local_path AS local_path, m.file_size AS file_size, coalesce(m.width, 0) AS w, coalesce(m.height, 0) AS h, """ + ", ".join(
    f"regexp_matches(lower(coalesce(m.source_selector, '')) || lower(m.url), '{rules.any_of(p)}') AS {n}" for n, p in rules.IMAGES.items()
) + " FROM e WHERE m.url IS NOT NULL)"
_T = f"""WITH {B}, t0 AS (SELECT block_id, table_data.caption AS caption, coalesce(table_data.headers, []) AS hd,
    list_transform(list_filter(coalesce(table_data.rows, []), lambda r: r IS NOT NULL), lambda r: list_transform(r, lambda c: coalesce(c, ''))) AS rs FROM b WHERE table_data IS NOT NULL),
  t AS (SELECT *, list_transform(hd, lambda c: coalesce(c, '')) AS heads, flatten(rs) AS cells, flatten(rs[1:5]) AS five,
    lower(coalesce(caption, '') || chr(10) || array_to_string(list_transform(hd, lambda c: coalesce(c, '')), ' ')) AS words, CASE WHEN len(hd) > 0 THEN len(hd) ELSE coalesce(list_max(list_transform(rs, lambda r: len(r))), 0) END AS n FROM t0)"""


def _has(text: str, literals: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in literals) + ")"


def _row_md(r: str) -> str:
    return f"('| ' || array_to_string({r}, ' | ') || ' |')"


_RULE = "('| ' || array_to_string(list_transform(range({0}), lambda i: '---'), ' | ') || ' |')"
_FIT = "list_transform(range({1}), lambda i: coalesce({0}[i + 1], ''))"
_TOTALS = rf"""WITH {B}, r AS (SELECT extraction_id, page_id, coalesce(len(regexp_extract_all(text, '\S+')), 0) AS words, length(coalesce(text, '')) AS chars, coalesce(len(media_assets), 0) AS images, CAST(table_data IS NOT NULL AS INT) AS tables FROM b),
  p AS (SELECT extraction_id, page_id, count(*) AS blocks, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) // 4 AS BIGINT) AS tokens, CAST(sum(images) AS BIGINT) AS images, CAST(sum(tables) AS BIGINT) AS tables, sum(words) > 50 AS shown FROM r GROUP BY ALL)"""
_NEAR = "CASE WHEN block_id % 5 = 0 THEN '<div data-v-app>' || html WHEN block_id % 5 = 1 THEN '<div id=\"root\">' || html WHEN block_id % 5 = 2 THEN '<div id=\"__next\" data-reactroot>' || html ELSE html END"


def _first(classes: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(html, '{p}') THEN '{n}'" for n, p in classes.items()) + f" ELSE {other} END"


ORACLE = {
    "url_normalized": f"WITH {U} SELECT url, {_normal('url', BASE)} AS normalized FROM u",
    "url_category": f"WITH {U} SELECT url, {_category('url')} AS category FROM u",
    "url_child_filter": f"WITH {U} SELECT url, {_child(_path('url'), BASE_PATH)} AS below, {_child(_path('url'), BASE_FILE)} AS below_file, {_netloc('url')} IN ('', 'www.rofilu.example') AND {_child(_path('url'), BASE_PATH)} AS internal FROM u",
    "page_links": f"""{_LINKS} SELECT page_id, CASE WHEN {_netloc('target')} = '' OR lower({_netloc('target')}) = lower({_netloc('url')}) THEN 'internal' ELSE 'external' END AS kind,
        count(*) AS links, count(DISTINCT target) AS distinct_links FROM k WHERE url IS NOT NULL AND NOT starts_with(target, 'javascript:') AND NOT starts_with(target, '#') GROUP BY ALL""",
    "link_host_totals": f"{_LINKS} SELECT lower({_netloc('target')}) AS host, count(*) AS links FROM k GROUP BY ALL",
    "crawl_plan": f"""WITH p AS (SELECT lower({_netloc('url')}) AS site, {_normal('url', '')} AS path, {_category('url')} AS category, min(page_id) AS page_id FROM content_blocks WHERE url IS NOT NULL GROUP BY ALL),
      k AS (SELECT *, CASE category WHEN 'features' THEN 1 WHEN 'pricing' THEN 2 WHEN 'documentation' THEN 3 ELSE 4 END AS part FROM p WHERE path <> '' AND (category IS NULL OR category NOT IN ('blog', 'careers', 'legal'))),
      r AS (SELECT *, row_number() OVER (PARTITION BY site, part ORDER BY page_id, path) AS n FROM k),
      c AS (SELECT * FROM r WHERE n <= CASE part WHEN 1 THEN 10 WHEN 2 THEN 2 WHEN 3 THEN 5 ELSE 20 END),
      o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY part, n) AS place FROM c)
      SELECT site, path, CAST(place AS INT) AS place FROM o WHERE place <= 20""",
    "site_confidence": f"""WITH p AS (SELECT lower({_netloc('url')}) AS site, page_id, {_category('url')} AS category, source_selector AS s FROM content_blocks WHERE url IS NOT NULL)
      SELECT site, round(least(1.0, 0.5 + (CAST(count(*) FILTER (starts_with(s, 'main')) > 0 AS INT) + CAST(count(*) FILTER (starts_with(s, 'nav')) > 0 AS INT) + CAST(count(DISTINCT page_id) > 5 AS INT)
        + CAST(count(DISTINCT page_id) FILTER (category = 'features') > 0 AS INT)) / 10.0), 4) AS confidence FROM p GROUP BY site""",
    "text_hashes": f"SELECT doc_id, {_hash('text')} AS hash, substr(md5(coalesce(url, '')), 1, 12) AS url_id FROM documents",
    "exact_duplicates": f"WITH h AS (SELECT doc_id, {_hash('text')} AS hash FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY hash) AS first_id FROM h) SELECT doc_id, first_id FROM f WHERE doc_id <> first_id",
    "title_rolling_hash": """WITH h AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(title, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS u FROM documents WHERE title IS NOT NULL)
      SELECT doc_id, CASE WHEN u >= 2147483648 THEN '-' || lower(to_hex(4294967296 - u)) ELSE lower(to_hex(u)) END AS hash FROM h""",
    "block_hashes": f"WITH {B} SELECT block_id, {_BLOCK_HASH} AS hash FROM b",
    "page_fingerprints": f"WITH {B} SELECT page_id, substr(sha256('||' || string_agg({_BLOCK_HASH}, '|' ORDER BY block_order, block_id)), 1, 32) AS fingerprint FROM b GROUP BY page_id",
    "snapshot_fingerprints": f"WITH l AS (SELECT DISTINCT extraction_id, coalesce(url, '') || ':' || {_hash('page_text')} AS line FROM snapshot_pages) SELECT extraction_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM l GROUP BY extraction_id",
    "block_classes": f"WITH {B} SELECT block_id, content_type, {_CLASS} AS class FROM b",
    "class_counts": f"WITH {B} SELECT {_CLASS} AS class, count(*) AS blocks FROM b GROUP BY 1",
    "image_flags": _IMG + "SELECT block_id, pos, " + ", ".join(rules.IMAGES) + " FROM i",
    "image_filter": _IMG + f"""SELECT block_id, pos, CASE WHEN starts_with(url, 'data:') OR {_has('lower(url)', rules.TRACKING)} THEN false WHEN is_logo OR is_diagram OR is_screenshot THEN true
        WHEN is_icon AND w < 100 AND h < 100 THEN false ELSE NOT (w > 0 AND w < 50) AND NOT (h > 0 AND h < 50) END AS keeps FROM i""",
    "image_first_of_page": _IMG + "SELECT page_id, url, block_id, pos FROM i QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY block_order NULLS LAST, block_id, pos) = 1",
    "media_enriched": _IMG + """, c0 AS (SELECT * FROM i WHERE local_path IS NOT NULL), w AS (SELECT url AS u, min(struct_pack(p := local_path, s := file_size)) AS x FROM c0 GROUP BY 1), s0 AS (SELECT rtrim(url, '/') AS k, min(struct_pack(p := local_path, s := file_size)) AS y FROM c0 GROUP BY 1)
      SELECT block_id, pos, url, coalesce(local_path, x.p, y.p) AS local_path, CASE WHEN local_path IS NULL AND coalesce(x, y) IS NOT NULL THEN coalesce(x, y).s ELSE file_size END AS file_size FROM i LEFT JOIN w ON url = u LEFT JOIN s0 ON rtrim(url, '/') = k""",
    "page_full_texts": f"""WITH {B}, p AS (SELECT page_id, block_order, block_id, -1 AS n, text AS t FROM b WHERE text <> '' UNION ALL SELECT page_id, block_order, block_id, unnest(range(len(list_items))), unnest(list_items) FROM b)
      SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY block_order NULLS FIRST, block_id, n) AS text FROM p WHERE t IS NOT NULL GROUP BY page_id""",
    "frameworks": f"""WITH {B}, f AS (SELECT block_id, text, {_NEAR} AS html FROM b WHERE html IS NOT NULL)
      SELECT block_id, {_first(rules.FRAMEWORKS, f"CASE WHEN regexp_matches(html, '{rules.APP_ROOT}') THEN 'unknown' END")} AS framework,
        {_first(rules.SITE_FRAMEWORKS, "CASE WHEN length(trim(coalesce(text, ''))) < 500 THEN 'unknown' END")} AS site_framework,
        len(regexp_extract_all(html, '<img[^>]*(?:loading="lazy"|data-src|data-lazy)|class="[^"]*lazy')) > 3 AS lazy, regexp_matches(html, 'class="[^"]*(infinite|load-more)|data-infinite') AS endless FROM f""",
    "table_shapes": _T + f"""SELECT block_id, CAST(to_json(CASE WHEN n > 0 THEN list_transform(rs, lambda r: {_FIT.format('r', 'n')}) ELSE rs END) AS VARCHAR) AS rows,
        (CASE WHEN len(hd) > 0 THEN len(hd) ELSE coalesce(len(rs[1]), 0) END) >= 2 AND len(rs) >= 1 AND coalesce(list_sum(list_transform(cells, lambda c: length(trim(c)))), 0) >= 20 AS meaningful,
        len(rs) > 0 AND (len(hd) > 0 OR len(rs) >= 2) AS kept FROM t""",
    "table_kinds": _T + f"""SELECT block_id, {_has('words', rules.COMPARISON_WORDS)} OR (len(five) > 0 AND len(list_filter(five, lambda c: list_contains({rules.COMPARISON_CELLS}, lower(trim(c))))) * 10 > len(five) * 3) AS comparison,
        {_has('words', rules.PRICE_WORDS)} OR ({' + '.join(f"CAST(regexp_matches(lower(array_to_string(cells, ' ')), '{p}') AS INT)" for p in rules.PRICE_MARKS)}) >= 2 AS price,
        {_has('words', rules.OFFER_WORDS)} OR {_has("lower(array_to_string(cells, ' '))", rules.OFFER_MARKS)} AS offer FROM t""",
    "table_markdown": _T + f"""SELECT block_id,
        array_to_string(list_concat(CASE WHEN len(hd) > 0 THEN [{_row_md('heads')}, {_RULE.format('len(hd)')}] ELSE [] END, list_transform(rs, lambda r: {_row_md('r')})), chr(10)) AS plain,
        array_to_string(list_concat(CASE WHEN length(caption) > 0 THEN ['**' || caption || '**', ''] ELSE [] END, CASE WHEN len(hd) > 0 THEN [{_row_md('heads')}, {_RULE.format('len(hd)')}] WHEN len(rs) > 0 THEN [{_RULE.format('len(rs[1])')}] ELSE [] END,
          list_transform(rs, lambda r: {_row_md("list_transform(r, lambda c: replace(c, '|', chr(92) || '|'))")})), chr(10)) AS escaped,
        CASE WHEN len(hd) = 0 AND len(rs) = 0 THEN '' WHEN len(hd) > 0 THEN array_to_string(list_concat([{_row_md('heads')}, {_RULE.format('len(hd)')}], list_transform(rs, lambda r: {_row_md(_FIT.format('r', 'len(hd)'))})), chr(10))
          ELSE array_to_string(list_concat([{_row_md('rs[1]')}, {_RULE.format('len(rs[1])')}], list_transform(rs[2:], lambda r: {_row_md('r')})), chr(10)) END AS padded FROM t""",
    "page_totals": _TOTALS + "SELECT * FROM p",
    "site_totals": _TOTALS + "SELECT extraction_id, count(*) AS pages, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(words) AS BIGINT) AS words, CAST(sum(images) AS BIGINT) AS images, CAST(sum(tables) AS BIGINT) AS tables, round(avg(CAST(shown AS INT)), 4) AS success_rate FROM p GROUP BY ALL",
    "heading_carried": f"WITH {B} SELECT block_id, last_value(CASE WHEN content_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY block_order, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM b",
    "page_headings": f"WITH {B} SELECT page_id, string_agg(text, ' | ' ORDER BY block_order, block_id) AS headings FROM b WHERE content_type = 'heading' GROUP BY page_id",
    "latest_snapshot": "WITH s AS (SELECT product_id, extraction_id, min(started_at) AS began FROM snapshot_pages GROUP BY ALL) SELECT product_id, extraction_id FROM s QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY began DESC, extraction_id DESC) = 1",
    "block_diff": f"""WITH s AS (SELECT product_id, extraction_id, row_number() OVER (PARTITION BY product_id ORDER BY min(started_at) DESC, extraction_id DESC) AS back FROM snapshot_pages GROUP BY product_id, extraction_id),
      l AS (SELECT p.product_id, s.back, unnest(string_split(page_text, chr(10))) AS line FROM snapshot_pages p JOIN s USING (product_id, extraction_id) WHERE s.back <= 2 AND page_text IS NOT NULL),
      h AS (SELECT product_id, back, {_hash('line')} AS hash, min(line) AS line FROM l WHERE trim(line) <> '' GROUP BY ALL),
      two AS (SELECT product_id FROM s WHERE back = 2)
      SELECT a.product_id, 'new' AS change, a.hash FROM h a SEMI JOIN two USING (product_id) ANTI JOIN (SELECT * FROM h WHERE back = 2) o ON a.product_id = o.product_id AND a.hash = o.hash WHERE a.back = 1
      UNION ALL SELECT a.product_id, 'removed', a.hash FROM h a ANTI JOIN (SELECT * FROM h WHERE back = 1) o ON a.product_id = o.product_id AND a.hash = o.hash WHERE a.back = 2""",
    "clean_titles": "SELECT doc_id, string_split(string_split(string_split(title, ' | ')[1], ' - ')[1], ' – ')[1] AS title FROM documents WHERE title IS NOT NULL",
}
