"""Queries over HTML written out here, so that every rule of the parser has a row: the tables hold little markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import html

BASE = "https://a.example/docs/page"
#: Pages by number; they need no table.
CASES = {
    1: "<h2>First head</h2><p>A paragraph below it.</p><p>short</p><div hidden><p>Nobody sees this one.</p></div><p>Another <b>bold</b> paragraph &amp; more</p>",
    2: "<ul><li>item one</li><li>ab</li><li>item two<ul><li>inner item</li></ul></li></ul><ol><li>step one<li>step two</ol><dl><dt>Term</dt><dd>meaning</dd></dl>",
    3: "<blockquote>Words somebody said.</blockquote><pre><code>print('hello')</code></pre><p>Use <code>inline_code</code> here.</p><code>bare_code()</code>",
    4: "<nav><p>Menu of the whole site</p></nav><header><p>Header of the page</p></header><article><header><p>Header of an article</p></header></article><div class='cookie-banner'><p>We use cookies here.</p></div><footer><p>Footer of the page</p></footer>",
    5: "<p>Unclosed paragraph one<p>Unclosed paragraph two<div>loose</div><script>document.write('</p><p>Not a paragraph</p>')</script>",
    6: "<table><caption>Prices</caption><thead><tr><th>Plan</th><th>Price</th></tr></thead><tr><td>Small</td><td>1</td></tr><tr><td>Large</td></tr></table>",
    7: "<table><tr><th>A</th><th colspan=2>B</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td></td><td></td></tr></table><table role=presentation><tr><td>layout</td></tr></table>",
    8: "<table><tr><td>no</td><td>heads</td></tr><tr><td>at <span class='sr-only'>hidden</span>all</td><td colspan='²'>x</td></tr></table>",
    9: "<img src='/a.png' alt='A' width=30 height='²'><img src='data:image/png;base64,xx'><img data-src='lazy.png'><img src='/a.png' alt='again'>",
    10: "<figure><img src='f.jpg'><figcaption>A figure</figcaption></figure><picture><source srcset='small.webp 1x, large.webp 2x'></picture><img src='http://[bad'>",
}


def _pages(spark):
    return html.pages(spark.createDataFrame([(i, BASE, h) for i, h in CASES.items()], "page_id long, url string, html string"))


def html_case_blocks(spark, d):
    rows = _pages(spark).select("page_id", F.posexplode("blocks").alias("block_no", "b"))
    return rows.select("page_id", "block_no", "b.kind", "b.text", "b.level", "b.parent", F.array_join("b.items", "|").alias("items"))


def html_case_tables(spark, d):
    rows = _pages(spark).select("page_id", F.posexplode("tables").alias("table_no", "t"))
    cells = F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), "/")
    return rows.select("page_id", "table_no", "t.caption", F.array_join("t.headers", "|").alias("headers"), cells.alias("cells"))


def html_case_images(spark, d):
    rows = _pages(spark).select("page_id", F.posexplode("images").alias("image_no", "i"))
    return rows.select("page_id", "image_no", "i.url", "i.alt", "i.width", "i.height", "i.caption")


QUERIES = {f.__name__: f for f in (html_case_blocks, html_case_tables, html_case_images)}

_BLOCKS = [
    (1, 0, "heading", "First head", 2, None, None), (1, 1, "paragraph", "A paragraph below it.", None, "First head", None), (1, 2, "paragraph", "Another bold paragraph & more", None, "First head", None),
    (2, 0, "list", "item one\nitem twoinner item", None, None, "item one|item twoinner item"), (2, 1, "list", "inner item", None, None, "inner item"), (2, 2, "list", "step one\nstep two", None, None, "step one|step two"), (2, 3, "list", "Term: meaning", None, None, "Term: meaning"),
    (3, 0, "paragraph", "Use inline_code here.", None, None, None), (3, 1, "quote", "Words somebody said.", None, None, None), (3, 2, "code", "print('hello')", None, None, None), (3, 3, "code", "print('hello')", None, None, None), (3, 4, "code", "bare_code()", None, None, None),
    (4, 0, "paragraph", "Header of an article", None, None, None),
    (5, 0, "paragraph", "Unclosed paragraph one", None, None, None), (5, 1, "paragraph", "Unclosed paragraph two", None, None, None),
]
_TABLES = [(6, 0, "Prices", "Plan|Price", "Small|1/Large|"), (7, 0, None, "A|B|B", "1|2|3"), (8, 0, None, "", "no|heads/at all|x")]
_IMAGES = [
    (9, 0, "https://a.example/a.png", "A", 30, 0, None), (9, 1, "https://a.example/docs/lazy.png", "", 0, 0, None),
    (10, 0, "https://a.example/docs/f.jpg", "", 0, 0, "A figure"), (10, 1, "https://a.example/docs/large.webp", "", 0, 0, None), (10, 2, "http://[bad", "", 0, 0, None),
]


def _values(rows: list[tuple], columns: str) -> str:
    """Rows as SQL values."""
    def one(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


ORACLE = {
    "html_case_blocks": _values(_BLOCKS, "page_id, block_no, kind, text, level, parent, items"),
    "html_case_tables": _values(_TABLES, "page_id, table_no, caption, headers, cells"),
    "html_case_images": _values(_IMAGES, "page_id, image_no, url, alt, width, height, caption"),
}
