"""Typed content of HTML pages in one parse per page.

A small tolerant tree (implied end tags, void elements, raw text of scripts) is
built from the standard library's events; everything a page holds is read from
it at once: blocks, tables, images, links, metadata and JSON-LD. What needs a
browser (computed styles, natural image sizes, scripts) is not there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Open elements that a start tag ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}}
BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
# Elements and parts of class names whose content is left out.
LEFT_OUT_TAGS = frozenset("script style noscript iframe svg canvas nav".split())
LEFT_OUT_CLASSES = ("cookie", "banner", "popup", "modal", "overlay", "advertisement", "sidebar", "widget", "social-share", "newsletter", "comments")
HIDDEN_CLASSES = frozenset(("sr-only", "visually-hidden"))
# Least characters of each kind of block.
LEAST = {"heading": 2, "paragraph": 10, "item": 3, "quote": 10, "code": 5}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "seen", "heading", "previous", "images")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.seen, self.heading, self.previous, self.images = False, None, None, []

    def place(self) -> None:
        """Notes at each child element the last heading and the element before it, and the images among them; once."""
        if self.seen:
            return
        self.seen = True
        heading = previous = None
        for c in self.children:
            if isinstance(c, Node):
                c.heading, c.previous = heading, previous
                previous = c
                if c.tag in HEADINGS:
                    heading = c.text() or heading
                elif c.tag == "img":
                    self.images.append(c)

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, skip: Callable[[Node], bool] = lambda _: False) -> str:
        parts, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag == "br":
                parts.append("\n")
            elif not skip(n) and n.tag not in RAW:
                todo += reversed(n.children)
        return re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*", "\n", re.sub(r"[ \t\r\f\v]+", " ", "".join(parts))).strip()

    def above(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closing = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS_END_P else set())
        n = self.now
        scope = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}}.get(tag, {"table", "td", "div", "section", "article"} if closing else set())
        while closing and n.parent is not None and n.tag not in scope:
            if n.tag in closing:
                self.now = n.parent
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.now
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.now = n.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def left_out(n: Node) -> bool:
    """Whether an element itself is an excluded zone."""
    if n.tag in LEFT_OUT_TAGS or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true":
        return True
    if n.tag in ("header", "footer"):
        return not any(a.tag == "article" for a in n.above())
    own = n.attrs.get("class", "").lower()
    return bool(own) and (any(c in own for c in LEFT_OUT_CLASSES) or not HIDDEN_CLASSES.isdisjoint(own.split()))


def content_nodes(root: Node) -> list[Node]:
    """Elements outside of excluded zones, in document order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if not left_out(n):
            out.append(n)
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def _heading_before(n: Node) -> str | None:
    """The nearest heading among the siblings before an element."""
    if n.parent is None:
        return None
    n.parent.place()
    return n.heading


_DIGITS = re.compile(r"[0-9]{1,9}")
#: Columns a cell spans at most, as in the HTML standard.
MOST_COLUMNS = 1000


def whole_number(text: str, otherwise: int) -> int:
    """An attribute's number in plain digits, else the value given."""
    return int(text) if _DIGITS.fullmatch(text) else otherwise


def absolute(base: str, url: str) -> str:
    """url against base; as it stands where it can't be read."""
    try:
        return urljoin(base, url)
    except ValueError:
        return url


def blocks_of(root: Node, base: str = "") -> list[dict]:
    """Blocks by kind (headings, paragraphs, lists, quotes, code, definitions), each kind in document order."""
    nodes = content_nodes(root)
    kinds: list[list[dict]] = [[] for _ in range(6)]
    for n in nodes:
        text = ""
        if n.tag in HEADINGS and len(text := n.text(left_out)) >= LEAST["heading"]:
            kinds[0].append({"kind": "heading", "text": text, "level": int(n.tag[1])})
        elif n.tag == "p" and len(text := n.text(left_out)) >= LEAST["paragraph"]:
            kinds[1].append({"kind": "paragraph", "text": text, "parent": _heading_before(n), "images": nearby_images(n, base)})
        elif n.tag in ("ul", "ol"):
            items = [t for c in n.children if isinstance(c, Node) and c.tag == "li" and len(t := c.text(left_out)) >= LEAST["item"]]
            if items:
                kinds[2].append({"kind": "list", "text": "\n".join(items), "items": items})
        elif n.tag == "blockquote" and len(text := n.text(left_out)) >= LEAST["quote"]:
            kinds[3].append({"kind": "quote", "text": text})
        elif (n.tag == "pre" or n.tag == "code" and n.parent.tag != "p") and len(text := n.text(left_out)) >= LEAST["code"]:
            kinds[4].append({"kind": "code", "text": text})
        elif n.tag == "dl":
            terms, term = [], ""
            for c in n.children:
                if isinstance(c, Node) and c.tag == "dt":
                    term = c.text(left_out)
                elif isinstance(c, Node) and c.tag == "dd":
                    terms.append(f"{term}: {c.text(left_out)}")
            if terms:
                kinds[5].append({"kind": "list", "text": "\n".join(terms), "items": terms})
    flat = [b for k in kinds for b in k]
    last = next((b["text"] for b in reversed(kinds[0])), None)
    return [b | {"parent": b.get("parent") or (last if b["kind"] != "heading" else None)} for b in flat]


def table_of(n: Node) -> dict:
    """Caption, headers and rows of a table; a cell that spans columns is repeated, empty rows are dropped."""
    rows, heads, caption = [], [], None
    for r in n.walk():
        if r.tag == "caption" and caption is None:
            caption = r.text(left_out)
        if r.tag != "tr" or next(a for a in r.above() if a.tag == "table") is not n:
            continue
        cells, named = [], False
        for c in r.children:
            if isinstance(c, Node) and c.tag in ("td", "th"):
                cells += [c.text(left_out)] * max(1, min(whole_number(c.attrs.get("colspan", ""), 1), MOST_COLUMNS))
                named |= c.tag == "th"
        in_head = any(a.tag == "thead" for a in r.above())
        if not heads and not rows and (in_head or named):
            heads = cells
        elif any(cells):
            rows.append(cells)
    width = len(heads) or max(map(len, rows), default=0)
    return {"caption": caption, "headers": heads, "rows": [(r + [""] * width)[:width] for r in rows]}


def images_of(root: Node, base: str) -> list[dict]:
    """Images with absolute urls, each url once: first source attribute that is set, a picture's last candidate, captions of figures."""
    out: dict[str, dict] = {}
    for n in root.walk():
        source = ""
        if n.tag == "img":
            source = next((v for a in ("src", "data-src", "data-lazy", "data-lazy-src", "data-original") if (v := n.attrs.get(a, "")) and not v.startswith("data:")), "")
        elif n.tag == "source" and n.parent.tag == "picture" and n.attrs.get("srcset"):
            source = (n.attrs["srcset"].split(",")[-1].split() or [""])[0]
        if source and not source.startswith("data:"):
            figure = next((a for a in n.above() if a.tag == "figure"), None)
            caption = next((c.text() for c in figure.walk() if c.tag == "figcaption"), None) if figure else None
            size = [whole_number(n.attrs.get(a, ""), 0) for a in ("width", "height")]
            names = f"{n.attrs.get('class', '')} {n.parent.attrs.get('class', '')}".strip()
            out.setdefault(absolute(base, source), {"alt": n.attrs.get("alt", ""), "classes": names, "width": size[0], "height": size[1], "caption": caption})
    return [{"url": u} | x for u, x in out.items()]


def links_of(root: Node, base: str) -> list[dict]:
    """All links with their kind, repeated ones too; a link that can't be read counts as internal."""
    out = []
    for n in root.walk():
        href = n.attrs.get("href", "").strip() if n.tag == "a" else ""
        if href and not href.startswith(("javascript:", "#")):
            try:
                url = urljoin(base, href)
                kind = "internal" if urlsplit(url).netloc in ("", urlsplit(base).netloc) else "external"
            except ValueError:
                url, kind = href, "internal"
            out.append({"url": url, "text": n.text(), "kind": kind})
    return out


def metadata_of(root: Node) -> dict:
    """title, description, keywords, canonical url, and the number of valid JSON-LD objects."""
    meta = {"title": None, "description": None, "keywords": [], "canonical": None, "json_ld": 0}
    for n in root.walk():
        name = n.attrs.get("name", "").lower()
        if n.tag == "title" and meta["title"] is None:
            meta["title"] = n.text()
        elif n.tag == "meta" and name == "description":
            meta["description"] = n.attrs.get("content")
        elif n.tag == "meta" and name == "keywords":
            meta["keywords"] = [k.strip() for k in n.attrs.get("content", "").split(",") if k.strip()]
        elif n.tag == "link" and n.attrs.get("rel") == "canonical":
            meta["canonical"] = n.attrs.get("href")
        elif n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                json.loads("".join(c for c in n.children if isinstance(c, str)))
                meta["json_ld"] += 1
            except ValueError:
                pass
    return meta


# Candidates for the parts of a page, in order; a name is a tag, ".x" a class, "#x" an id, "[role=x]" a role.
PARTS = {
    "navigation": ("nav", "[role=navigation]", ".navigation", ".nav", ".menu", "#nav"),
    "main": ("main", "[role=main]", "#main", "#content", ".content", "article"),
    "sidebar": ("aside", ".sidebar", "[role=complementary]", "#sidebar"),
    "footer": ("footer", "[role=contentinfo]", "#footer", ".footer"),
}
MAIN_CHARS = 100
# Marks of elements a visitor works with.
INTERACTIVE = {"tabs": ("[role=tab]", ".tab", ".tabs"), "accordions": ("details", ".accordion", ".collapse"), "modals": (".modal", "dialog", "[role=dialog]"), "cookies": (".cookie-banner", "#cookie-banner", ".cookie-consent", ".consent")}


def matches(n: Node, selector: str) -> bool:
    """Whether an element meets a simple selector: tag, .class, #id or [role=value]."""
    if selector.startswith("."):
        return selector[1:] in n.attrs.get("class", "").split()
    if selector.startswith("#"):
        return n.attrs.get("id") == selector[1:]
    if selector.startswith("[role="):
        return n.attrs.get("role") == selector[6:-1]
    return n.tag == selector


def structure_of(root: Node, base: str) -> dict:
    """The first selector found for each part (the main part needs some text), counts of interactive elements, and rooted tab links."""
    nodes = list(root.walk())
    out: dict = {}
    for part, selectors in PARTS.items():
        out[part] = next((s for s in selectors if any(matches(n, s) and (part != "main" or len(n.text()) > MAIN_CHARS) for n in nodes)), None)
    for kind, selectors in INTERACTIVE.items():
        out[kind] = sum(any(matches(n, s) for s in selectors) for n in nodes)
    inside = lambda n: any(matches(a, s) for a in (n, *n.above()) for s in INTERACTIVE["tabs"])
    out["tab_links"] = list(dict.fromkeys(absolute(base, n.attrs["href"]) for n in nodes if n.tag == "a" and n.attrs.get("href", "").startswith("/") and inside(n)))
    return out


def nearby_images(n: Node, base: str) -> list[str]:
    """Images that belong to an element: inside it, in a figure or card around it, or right before it; embedded data is no image."""
    found = [c for c in n.walk() if c.tag == "img"]
    p = n.parent
    if p is not None:
        p.place()
        if p.tag == "figure" or any(w in p.attrs.get("class", "").lower() for w in ("card", "feature", "item")):
            found += p.images
        if n.previous is not None and n.previous.tag in ("img", "figure"):
            found += [c for c in n.previous.walk() if c.tag == "img"]
    sources = [c.attrs.get("src") or c.attrs.get("data-src", "") for c in found]
    return list(dict.fromkeys(absolute(base, s) for s in sources if s and not s.startswith("data:")))


def parsed(html: str | None, url: str | None) -> dict:
    """Everything of a page; null and empty html give an empty page."""
    root = tree(html or "")
    base = url or ""
    tables = [table_of(n) for n in content_nodes(root) if n.tag == "table" and n.attrs.get("role") != "presentation"]
    return {"blocks": blocks_of(root, base), "tables": tables, "images": images_of(root, base), "links": links_of(root, base), "meta": metadata_of(root), "structure": structure_of(root, base)}


def parsed_or_error(html: str | None, url: str | None) -> tuple[dict, str | None]:
    """A page, or an empty one with the error that its html raised; so one page never fails a task."""
    try:
        return parsed(html, url), None
    except Exception as e:  # noqa: BLE001
        return parsed("", url), f"{type(e).__name__}: {e}"


_BLOCK = "struct<kind:string,text:string,level:int,items:array<string>,parent:string,images:array<string>>"
SCHEMA = (
    f"page_id long, url string, title string, description string, keywords array<string>, canonical string, json_ld int, blocks array<{_BLOCK}>, tables array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>, "
    "images array<struct<url:string,alt:string,classes:string,width:int,height:int,caption:string>>, links array<struct<url:string,text:string,kind:string>>, "
    "structure struct<navigation:string,main:string,sidebar:string,footer:string,tabs:int,accordions:int,modals:int,cookies:int,tab_links:array<string>>, error string"
)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    full = {"level": None, "items": None, "parent": None, "images": []}
    for rows in batches:
        out = []
        for i, url, html in zip(rows["page_id"], rows["url"], rows["html"]):
            p, error = parsed_or_error(html, url)
            m = p["meta"]
            out.append((i, url, m["title"], m["description"], m["keywords"], m["canonical"], m["json_ld"], [full | b for b in p["blocks"]], p["tables"], p["images"], p["links"], p["structure"], error))
        yield pd.DataFrame(out, columns=["page_id", "url", "title", "description", "keywords", "canonical", "json_ld", "blocks", "tables", "images", "links", "structure", "error"])


def pages(raw: DataFrame) -> DataFrame:
    """Parsed pages of (page_id, html and optionally url); error tells what a page raised, null for none."""
    url = F.col("url") if "url" in raw.columns else F.lit(None).cast("string")
    return raw.select("page_id", url.alias("url"), "html").mapInPandas(_parse, SCHEMA)


def page_blocks(raw: DataFrame) -> DataFrame:
    """The blocks of pages: page_id, block_no (from 0), kind, text, level, items, parent, images."""
    return pages(raw).select("page_id", F.posexplode("blocks").alias("block_no", "b")).select("page_id", "block_no", "b.*")
