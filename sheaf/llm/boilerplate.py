"""Main body of crawled pages by differencing pages with near urls.

Pages are numbered by host and url path over the whole cluster and cut into
stretches of STRETCH pages; each stretch also sees the NEIGHBOURS pages before and
after it, so every page meets the same neighbours whatever the partitions. Pages
are aligned by the longest common subsequence of their lines; a line that is
shared with enough neighbours is deleted. Lines of link paths, menus, counted
links and named rows of items are aligned by their slots, since their words change from
page to page.

What differencing deletes on several hosts, or what recurs on pages of several
hosts, is furniture on the pages, too, that have no near page to show it: wordings
are learned from the pages themselves, there are no lists of words or languages.
Only hashes of lines are shuffled. A block none of whose lines is left is furniture.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as _xxh64

from sheaf.functions.keys import host, url_key
from sheaf.session import small, stored

#: Pages on either side a page is aligned with, and how many must share a line to delete it.
NEIGHBOURS = 8
LEAST_SHARED = 2
#: Pages that are aligned together; at least NEIGHBOURS.
STRETCH = 512
#: A wording is learned if it recurs on LEAST_PAGES pages of enough hosts, or is deleted on enough hosts: LEAST_HOSTS and HOST_SHARE of all.
LEAST_PAGES, LEAST_HOSTS, HOST_SHARE = 3, 2, 0.002
#: Share of the hosts with a line above labels that must have it deleted somewhere for it to head a box of links.
BOX_SHARE = 0.05
#: Words of a label (link text, menu item), items of a link path or menu, and lines of a list of labels.
LABEL_WORDS, SLOT_ITEMS, LIST_LINES = 8, 3, 4

_WORDS = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_SENTENCE = re.compile(r"[.!?:;,]$|[.!?] ")
_SLOTS = re.compile(r"\s+[›>»/|·–-]+\s+|\s{2,}")
_PARTS = re.compile(r"\s+[|/·›>»–]\s+|\s{2,}|(?<=[.!?])\s+")
_CODE = re.compile(r"[{}=|]|\(\)|;\s*$")
_COUNTED = re.compile(r".*\(\d+\)")
_NAMED = re.compile(r"([^:,.]{1,30}):\s+[^:,.]+(?:,\s*[^:,.]+)+")
#: Bits of a line's flags; above them stands the number of its parts.
LABEL, UNCOUNTED = 1, 2
#: Different lines a worker remembers.
KEPT = 200_000


def _hash(text: str) -> int:
    return _xxh64(text.encode("utf-8", "replace")) - 2**63


def letters(text: str) -> str:
    return "".join(_WORDS.findall(text.lower()))


def is_label(line: str) -> bool:
    """Whether a line is short and no sentence."""
    return len(line.split(None, LABEL_WORDS)) <= LABEL_WORDS and not _SENTENCE.search(line.strip().rstrip("…"))


def slots(line: str, alone: bool) -> str | None:
    """The slots of a link path or menu (a line alone in its block), of a counted link, or of a named row of items; None for other lines."""
    bare = line.strip()
    if _COUNTED.fullmatch(bare):
        return "(0)"
    if alone and (named := _NAMED.fullmatch(bare)) and is_label(bare):
        return f"{letters(named[1])}:"
    items = [i for i in _SLOTS.split(bare) if i] if alone else ()
    return f"|{len(items)}" if len(items) >= SLOT_ITEMS and all(len(i.split()) <= LABEL_WORDS and not _SENTENCE.search(i) for i in items) else None


class Lines:
    """Keys, parts and flags of lines, remembered for lines that come again."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, bool], tuple[int, list[int], int]] = {}

    def of(self, line: str, alone: bool) -> tuple[int, list[int], int]:
        """The line's key for aligning, the keys of its parts (sentences, items) for learning, and its flags."""
        got = self.known.get((line, alone))
        if got is None:
            slot = slots(line, alone) if alone or line.rstrip().endswith(")") else None
            own = [x for p in _PARTS.split(line) if (x := letters(p))] if slot is None else [slot]
            key = _hash("".join(own))
            parts = [key] if len(own) == 1 else [_hash(x) for x in own]
            got = key, parts, (LABEL if is_label(line) else 0) | (UNCOUNTED if _CODE.search(line) and not slot else 0) | len(parts) << 2
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[line, alone] = got
        return got


def lettered(text: str) -> list[str]:
    """The lines of a text that hold a letter."""
    return [x for x in text.split("\n") if _LETTER.search(x)]


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as keys, parts and flags of their lines (binary)."""
    lines = Lines()
    for rows in batches:
        keys, parts, flags = [], [], []
        for text in rows["text"]:
            own = lettered(text) if text else []
            got = [lines.of(x, "\n" not in text) for x in own]
            keys.append(np.array([g[0] for g in got], np.int64).tobytes())
            parts.append(np.array([p for g in got for p in g[1]], np.int64).tobytes())
            flags.append(np.array([g[2] for g in got], np.uint32).tobytes())
        yield rows.drop(columns="text").assign(keys=keys, parts=parts, flags=flags)


#: Matching pairs of lines from which bit vectors are used, and bits of them that are held at once.
MANY_MATCHES, HELD_BITS = 50_000, 400_000_000


def positions(b: list[int]) -> dict[int, list[int]]:
    """Where each line stands, last place first."""
    where: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    return where


def common_lines(a: list[int], b: list[int], where: dict[int, list[int]]) -> tuple[list[int], list[int]]:
    """Positions in a and in b of a longest common subsequence (exact); where: positions(b).

    Lines that match seldom go by increasing runs of matches; pages that repeat
    one line thousands of times go by bit vectors.
    """
    if len(a) * len(b) > MANY_MATCHES and sum(len(where.get(x, ())) for x in a) > MANY_MATCHES:
        pairs = _dense(a, b)
        return [i for i, _ in pairs], [j for _, j in pairs]
    ends: list[int] = []
    links: list[tuple | None] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k] = j
                links[k] = link
    at_a, at_b = [], []
    link = links[-1] if links else None
    while link:
        at_a.append(link[0])
        at_b.append(link[1])
        link = link[2]
    return at_a[::-1], at_b[::-1]


def _bit_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of a, a number with a zero bit wherever a longer common subsequence ends in b."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of a and each beginning of b."""
    v = (1 << len(b)) - 1
    for v in _bit_rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _dense(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence by bit vectors; halved where they would take too much memory."""
    if len(a) > 1 and len(a) * len(b) > HELD_BITS:
        mid = len(a) // 2
        cut = int(np.argmax(_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]))
        return _dense(a[:mid], b[:cut]) + [(i + mid, j + cut) for i, j in _dense(a[mid:], b[cut:])]
    rows = list(_bit_rows(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


class _Page:
    __slots__ = ("site", "core", "inside", "blocks", "keys", "spans", "shared", "mates", "where")

    def __init__(self, site: int, core: bool, blocks: list) -> None:
        self.site, self.core, self.inside = site, core, True
        seen = {b["block_id"]: b for b in sorted(blocks, key=lambda b: (b["block_order"] is None, b["block_order"] or 0, b["block_id"]))}
        self.blocks = list(seen.values())
        self.keys: list[int] = []
        self.spans: list[tuple[int, int]] = []
        for b in self.blocks:
            start = len(self.keys)
            self.keys += np.frombuffer(b["keys"], np.int64).tolist()
            self.spans.append((start, len(self.keys)))
        self.shared = [0] * len(self.keys)
        self.mates = 0
        self.where = positions(self.keys)

    def align(self, other: _Page) -> None:
        self.mates += 1
        other.mates += 1
        for mine, theirs in zip(*common_lines(self.keys, other.keys, other.where)):
            self.shared[mine] += 1
            other.shared[theirs] += 1


#: One row per block with its verdict (furniture null: up to the wordings), its deleted lines and the parts of the rest;
#: and one row per wording of a site in a stretch (block_id null).
_ALIGNED = "block_id long, page_id long, furniture boolean, gone array<int>, part array<long>, mark array<int>, site long, wording long, pages int, deleted boolean"
_COLUMNS = [c.split()[0] for c in _ALIGNED.split(", ")]
#: Bits of mark: the part stands in a line that is left, in a label, in the first line.
LEFT, IN_LABEL, FIRST = 1, 2, 4


def _judged(page_id: int, page: _Page, pages_of: dict, deleted_of: set, out: list) -> None:
    """The blocks of a page after differencing; the wordings are counted once a page."""
    need0 = min(LEAST_SHARED, max(1, page.mates))
    own: set[int] = set()
    for b, (start, end) in zip(page.blocks, page.spans):
        shares, flags = page.shared[start:end], np.frombuffer(b["flags"], np.uint32).tolist()
        if not shares or b["heading"] and len(shares) == 1:  # titles repeat on a site without being furniture
            out.append((b["block_id"], page_id, False, [], [], [], page.site))
            continue
        need = 1 if len(shares) >= LIST_LINES and all(f & LABEL for f in flags) else need0
        parts, at, part, mark = np.frombuffer(b["parts"], np.int64).tolist(), 0, [], []
        for n, (share, f) in enumerate(zip(shares, flags)):
            mine, at = parts[at : at + (f >> 2)], at + (f >> 2)
            if not f & UNCOUNTED:
                own.update(mine)
                if share >= need0:
                    deleted_of.update((page.site, p) for p in mine)
            left = LEFT if share < need else 0
            if left or not n:
                bits = left | (IN_LABEL if f & LABEL else 0) | (0 if n else FIRST)
                known = mine if mine and not f & UNCOUNTED else [None]
                part += known
                mark += [bits] * len(known)
        left = any(m & LEFT for m in mark)
        out.append((b["block_id"], page_id, None if left else True, [n for n, s in enumerate(shares) if s >= need0], part if left else [], mark if left else [], page.site))
    for p in own:
        pages_of[page.site, p] = pages_of.get((page.site, p), 0) + 1


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages sorted by stretch and place, aligned within their sites; only a stretch's own pages come out."""
    window: deque[tuple[int, _Page]] = deque()
    stretch = site = None
    pages_of: dict[tuple[int, int], int] = {}
    deleted_of: set[tuple[int, int]] = set()
    cut: set[int] = set()

    def close(out: list) -> None:
        while window:
            finish(*window.popleft(), out)

    def finish(page_id: int, page: _Page, out: list) -> None:
        if page.core:
            _judged(page_id, page, pages_of, deleted_of, out)
        else:
            cut.add(page.site)

    def wordings() -> list:
        """Counts of the stretch; those of a site that lies in it as a whole only if they are enough."""
        rows = [
            (s, p, n, (s, p) in deleted_of) for (s, p), n in pages_of.items() if s in cut or n >= LEAST_PAGES or (s, p) in deleted_of
        ]
        pages_of.clear()
        deleted_of.clear()
        cut.clear()
        return rows

    def frame(out: list, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(*o, None, None, None) for o in out] + [(None, None, None, None, None, None, *r) for r in rows], columns=_COLUMNS, dtype=object)

    for batch in batches:
        out: list = []
        rows: list = []
        for k, s, page_id, core, blocks in zip(batch["stretch"], batch["site"], batch["page_id"], batch["core"], batch["blocks"]):
            if k != stretch or s != site:
                close(out)
                if k != stretch:
                    rows += wordings()
                stretch, site = k, s
            page = _Page(s, core, blocks)
            for _, other in window:
                if page.core or other.core:
                    page.align(other)
            window.append((page_id, page))
            if len(window) > NEIGHBOURS:
                finish(*window.popleft(), out)
        yield frame(out, rows)
    out = []
    close(out)
    yield frame(out, wordings())


def _pages(blocks: DataFrame) -> DataFrame:
    """Pages with their encoded blocks: site, path, page_id, _loose, blocks."""
    heading = F.coalesce(F.col("content_type") == "heading", F.lit(False)) | F.coalesce(F.col("source_selector").rlike("^h[1-6]$"), F.lit(False))
    home = host(F.col("url"))
    path = F.regexp_replace(url_key(F.col("url")), r"^[a-z+.-]*://[^/?]*|\?.*$", "")
    loose = F.when(F.col("page_id").isNull(), F.coalesce(url_key(F.col("url")), F.col("block_id").cast("string")))
    rows = blocks.select("block_id", "page_id", loose.alias("_loose"), "extraction_id", home.alias("host"), path.alias("path"), "block_order", heading.alias("heading"), "text")
    kinds = "block_id long, page_id long, _loose string, extraction_id string, host string, path string, block_order int, heading boolean, keys binary, parts binary, flags binary"
    encoded = rows.withColumn("block_id", F.col("block_id").cast("long")).withColumn("page_id", F.col("page_id").cast("long")).withColumn("block_order", F.col("block_order").cast("int")).mapInPandas(_encoded, kinds)
    key = F.when(F.col("path").isNotNull(), F.struct("host", "path"))
    pages = encoded.groupBy("page_id", "_loose").agg(
        F.min(key).alias("key"), F.min("extraction_id").alias("extraction_id"), F.collect_list(F.struct("block_id", "block_order", "heading", "keys", "parts", "flags")).alias("blocks")
    )
    sites = blocks.where("url IS NOT NULL").groupBy("extraction_id").agg(F.min(home).alias("_host"))
    homeless = pages.where("key IS NULL").join(sites, "extraction_id", "left")
    housed = pages.where("key IS NOT NULL").withColumn("_host", F.lit(None).cast("string"))
    return housed.unionByName(homeless).select(
        F.xxhash64(F.coalesce("key.host", "_host", "extraction_id", F.lit(""))).alias("site"), F.coalesce("key.path", F.lit("")).alias("path"), "page_id", "_loose", "blocks"
    )


def _stretches(pages: DataFrame) -> DataFrame:
    """Pages by stretch of the order of site and path: stretch, place, core, site, page_id, blocks; neighbours across a stretch's ends come with core false."""
    order = ["site", "path", "page_id", "_loose"]
    ranged = pages.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("_n"), "site", "page_id", "blocks")
    ranged = stored(ranged, "pages")
    part = F.shiftright("_n", 33)
    sizes = ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # one row per partition
    before, total = {}, 0
    for r in sizes:
        before[r.p], total = total, total + r.n
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0))
    place = (F.element_at(starts, part) + F.col("_n").bitwiseAND((1 << 33) - 1)).cast("long")
    near = F.array_distinct(F.array(*[F.floor((F.col("place") + d) / STRETCH) for d in (-NEIGHBOURS, 0, NEIGHBOURS)]))
    rows = ranged.withColumn("place", place).select("*", F.explode(near).alias("stretch")).where("stretch >= 0")
    return rows.select("stretch", "place", (F.floor(F.col("place") / STRETCH) == F.col("stretch")).alias("core"), "site", "page_id", "blocks")


def judged_blocks(blocks: DataFrame) -> DataFrame:
    """Every block once: block_id, page_id, furniture, gone (numbers of its lettered lines that differencing deletes)."""
    rows = _stretches(_pages(blocks)).repartition("stretch").sortWithinPartitions("stretch", "place")
    aligned = stored(rows.select("stretch", "site", "page_id", "core", "blocks").mapInPandas(_aligned, _ALIGNED), "aligned")
    by_site = aligned.where("block_id IS NULL").groupBy("wording", "site").agg(F.sum("pages").alias("pages"), F.max("deleted").alias("deleted"))
    counts = by_site.groupBy("wording").agg(F.count_if(F.col("pages") >= LEAST_PAGES).alias("n"), F.count_if("deleted").alias("d"))
    enough = max(LEAST_HOSTS, HOST_SHARE * aligned.where("block_id IS NOT NULL").select("site").distinct().count())
    learned = stored(counts.where((F.col("n") >= enough) | (F.col("d") >= enough)).select("wording", F.when(F.col("d") >= enough, F.col("d")).alias("d")), "wordings")
    done = aligned.where("block_id IS NOT NULL")
    open_parts = done.where("furniture IS NULL").select("block_id", "site", F.explode(F.arrays_zip("part", "mark")).alias("x")).select("block_id", "site", F.col("x.part").alias("wording"), F.col("x.mark").alias("mark"))
    known = open_parts.join(small(learned.withColumn("_learned", F.lit(True))), "wording", "left")
    bit = lambda b: F.col("mark").bitwiseAND(b) != 0
    # the first line of a box of links: of the hosts that have it, enough have it deleted
    heads = known.where(bit(FIRST) & F.col("d").isNotNull()).groupBy("wording", "d").agg(F.countDistinct("site").alias("hosts"))
    boxes = stored(heads.where(F.col("d") >= BOX_SHARE * F.col("hosts")).select("wording", F.lit(True).alias("box")), "boxes")
    known = known.join(small(boxes), "wording", "left")
    strange = F.col("_learned").isNull() & bit(LEFT)
    verdict = known.groupBy("block_id").agg(
        F.count_if(strange).alias("strange"), F.count_if(strange & ~bit(IN_LABEL)).alias("prose"), F.count_if(bit(FIRST) & ~F.coalesce("box", F.lit(False))).alias("odd"), F.count_if(~bit(FIRST)).alias("more")
    )
    learned_too = verdict.where("strange = 0 OR (prose = 0 AND odd = 0 AND more > 0)").select("block_id")
    late = done.where("furniture IS NULL").select("block_id", "page_id", "gone").join(learned_too.withColumn("_f", F.lit(True)), "block_id", "left")
    return done.where("furniture IS NOT NULL").select("block_id", "page_id", "furniture", "gone").unionByName(late.select("block_id", "page_id", F.coalesce("_f", F.lit(False)).alias("furniture"), "gone"))


def _kept_lines(text: Column, gone: Column) -> Column:
    """A text without the lettered lines of the given numbers."""
    lines = F.split(text, "\n", -1)
    numbered = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: F.struct(
            (acc["n"] + F.regexp_like(x, F.lit(r"\p{L}")).cast("int")).alias("n"),
            F.when(F.regexp_like(x, F.lit(r"\p{L}")) & F.array_contains(gone, acc["n"]), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"),
        ),
    )
    return F.array_join(numbered["kept"], "\n")


def page_bodies(blocks: DataFrame) -> DataFrame:
    """Every block once: block_id, page_id, furniture, body.

    body is the text without deleted lines, null for furniture. Pages are told by
    page_id, their site and path by the least url among their blocks; a page
    without any belongs to the site of its extraction_id. Blocks with null page_id form one
    page per url, without url each its own. Null and empty texts are no furniture and stay. Blocks
    sent twice count once; an empty table gives no rows.
    """
    judged = judged_blocks(blocks)
    texts = blocks.select("block_id", "text", (F.coalesce(F.col("content_type") == "heading", F.lit(False)) | F.coalesce(F.col("source_selector").rlike("^h[1-6]$"), F.lit(False))).alias("_heading"))
    whole = judged.join(texts.dropDuplicates(["block_id"]), "block_id")
    body = F.when(F.col("furniture"), None).when((F.size("gone") == 0) | F.col("_heading"), F.col("text")).otherwise(_kept_lines(F.col("text"), F.col("gone")))
    return whole.select("block_id", "page_id", "furniture", body.alias("body"))
