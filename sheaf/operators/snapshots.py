"""Pages and snapshots as wholes: crawl plans, fingerprints, line changes, media."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import fingerprints as fp
from sheaf.functions import rules, urls

# Pages of each kind in a crawl plan, in order of priority; pages in all; kinds left out.
PLAN = {"features": 10, "pricing": 2, "documentation": 5}
PLAN_PAGES = 20
LEFT_OUT = ("blog", "careers", "legal")


def crawl_plan(pages: DataFrame, most: int = PLAN_PAGES) -> DataFrame:
    """Pages to visit per site: site, path, place (from 1).

    pages has site, path, category and page_id (order of appearance). The plan is
    a top list per site, so no window keeps more than a few rows of a group, but
    ranks are computed in two steps: first within hashed parts of a site, then
    among the survivors, so that a very large site is ranked by many tasks.
    """
    part = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in PLAN]), F.col("category")), F.lit(0))
    part = F.when(part == 0, len(PLAN) + 1).otherwise(part)
    cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PLAN.items() for x in kv]), F.coalesce("category", F.lit(""))), F.lit(most))
    rows = pages.where(F.col("category").isNull() | ~F.col("category").isin(*LEFT_OUT)).select("site", "path", "page_id", part.alias("part"), cap.alias("cap"), (F.xxhash64("path") % 64).alias("salt"))
    salted = Window.partitionBy("site", "part", "salt").orderBy("page_id", "path")
    rows = rows.withColumn("n", F.row_number().over(salted)).where("n <= cap")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("site", "part").orderBy("page_id", "path"))).where("n <= cap")
    place = F.row_number().over(Window.partitionBy("site").orderBy("part", "n"))
    return rows.select("site", "path", place.alias("place")).where(F.col("place") <= most)


def page_fingerprints(blocks: DataFrame) -> DataFrame:
    """Fingerprint of each page from its blocks' hashes in page order (page_id, block_order, block_id, hash)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("block_order", "block_id", "hash"))), lambda x: x["hash"])
    none = F.array().cast("array<string>")
    return blocks.groupBy("page_id").agg(fp.page_fingerprint(F.lit(""), F.lit(""), listed, none).alias("fingerprint"))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    owner, digest = None, None
    for rows in batches:
        out = []
        for e, line in zip(rows["extraction_id"], rows["line"]):
            if digest is None or e != owner:
                out += [(owner, digest.hexdigest())] if digest else []
                owner, digest = e, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pd.DataFrame(out, columns=["extraction_id", "fingerprint"])
    if digest is not None:
        yield pd.DataFrame([(owner, digest.hexdigest())], columns=["extraction_id", "fingerprint"])


def snapshot_fingerprints(lines: DataFrame) -> DataFrame:
    """Fingerprint of each snapshot from its distinct lines (extraction_id, line) in order: a digest that takes them as a stream, none is held."""
    rows = lines.select("extraction_id", "line").distinct().repartition("extraction_id").sortWithinPartitions("extraction_id", "line")
    return rows.mapInPandas(_hashed, "extraction_id string, fingerprint string")


def enriched_media(images: DataFrame, sources: DataFrame) -> DataFrame:
    """Images completed by sources with the same url, else with the same url but for trailing slashes: local_path and file_size where the image has no local copy.

    Sources without a local copy complete nothing.
    """
    copies = sources.where("local_path IS NOT NULL")
    key = F.rtrim("url", F.lit("/"))
    least = F.min(F.struct("local_path", "file_size"))
    exact = copies.groupBy(F.col("url").alias("_u")).agg(least.alias("_e"))
    loose = copies.groupBy(key.alias("_k")).agg(least.alias("_l"))
    rows = images.join(exact, F.col("url") == F.col("_u"), "left").join(loose, key == F.col("_k"), "left").withColumn("_x", F.coalesce("_e", "_l"))
    bare = F.col("local_path").isNull() & F.col("_x").isNotNull()
    return rows.select("block_id", "pos", "url", F.coalesce("local_path", "_x.local_path").alias("local_path"), F.when(bare, F.col("_x.file_size")).otherwise(F.col("file_size")).alias("file_size"))


def block_changes(new: DataFrame, old: DataFrame, kept: int = 200) -> DataFrame:
    """Blocks of a page that are new or gone by their hash: page_id, change (new, removed), hash, text (cut to kept and an ellipsis).

    Both have page_id, hash and text; equal hashes of a page count once, with the least text.
    """
    side = lambda rows, sign: rows.groupBy("page_id", "hash").agg(F.min("text").alias("text")).withColumn("n", F.lit(sign))
    both = side(new, 1).unionByName(side(old, -1)).groupBy("page_id", "hash").agg(F.sum("n").alias("n"), F.min("text").alias("text")).where("n <> 0")
    text = F.when(F.length("text") > kept, F.concat(F.substring("text", 1, kept), F.lit("..."))).otherwise(F.col("text"))
    return both.select("page_id", F.when(F.col("n") > 0, "new").otherwise("removed").alias("change"), "hash", text.alias("text"))


def line_changes(pages: DataFrame) -> DataFrame:
    """Hashes of text lines new in or removed by the newest snapshot of each product: product_id, change, hash.

    A product with one snapshot has no rows. Blank lines and null texts don't count.
    """
    snaps = pages.groupBy("product_id", "extraction_id").agg(F.min("started_at").alias("_at"))
    back = F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("_at").desc(), F.col("extraction_id").desc()))
    two = snaps.select("product_id", "extraction_id", back.alias("back")).where("back <= 2")
    lines = pages.join(two, ["product_id", "extraction_id"]).select("product_id", "back", F.explode(F.split("page_text", "\n")).alias("line"))
    hashes = lines.where("trim(line) <> ''").select("product_id", fp.text_hash(F.col("line")).alias("hash"), (F.when(F.col("back") == 1, 1).otherwise(2)).alias("bit"))
    both = two.groupBy("product_id").agg(F.max("back").alias("n")).where("n = 2").select("product_id")
    seen = hashes.groupBy("product_id", "hash").agg(F.bit_or("bit").alias("seen")).where("seen < 3").join(both, "product_id", "left_semi")
    return seen.select("product_id", F.when(F.col("seen") == 1, "new").otherwise("removed").alias("change"), "hash")


def newest_diff(pages: DataFrame) -> DataFrame:
    """Pages of the newest two snapshots of each product by status: product_id, url_key, status.

    pages has one row per page of a snapshot (product_id, extraction_id,
    started_at, url_key, content_hash). With one snapshot every page is added.
    One grouped pass instead of a full join: each page has at most two rows.
    """
    snaps = pages.groupBy("product_id", "extraction_id").agg(F.min("started_at").alias("_at"))
    back = F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("_at").desc(), F.col("extraction_id").desc()))
    two = snaps.select("product_id", "extraction_id", back.alias("back")).where("back <= 2")
    rows = pages.join(two, ["product_id", "extraction_id"])
    sides = rows.groupBy("product_id", "url_key").agg(F.max(F.when(F.col("back") == 1, F.col("content_hash"))).alias("new"), F.max(F.when(F.col("back") == 2, F.col("content_hash"))).alias("old"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("old"), "modified").otherwise("unchanged")
    return sides.select("product_id", "url_key", status.alias("status"))


def site_analysis(pages: DataFrame) -> DataFrame:
    """One row per site (site, page_id, url, html, text, main, navigation by page or block): pages, categories, framework, loading, confidence.

    The framework is the first in the fixed order among those found on any page.
    """
    h = F.col("html")
    names = list(rules.SITE_FRAMEWORKS)
    found = rules.site_framework(h, F.col("text"))
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.when(found != "unknown", found))
    rows = pages.select("site", "page_id", urls.category(F.col("url")).alias("category"), F.when(rank > 0, rank).alias("rank"), F.coalesce(rules.lazy_marks(h), F.lit(0)).alias("lazy"), F.coalesce(rules.endless_scroll(h), F.lit(False)).alias("endless"), "main", "navigation")
    of = lambda c: F.countDistinct(F.when(F.col("category") == c, F.col("page_id")))
    sites = rows.groupBy("site").agg(
        F.countDistinct("page_id").alias("pages"), of("features").alias("feature_pages"), of("pricing").alias("price_pages"), of("documentation").alias("doc_pages"), F.min("rank").alias("rank"),
        (F.sum("lazy") > 3).alias("lazy_loading"), F.max("endless").alias("endless_scroll"), F.max("main").alias("main"), F.max("navigation").alias("navigation"),
    )
    framework = F.get(F.array(*[F.lit(n) for n in names]), (F.col("rank") - 1).cast("int"))
    confidence = urls.site_confidence(F.col("main"), F.col("navigation"), F.col("pages"), F.col("feature_pages"), framework)
    return sites.select("site", "pages", "feature_pages", "price_pages", "doc_pages", framework.alias("framework"), "lazy_loading", "endless_scroll", F.round(confidence, 4).alias("confidence"))
