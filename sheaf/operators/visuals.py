"""An inventory of visual assets, and which of them go with which section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import fingerprints as fp
from sheaf.functions import rules, tables

# Most assets of a section (2 where not named), and the kinds a section prefers, in order.
MOST = {"hook": 1, "problem": 1, "solution": 2, "features": 3, "benefits": 2, "use_cases": 2, "differentiators": 2, "social_proof": 3, "pricing": 1, "technical": 2, "roi": 1, "objection_handling": 1, "cta": 1, "closing": 1}
PREFERRED = {
    "hook": ["screenshot"], "solution": ["screenshot", "diagram"], "features": ["screenshot", "diagram"], "benefits": ["screenshot", "diagram"], "use_cases": ["screenshot"],
    "differentiators": ["comparison"], "social_proof": ["logo"], "pricing": ["price"], "technical": ["diagram"], "roi": ["diagram", "comparison"],
}
USUAL_MOST, GENERIC = 2, 10


def image_assets(blocks: DataFrame) -> DataFrame:
    """Images of blocks as assets: owner, asset_id, asset_type, url, text, kind, block_id, pos. Small images are skipped unless logos or icons."""
    m = F.col("m")
    rows = blocks.select(F.col("extraction_id").alias("owner"), "block_id", F.posexplode("media_assets").alias("pos", "m")).where("m.url IS NOT NULL")
    rows = rows.select("owner", "block_id", "pos", "m.*", *rules.image_flags(m["source_selector"], m["url"]))
    tiny = (F.col("width") > 0) & (F.col("height") > 0) & ((F.col("width") < 50) | (F.col("height") < 50))
    kept = rows.where(F.col("is_logo") | F.col("is_icon") | ~F.coalesce(tiny, F.lit(False)))
    kind = F.when(F.col("is_logo"), "logo").when(F.col("is_icon"), "icon").when(F.col("is_screenshot"), "screenshot").when(F.col("is_diagram"), "diagram").otherwise("image")
    about = F.concat_ws(" | ", "title", "alt_text", "caption")
    return kept.select("owner", fp.short_id(F.col("url")).alias("asset_id"), F.lit("image").alias("asset_type"), "url", about.alias("text"), kind.alias("kind"), "block_id", "pos")


def table_assets(blocks: DataFrame) -> DataFrame:
    """Tables of blocks as assets; their id is made of the headers' and the first three rows' cells."""
    t = F.col("table_data")
    rows = blocks.where(t.isNotNull()).select(F.col("extraction_id").alias("owner"), "block_id", "table_data").where(tables.kept(t))
    heads = tables.headers_of(t)
    named = F.concat(F.lit("Table: "), F.array_join(F.slice(heads, 1, 3), ", "), F.when(F.size(heads) > 3, "...").otherwise(""))
    caption = F.when(F.length(t["caption"]) > 0, t["caption"]).when(F.size(heads) > 0, named)
    cells = F.concat(F.array_join(heads, "|", ""), F.lit("\n"), F.array_join(F.transform(F.slice(tables.rows_of(t), 1, 3), lambda r: F.array_join(r, "|")), "\n"))
    kind = F.when(tables.is_price_table(t), "price").when(tables.is_comparison(t), "comparison").otherwise("table")
    return rows.select("owner", fp.short_id(cells).alias("asset_id"), F.lit("table").alias("asset_type"), F.lit("").alias("url"), caption.alias("text"), kind.alias("kind"), "block_id", F.lit(0).alias("pos"))


def inventory(blocks: DataFrame) -> DataFrame:
    """All assets, each asset_id of an owner once (the first place stands)."""
    rows = image_assets(blocks).unionByName(table_assets(blocks))
    first = F.min_by(F.struct("asset_type", "url", "text", "kind", "block_id", "pos"), F.struct("block_id", "pos", "asset_type"))
    return rows.groupBy("owner", "asset_id").agg(first.alias("x")).select("owner", "asset_id", "x.*")


def inventory_totals(assets: DataFrame) -> DataFrame:
    return assets.groupBy("owner", "kind").agg(F.count(F.lit(1)).alias("assets"))


def most_of(section: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MOST.items() for x in kv])
    return F.coalesce(F.element_at(known, section), F.lit(USUAL_MOST))


def candidates(sections: DataFrame, assets: DataFrame, most: int = 3) -> DataFrame:
    """The first assets of each preferred kind for each section: owner, section_type, asset_id, asset_type, place.

    sections has owner and section_type. Preferred kinds come in order, within a
    kind by block and position; without any, the first generic images. Ranks are
    cut to the most a section takes before anything is joined.
    """
    flat = [(s, k, i) for s, kinds in PREFERRED.items() for i, k in enumerate(kinds)]
    listed = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("k"), F.lit(i).alias("i")) for s, k, i in flat])
    order = Window.partitionBy("owner", "kind").orderBy("block_id", "pos", "asset_id")
    salted = Window.partitionBy("owner", "kind", F.col("block_id") % 64).orderBy("block_id", "pos", "asset_id")
    top = assets.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= GENERIC).withColumn("n", F.row_number().over(order)).where(F.col("n") <= GENERIC)
    wanted = sections.select("owner", "section_type").distinct()
    kinds = wanted.select("owner", "section_type", F.explode(F.filter(listed, lambda x: x["s"] == F.col("section_type"))).alias("x")).select("owner", "section_type", F.col("x.k").alias("kind"), F.col("x.i").alias("i"))
    liked = kinds.join(top, ["owner", "kind"])
    bare = wanted.join(liked.select("owner", "section_type").distinct(), ["owner", "section_type"], "left_anti")
    generic = bare.join(top.where("kind = 'image'"), "owner").withColumn("i", F.lit(9))
    rows = liked.select("owner", "section_type", "asset_id", "asset_type", "i", "n").unionByName(generic.select("owner", "section_type", "asset_id", "asset_type", "i", "n"))
    place = F.row_number().over(Window.partitionBy("owner", "section_type").orderBy("i", "n", "asset_id"))
    return rows.withColumn("place", place).where(F.col("place") <= F.least(most_of(F.col("section_type")), F.lit(most))).drop("i", "n")


def placement(section: Column, place: Column, asset_type: Column) -> Column:
    """hero for the first asset of a hook or solution, comparison for tables, else inline."""
    return F.when((place == 1) & section.isin("hook", "solution"), "hero").when(asset_type == "table", "comparison").otherwise("inline")


def asset_markdown(asset_type: Column, caption: Column, alt: Column, url: Column, table: Column) -> Column:
    """An asset as Markdown: its table, or an image with its caption below."""
    picture = F.concat(F.lit("!["), F.coalesce(alt, caption, F.lit("")), F.lit("]("), url, F.lit(")"))
    return F.when((asset_type == "table") & table.isNotNull(), table).otherwise(F.concat(picture, F.when(F.length(caption) > 0, F.concat(F.lit("\n*"), caption, F.lit("*"))).otherwise("")))


def valid_mapping(mapping: DataFrame, assets: DataFrame) -> DataFrame:
    """A mapping (name, asset_ids) without unknown ids, in order; names left with none are dropped."""
    rows = mapping.select("name", F.posexplode("asset_ids").alias("pos", "asset_id")).join(assets.select("asset_id").distinct(), "asset_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("pos", "asset_id")))
    return rows.groupBy("name").agg(F.transform(listed, lambda x: x["asset_id"]).alias("asset_ids"))


def image_file(url: Column) -> Column:
    """The name a picture is stored under: 12 digits of the url's hash and its ending, .jpg without one."""
    ending = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(\.[A-Za-z0-9]{1,5})$", 1))
    return F.concat(fp.short_id(url), F.when(ending != "", ending).otherwise(".jpg"))


def video_assets(videos: DataFrame) -> DataFrame:
    """Videos (owner, url, embed_url, title, caption) as assets: the embedded address if there is one, the id from the plain one."""
    about = F.concat_ws(" | ", "title", "caption")
    return videos.where("url IS NOT NULL").select("owner", fp.short_id(F.col("url")).alias("asset_id"), F.lit("video").alias("asset_type"), F.coalesce("embed_url", "url").alias("url"), about.alias("text"), F.lit("video").alias("kind"))


def selected(selections: DataFrame, assets: DataFrame, most: int = USUAL_MOST) -> DataFrame:
    """Chosen assets (owner, section_type, pos, asset_id) that exist, in the order chosen, at most `most` a section."""
    known = selections.join(assets.select("owner", "asset_id").distinct(), ["owner", "asset_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy("owner", "section_type").orderBy("pos"))
    return known.withColumn("place", place).where(F.col("place") <= most)


def relevance(section_text: Column, asset_text: Column) -> Column:
    """Share of an asset's words that stand in a section's text: the offline ranking of assets for features and sections."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    own = words(asset_text)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(section_text), own)), F.size(own)), F.lit(0.0))


def assets_by_ids(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """Assets whose asset_id is asked for, each as often as it stands in the inventory, with their place in its order (images, tables, videos; block, position)."""
    kind = F.array_position(F.array(*[F.lit(k) for k in ("image", "table", "video")]), F.col("asset_type"))
    asked = assets.join(ids.select("asset_id").distinct(), "asset_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("owner").orderBy(kind, "block_id", "pos", "asset_id")) - 1
    return asked.select("owner", "asset_id", "asset_type", place.alias("place"))
