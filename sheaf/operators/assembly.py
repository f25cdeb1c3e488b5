"""Ordered documents from sections: choice of sections, Markdown, plain text, outline, slides, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import fingerprints as fp
from sheaf.functions.parsing import shortened

# Words spoken in a minute; bullets of a slide; characters of bullets and of key points, cut to.
WORDS_A_MINUTE, SLIDE_BULLETS = 150, 6
BULLET, KEY_POINT = (200, 197), (500, 497)


def chosen_sections(sections: DataFrame, wanted: list[str] | None, left_out: tuple[str, ...] = ()) -> DataFrame:
    """Sections of the wanted types (all without a list), without those left out."""
    rows = sections if wanted is None else sections.where(F.col("section_type").isin(*wanted))
    return rows.where(~F.coalesce(F.col("section_type").isin(*left_out), F.lit(False))) if left_out else rows


def _ordered(sections: DataFrame, value: Column) -> DataFrame:
    """One text per pitch of its sections' texts in order (a pitch has a bounded number of sections)."""
    listed = F.array_sort(F.collect_list(F.struct("section_order", "section_id", value.alias("t"))))
    return sections.groupBy("pitch_id").agg(F.transform(listed, lambda x: x["t"]).alias("parts"))


def markdown(sections: DataFrame) -> DataFrame:
    """Pitches as Markdown: a second-level heading and the content of each section, key points as a list."""
    points = F.when(F.size("key_points") > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform("key_points", lambda k: F.concat(F.lit("- "), F.coalesce(k, F.lit("")))), "\n"))).otherwise("")
    text = F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.coalesce(points, F.lit("")))
    return _ordered(sections, text).select("pitch_id", F.array_join("parts", "\n\n").alias("text"))


def plain_text(sections: DataFrame) -> DataFrame:
    """Pitches as plain text with underlined titles."""
    title = F.coalesce("title", F.lit(""))
    text = F.concat(title, F.lit("\n"), F.repeat(F.lit("="), F.length(title)), F.lit("\n"), F.coalesce("content", F.lit("")))
    return _ordered(sections, text).select("pitch_id", F.array_join("parts", "\n\n").alias("text"))


def totals(sections: DataFrame) -> DataFrame:
    """Sections, words (content and key points) and minutes of each pitch."""
    points = F.aggregate(F.coalesce("key_points", F.array().cast("array<string>")), F.lit(0), lambda a, k: a + fp.words(k))
    words = F.sum(fp.words(F.col("content")) + points)
    return sections.groupBy("pitch_id").agg(F.count(F.lit(1)).alias("sections"), words.cast("long").alias("words"), F.round(words / WORDS_A_MINUTE, 2).alias("minutes"), F.round(F.avg((F.length("content") > 0).cast("int")), 4).alias("confidence"))


def bullets(text: Column) -> Column:
    """A text's sentences as bullets of a slide: the first few, long ones up to a colon or cut."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: F.length(F.trim(x)) > 0)
    short = F.transform(F.slice(parts, 1, SLIDE_BULLETS), lambda x: F.when((F.length(x) > BULLET[0]) & F.contains(x, F.lit(":")), F.substring_index(x, ":", 1)).otherwise(x))
    return F.transform(short, lambda x: shortened(x, *BULLET))


def slides(sections: DataFrame) -> DataFrame:
    """Slide plan: pitch_id, slide_no (from 0), kind (title, content, cta), title, bullets, notes.

    A pitch opens with a title slide named after its first section; calls to
    action come last.
    """
    last = F.col("section_type").isin("cta", "call_to_action")
    points = F.transform(F.slice(F.coalesce("key_points", F.array().cast("array<string>")), 1, SLIDE_BULLETS), lambda k: shortened(k, *KEY_POINT))
    body = F.when(F.size(points) > 0, points).otherwise(F.coalesce(bullets(F.col("content")), F.array().cast("array<string>")))
    row = F.struct(last.cast("int").alias("last"), "section_order", "section_id", F.when(last, "cta").otherwise("content").alias("kind"), F.coalesce("title", F.lit("")).alias("title"), body.alias("bullets"), F.array_join(F.coalesce("talking_points", F.array().cast("array<string>")), "\n").alias("notes"))
    made = sections.groupBy("pitch_id").agg(F.array_sort(F.collect_list(row)).alias("x"))
    first = F.struct(F.lit("title").alias("kind"), F.get("x", F.lit(0))["title"].alias("title"), F.array().cast("array<string>").alias("bullets"), F.lit("").alias("notes"))
    rest = F.transform("x", lambda s: F.struct(s["kind"].alias("kind"), s["title"].alias("title"), s["bullets"].alias("bullets"), s["notes"].alias("notes")))
    return made.select("pitch_id", F.posexplode(F.concat(F.array(first), rest)).alias("slide_no", "s")).select("pitch_id", "slide_no", "s.*")


def outline(sections: DataFrame) -> DataFrame:
    """Titles of the slides: pitch_id, slide_no, kind, title."""
    return slides(sections).select("pitch_id", "slide_no", "kind", "title")


def call_to_action(sections: DataFrame) -> DataFrame:
    """First and second call and the steps after them, from the key points of the call-to-action section."""
    rows = sections.where(F.col("section_type").isin("cta", "call_to_action"))
    first = rows.groupBy("pitch_id").agg(F.min_by(F.coalesce("key_points", F.array().cast("array<string>")), F.struct("section_order", "section_id")).alias("k"))
    steps = F.slice("k", F.lit(3), F.greatest(F.size("k"), F.lit(1)))
    return first.select("pitch_id", F.coalesce(F.get("k", F.lit(0)), F.lit("Learn more")).alias("first_call"), F.get("k", F.lit(1)).alias("second_call"), F.array_join(steps, " | ").alias("steps"))


def context(products: DataFrame) -> DataFrame:
    """One row per product with every variable of a prompt; what is missing has its usual stand-in.

    products has product, audience, industry, company, pain_points (array),
    features (array of struct name, description, benefits) and benefits (array of
    struct headline, description). Lists are cut: 10 features with 2 benefits
    each, 10 benefits, 5 names.
    """
    line = lambda i, a, b: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(a, F.lit("")), F.lit(": "), F.coalesce(b, F.lit("")))
    more = lambda f: F.when(F.size(f["benefits"]) > 0, F.concat(F.lit("\n   Benefits: "), F.array_join(F.slice(f["benefits"], 1, 2), ", "))).otherwise("")
    features = F.array_join(F.transform(F.slice("features", 1, 10), lambda f, i: F.concat(line(i, f["name"], f["description"]), more(f))), "\n")
    benefits = F.array_join(F.transform(F.slice("benefits", 1, 10), lambda b, i: line(i, b["headline"], b["description"])), "\n")
    some = lambda c, other: F.when(F.length(c) > 0, c).otherwise(other)
    return products.select(
        "product", some(F.col("audience"), "general business audience").alias("target_audience"), some(F.col("industry"), "general").alias("industry"), some(F.col("company"), "your company").alias("company_name"),
        some(F.array_join("pain_points", ", "), "common industry challenges").alias("pain_points"), some(features, "No specific features available").alias("features_list"), some(benefits, "No specific benefits available").alias("benefits_list"),
        F.coalesce(F.array_join(F.transform(F.slice("features", 1, 5), lambda f: f["name"]), ", "), F.lit("")).alias("key_features"),
    )


def highlights(features: DataFrame, most: int = 5) -> DataFrame:
    """The first features of each owner (owner, pos, name, description, benefits): headline of 100 characters and first benefit."""
    place = F.row_number().over(Window.partitionBy("owner").orderBy("pos", "name"))
    rows = features.withColumn("place", place).where(F.col("place") <= most)
    return rows.select("owner", "place", "name", F.substring("description", 1, 100).alias("headline"), F.coalesce(F.get("benefits", F.lit(0)), F.lit("")).alias("benefit"))


def variants(pitches: DataFrame, audiences: list[str]) -> DataFrame:
    """A copy of each pitch per audience."""
    return pitches.withColumn("audience", F.explode(F.array(*[F.lit(a) for a in audiences])))


def variant(rows: DataFrame, audience: str) -> DataFrame:
    """The copies for one audience, in any letter case."""
    return rows.where(F.lower("audience") == audience.lower())


def contents(sections: DataFrame) -> DataFrame:
    """Table of contents of each pitch: pitch_id, number (from 1), entry; a summary opens it, the steps after a call to action close it."""
    rows = sections.select("pitch_id", "section_order", "section_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("section_type").isin("cta", "call_to_action") & (F.size("key_points") > 0), F.lit(False)).alias("_calls"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("section_order", "section_id", "title"))), lambda x: x["title"])
    made = rows.groupBy("pitch_id").agg(listed.alias("t"), F.max("_calls").alias("c"))
    all_of = F.concat(F.array(F.lit("Executive Summary")), "t", F.when(F.col("c"), F.array(F.lit("Next Steps"))).otherwise(F.array().cast("array<string>")))
    return made.select("pitch_id", F.posexplode(all_of).alias("number", "entry")).select("pitch_id", (F.col("number") + 1).alias("number"), "entry")
