"""Lines repeated within one source, found by compressed bitmaps of the pages they stand on.

The pages of each line, as it is spelled, are a bitmap that is stored per source:
containers of 65,536 page ids, of each only the 64-bit words with a bit set, in
order. The bitmaps of lines that differ in spelling only are united word by word
(OR), exact cardinalities are the sums of the words' bits, and a line is deleted
where the bit of its page is set in the bitmap of a repeated line. No group holds more
than one container, so neither a hot source nor a hot line meets a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.keys import host
from sheaf.session import small, stored

#: Letters a line needs to be counted.
LEAST_LETTERS = 3
#: A line is repeated from this many pages and this share of its source's pages.
LEAST_PAGES = 4
LEAST_SHARE = (3, 10)


def letters(line: Column) -> Column:
    """The letters of a line in lower case."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def line_rows(docs: DataFrame, source: Column, page: Column, text: Column, *keep: Column) -> DataFrame:
    """Counted lines: source hash, line hashes h1 and h2 (128 bits over source and letters), variant (hash of the spelling), page, line_no, kept columns."""
    rows = docs.select(*keep, source.alias("_source"), page.cast("long").alias("page"), F.posexplode(F.split(text, "\n")).alias("line_no", "_line"))
    rows = rows.select("*", letters(F.col("_line")).alias("_letters"))
    rows = rows.where(F.col("_source").isNotNull() & (F.length("_letters") >= LEAST_LETTERS))
    kept = [c for c in rows.columns if c not in ("_source", "_line", "_letters")]
    return rows.select(
        F.xxhash64("_source").alias("source"), F.xxhash64("_source", "_letters").alias("h1"), F.xxhash64(F.lit(1), "_letters", "_source").alias("h2"), F.xxhash64("_line").alias("variant"), *kept
    )


def page_bits(rows: DataFrame, *by: str) -> DataFrame:
    """Bitmaps of page by the given columns, as rows of (by, word, bits)."""
    bit = F.expr("shiftleft(1L, CAST(page & 63 AS INT))")
    return rows.where("page IS NOT NULL").groupBy(*by, F.shiftright("page", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def cardinality(bits: DataFrame, *by: str) -> DataFrame:
    """Exact number of pages in the bitmaps by the given columns."""
    return bits.groupBy(*by).agg(F.sum(F.bit_count("bits")).alias("pages"))


def containers(bits: DataFrame, *by: str) -> DataFrame:
    """Words of bitmaps as containers: by, container (page >> 16), words (sorted, those with a bit set)."""
    return bits.groupBy(*by, F.shiftright("word", 10).alias("container")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))


def bitmaps(rows: DataFrame) -> DataFrame:
    """The stored bitmaps of lines as they are spelled: source, h1, h2, variant, container, words."""
    return stored(containers(page_bits(rows, "source", "h1", "h2", "variant"), "source", "h1", "h2", "variant"), "bitmaps")


def united(maps: DataFrame, *by: str) -> DataFrame:
    """Bitmaps united by the given columns, as words: by, word, bits."""
    return maps.select(*by, F.explode("words").alias("w")).groupBy(*by, F.col("w.word").alias("word")).agg(F.bit_or("w.bits").alias("bits"))


def repeated(maps: DataFrame) -> DataFrame:
    """Lines repeated within their source: source, h1, h2, pages."""
    lines = cardinality(united(maps, "source", "h1", "h2"), "source", "h1", "h2").where(F.col("pages") >= LEAST_PAGES)
    whole = cardinality(united(maps, "source"), "source").select(F.col("source").alias("_s"), F.col("pages").alias("_all"))
    enough = F.col("pages") * LEAST_SHARE[1] >= F.col("_all") * LEAST_SHARE[0]
    return lines.join(whole, F.col("source") == F.col("_s")).where(enough).select("source", "h1", "h2", "pages")


def repeated_block_lines(blocks: DataFrame) -> DataFrame:
    """Each line of each block that is repeated on its site: block_id, line_no.

    Rows with null url or text have no lines; a null page_id counts for no page,
    but its lines are found. Lines with under three letters (blank ones too) don't
    count. Rows sent twice give one row each; an empty table gives none.
    """
    rows = line_rows(blocks, host(F.col("url")), F.col("page_id"), F.col("text"), F.col("block_id"))
    maps = bitmaps(rows)
    lines = stored(repeated(maps).select("h1", "h2"), "repeated")
    words = united(maps.join(small(lines), ["h1", "h2"], "left_semi"), "h1", "h2").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("word").alias("_word"), "bits")
    mine = rows.join(small(lines), ["h1", "h2"], "left_semi")  # the few lines that may be deleted
    bit = F.expr("shiftleft(1L, CAST(page & 63 AS INT))")
    at = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.shiftright("page", 6) == F.col("_word"))
    found = mine.where("page IS NOT NULL").join(words, at).where(F.col("bits").bitwiseAND(bit) != 0).select("block_id", "line_no")
    loose = mine.where("page IS NULL").select("block_id", "line_no")
    return found.unionByName(loose).select("block_id", F.col("line_no").cast("long").alias("line_no")).distinct()


def without_repeated_lines(blocks: DataFrame) -> DataFrame:
    """Blocks with their repeated lines removed: block_id, text, removed.

    Blocks without repeated lines keep their text (null stays null); a block of
    nothing else becomes the empty text.
    """
    whole = blocks.select("block_id", "text").dropDuplicates(["block_id"])
    found = repeated_block_lines(blocks).groupBy("block_id").agg(F.collect_set("line_no").alias("_numbers"))
    rows = whole.join(found, "block_id", "left").withColumn("_lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("_lines").cast("long") - 1), "_numbers")
    kept = F.transform(left, lambda i: F.get("_lines", i.cast("int")))
    text = F.when(F.col("_numbers").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select("block_id", text.alias("text"), F.coalesce(F.size("_numbers"), F.lit(0)).alias("removed"))
