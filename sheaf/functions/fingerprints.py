"""Fingerprints of texts, blocks, pages and snapshots, and short ids.

Lists are serialised by joining with "|" (tables: cells by U+001F, rows by
U+001E), so the same bytes come out in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.keys import content_digest


def text_hash(text: Column) -> Column:
    """16 hex digits of the SHA-256 of the lower-case text with single blanks."""
    return content_digest(text, 16)


def block_hash(kind: Column, text: Column, items: Column, legacy_label: bool = False) -> Column:
    """Hash of kind:text, with the items behind another colon if there are any.

    legacy_label writes the kind as an enumeration's label (ContentType.NAME).
    """
    label = F.concat(F.lit("ContentType."), F.upper(kind)) if legacy_label else kind
    listed = F.when(F.size(items) > 0, F.concat(F.lit(":"), F.array_join(items, "|"))).otherwise("")
    return text_hash(F.concat(F.coalesce(label, F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")), F.coalesce(listed, F.lit(""))))


def table_hash(headers: Column, rows: Column) -> Column:
    """Hash of a table's cells."""
    cells = F.array_join(F.transform(rows, lambda r: F.array_join(r, "\u001f", "")), "\u001e", "")
    return text_hash(F.concat(F.array_join(F.coalesce(headers, F.array().cast("array<string>")), "\u001f", ""), F.lit("\u001d"), F.coalesce(cells, F.lit(""))))


def page_fingerprint(title: Column, description: Column, block_hashes: Column, table_hashes: Column) -> Column:
    """32 hex digits over title, description and the hashes in page order."""
    empty = F.lit("")
    parts = F.concat(F.array(F.coalesce(title, empty), F.coalesce(description, empty)), block_hashes, table_hashes)
    return F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 32)


def snapshot_fingerprint(urls_and_hashes: Column) -> Column:
    """SHA-256 over the sorted "url:hash" lines; the order of the pages doesn't matter."""
    return F.sha2(F.array_join(F.array_sort(urls_and_hashes), "\n"), 256)


def short_id(text: Column) -> Column:
    """12 hex digits of the MD5."""
    return F.substring(F.md5(text), 1, 12)


def rolling_hash(text: Column) -> Column:
    """The 32-bit hash h * 31 + code unit as signed hex."""
    h = F.call_function("java_method", F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("long")
    return F.when(h < 0, F.concat(F.lit("-"), F.lower(F.hex(-h)))).otherwise(F.lower(F.hex(h)))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def words(text: Column) -> Column:
    """Number of runs of characters that are no white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))
