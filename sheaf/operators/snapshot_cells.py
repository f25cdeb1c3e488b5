"""Changes between consecutive full snapshots by signed cells.

Every row of a snapshot is unpivoted into cells (key, field, value), plus one
presence marker of its key. A snapshot's cells count +1 in the comparison with
the snapshot before it and -1 in the one with the snapshot after it. Sums that
are not zero tell added, removed and changed keys and the fields that changed.
The sums combine map-side and their groups hold at most a few cells, so a
product with a third of all rows is no burden to any task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.keys import hash_key, url_key
from sheaf.session import small

PRESENT = "\u0000present"


def snapshot_order(rows: DataFrame, owner: str, snapshot: str, at: str) -> DataFrame:
    """One row per snapshot with the ids before and after it, by time and then id."""
    times = rows.groupBy(owner, snapshot).agg(F.min(at).alias("_at"))
    w = Window.partitionBy(owner).orderBy("_at", snapshot)
    return times.select(owner, snapshot, F.lag(snapshot).over(w).alias("_before"), F.lead(snapshot).over(w).alias("_after"))


def signed_cells(rows: DataFrame, order: DataFrame, owner: str, snapshot: str, key: str, fields: Sequence[str]) -> DataFrame:
    """The cells of both comparisons a row takes part in: owner, from, to, key, field, value, sign."""
    o = small(order).select(F.col(owner).alias("_owner"), F.col(snapshot).alias("_snap"), "_before", "_after")
    placed = rows.join(o, rows[owner].eqNullSafe(o["_owner"]) & (rows[snapshot] == o["_snap"]))
    sides = F.array(
        F.struct(F.col("_before").alias("from"), F.col("_snap").alias("to"), F.lit(1).alias("sign")),
        F.struct(F.col("_snap").alias("from"), F.col("_after").alias("to"), F.lit(-1).alias("sign")),
    )
    cells = F.array(
        F.struct(F.lit(PRESENT).alias("field"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields],
    )
    sided = placed.select(F.col("_owner").alias(owner), key, cells.alias("_cells"), F.explode(sides).alias("_side"))
    sided = sided.where(F.col("_side.from").isNotNull() & F.col("_side.to").isNotNull())
    return sided.select(owner, key, "_side.*", F.explode("_cells").alias("_cell")).select(owner, "from", "to", key, "_cell.*", "sign")


def classify_cells(cells: DataFrame, owner: str, key: str) -> DataFrame:
    """Nonzero sums as rows: owner, from, to, key, change, fields (sorted, empty for added and removed)."""
    sums = cells.groupBy(owner, "from", "to", key, "field", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    marker = F.col("field") == PRESENT
    rows = sums.groupBy(owner, "from", "to", key).agg(
        F.sum(F.when(marker, F.col("n")).otherwise(0)).alias("n"),
        F.array_sort(F.collect_set(F.when(~marker, F.col("field")))).alias("fields"),
    )
    change = F.when(F.col("n") > 0, "added").when(F.col("n") < 0, "removed").otherwise("changed")
    return rows.select(owner, "from", "to", key, change.alias("change"), F.when(F.col("n") == 0, F.col("fields")).otherwise(F.array().cast("array<string>")).alias("fields"))


def snapshot_changes(rows: DataFrame, owner: str, snapshot: str, at: str, key: str, fields: Sequence[str]) -> DataFrame:
    """Changes between consecutive snapshots of each owner.

    rows holds at most one row per (owner, snapshot, key). Rows with a null
    snapshot, time or key belong to no comparison and are left out; a null owner
    is an owner like any other. Null field values are values: null to "x" is a
    change. The first snapshot of an owner gives no rows, an empty table none.
    Other columns are ignored, whatever their names.
    """
    rows = rows.select(owner, snapshot, at, key, *fields).where(F.col(snapshot).isNotNull() & F.col(at).isNotNull() & F.col(key).isNotNull())
    order = snapshot_order(rows, owner, snapshot, at)
    return classify_cells(signed_cells(rows, order, owner, snapshot, key, fields), owner, key)


def snapshot_page_rows(pages: DataFrame) -> DataFrame:
    """One row per page of a snapshot: product_id, extraction_id, started_at, url_key, content_hash, title.

    Of several rows of a page the one with the latest extracted_at stands, then
    the latest loaded_at, then the largest hash and title. Texts are hashed
    before the shuffle and travel no further.
    """
    slim = pages.where("url is not null").select(
        "product_id", "extraction_id", "started_at", url_key(F.col("url")).alias("url_key"),
        F.struct("extracted_at", "loaded_at", hash_key(F.col("content_hash"), F.col("page_text")).alias("content_hash"), "title").alias("row"),
    )
    last = slim.groupBy("product_id", "extraction_id", "url_key").agg(F.min("started_at").alias("started_at"), F.max("row").alias("row"))
    return last.select("product_id", "extraction_id", "started_at", "url_key", "row.content_hash", "row.title")


def page_changes(pages: DataFrame, fields: Sequence[str] = ("content_hash", "title")) -> DataFrame:
    """Page changes of each product: product_id, from_extraction, to_extraction, url_key, change, fields."""
    found = snapshot_changes(snapshot_page_rows(pages), "product_id", "extraction_id", "started_at", "url_key", fields)
    return found.withColumnsRenamed({"from": "from_extraction", "to": "to_extraction"})
