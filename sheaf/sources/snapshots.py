"""Reading and writing snapshots, templates, answers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLE = "STRUCT<headers: ARRAY<STRING>, rows: ARRAY<ARRAY<STRING>>, caption: STRING, source_selector: STRING>"
_IMAGE = "STRUCT<url: STRING, alt_text: STRING, title: STRING, caption: STRING, local_path: STRING, width: INT, height: INT, file_size: INT, mime_type: STRING, source_selector: STRING>"
_BLOCK = (
    f"STRUCT<content_type: STRING, text: STRING, html: STRING, heading_level: INT, list_items: ARRAY<STRING>, table_data: {_TABLE}, media_assets: ARRAY<{_IMAGE}>, "
    "links: ARRAY<STRUCT<url: STRING, text: STRING>>, source_selector: STRING, parent_section: STRING, confidence_score: DOUBLE, `order`: INT>"
)
_PAGE = f"STRUCT<url: STRING, title: STRING, meta_description: STRING, content_blocks: ARRAY<{_BLOCK}>, images: ARRAY<{_IMAGE}>, tables: ARRAY<{_TABLE}>, extracted_at: STRING, content_hash: STRING, word_count: INT>"
#: One snapshot per file; unknown fields are ignored, a file that can't be read is in _corrupt.
SNAPSHOT = f"extraction_id STRING, product_name STRING, product_url STRING, pages ARRAY<{_PAGE}>, started_at STRING, completed_at STRING, content_hash STRING, _corrupt STRING"
TEMPLATE = "name STRING, template STRING, description STRING, version STRING, tags ARRAY<STRING>"


def snapshot_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Snapshots from JSON files, with file_id (the file's stem) for those without an extraction_id; null where _corrupt is set."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", pattern).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    return rows.select("*", stem.alias("file_id"))


def readable(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good snapshots and the quarantine (file_id and content of files that can't be read)."""
    return snapshots.where("_corrupt IS NULL").drop("_corrupt"), snapshots.where("_corrupt IS NOT NULL").select("file_id", "_corrupt")


def snapshot_blocks(snapshots: DataFrame) -> DataFrame:
    """Blocks as rows: extraction_id, page_no, url, block_no and the block's fields."""
    pages = snapshots.select(F.coalesce("extraction_id", "file_id").alias("extraction_id"), F.posexplode("pages").alias("page_no", "p"))
    blocks = pages.select("extraction_id", "page_no", "p.url", F.posexplode("p.content_blocks").alias("block_no", "b"))
    return blocks.select("extraction_id", "page_no", "url", "block_no", "b.*")


def listed_files(spark: SparkSession, path: str, prefix: str = "", most: int = 20) -> DataFrame:
    """The newest files of a folder with size and time; the files' contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.json").load(path)
    return rows.select("path", "length", "modificationTime").orderBy(F.col("modificationTime").desc(), "path").limit(most)


def template_files(spark: SparkSession, path: str) -> DataFrame:
    """Templates from files with one object or an array of objects."""
    return spark.read.schema(TEMPLATE).option("multiLine", True).json(path)


def save_snapshots(rows: DataFrame, path: str) -> None:
    """Rows appended as Parquet, one folder per product and snapshot, which later reads prune."""
    rows.repartition("product_id", "extraction_id").write.mode("append").partitionBy("product_id", "extraction_id").parquet(path)


def save_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_texts(rows: DataFrame, key: str, path: str) -> None:
    """One text column, a folder per key."""
    rows.select(key, "text").repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def compacted_cache(entries: DataFrame, most: int) -> DataFrame:
    """The newest entries of a cache, at most `most` (a top list by created_at)."""
    return entries.orderBy(F.col("created_at").desc(), "key").limit(most)
