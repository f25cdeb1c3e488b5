"""Micro-batches: flushed totals and a change monitor over incoming pages."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.keys import hash_key, url_key
from sheaf.session import run_dir


def run_available(stream: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, in micro-batches; the checkpoint makes a restart go on where it stopped."""
    query = stream.writeStream.outputMode(mode).foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 10) -> DataFrame:
    """A table of a folder (one file, or a folder of files) as a stream; no watermark, so no late row is lost."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    whole = f"{folder}/{name}.parquet"
    return reader.parquet(whole) if os.path.isdir(whole) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def flushed(spark: SparkSession, stream: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What each micro-batch makes, appended to a table with its batch number (a retried batch replaces its own folder)."""
    place = f"{run_dir(spark)}/flush-{uuid.uuid4().hex}"
    run_available(stream, lambda rows, n: make(rows).write.mode("overwrite").parquet(f"{place}/out/batch={n}"), f"{place}/state")
    return spark.read.parquet(f"{place}/out")


def monitored(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The last hash of each url after all micro-batches, and how often it changed: url_key, hash, changes.

    The versions of each page (time and hash) are keyed state of the stream, so a
    batch costs what it touches; changes are counted in the order of times, of equal
    times the larger hash stands last. Rows sent twice change nothing.
    """
    place = f"{run_dir(spark)}/monitor-{uuid.uuid4().hex}"
    seen = F.struct("extracted_at", hash_key(F.col("content_hash"), F.col("page_text")).alias("hash"))
    rows = stream.where("url IS NOT NULL").select(url_key(F.col("url")).alias("url_key"), seen.alias("seen")).groupBy("url_key").agg(F.array_sort(F.collect_set("seen")).alias("seen"))
    differs = F.aggregate(F.sequence(F.lit(1), F.size("seen") - 1), F.lit(0).cast("long"), lambda n, i: n + (F.get("seen", i)["hash"] != F.get("seen", i - 1)["hash"]).cast("long"))
    made = rows.select("url_key", F.element_at("seen", -1)["hash"].alias("hash"), F.when(F.size("seen") > 1, differs).otherwise(F.lit(0).cast("long")).alias("changes"))
    batches: list[int] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={n}")
        batches.append(n)

    run_available(made, keep, f"{place}/state", "update")
    kinds = "url_key string, hash string, changes long, batch long"
    out = spark.read.schema(kinds).parquet(f"{place}/out") if batches else spark.createDataFrame([], kinds)
    last = out.groupBy("url_key").agg(F.max_by(F.struct("hash", "changes"), "batch").alias("x"))
    return last.select("url_key", "x.hash", "x.changes")
