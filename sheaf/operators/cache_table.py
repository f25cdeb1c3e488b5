"""A result cache as a table: keys, expiry, probes, statistics, eviction, invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cache_key(aspect: Column, content_hash: Column) -> Column:
    return F.concat_ws(":", aspect, content_hash)


def file_name(key: Column) -> Column:
    return F.concat(F.md5(key), F.lit(".json"))


def aspect_of(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def expiry(now: Column, ttl: Column, default_ttl: float) -> Column:
    """When an entry ends: at once for a negative time to live, never (null) for 0, the default for null."""
    t = F.coalesce(ttl.cast("double"), F.lit(float(default_ttl)))
    return F.when(t < 0, now - 1).when(t > 0, now + t)


def expired(expires_at: Column, now: Column) -> Column:
    """Whether an entry has ended; one without an end never does."""
    return F.coalesce(expires_at < now, F.lit(False))


def latest(entries: DataFrame) -> DataFrame:
    """The newest entry of each key (ties: the larger entry_id); combined map-side."""
    cols = [c for c in entries.columns if c != "key"]
    newest = entries.groupBy("key").agg(F.max_by(F.struct(*cols), F.struct("created_at", "entry_id")).alias("_x"))
    return newest.select("key", "_x.*")


def probe(requests: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Requests (aspect, content_hash, others) with hit and the data of the newest valid entry. A null part of the key never hits."""
    valid = latest(entries.where(~expired(F.col("expires_at"), now))).select(F.col("key").alias("_key"), F.col("data").alias("cached"))
    rows = requests.join(valid, cache_key(F.col("aspect"), F.col("content_hash")) == F.col("_key"), "left")
    return rows.withColumn("hit", F.col("_key").isNotNull()).drop("_key")


def hit_statistics(probes: DataFrame, *by: str) -> DataFrame:
    """Hits, misses and hit rate (0 without requests) by the given columns."""
    hits = F.count_if("hit")
    return probes.groupBy(*by).agg(hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.coalesce(F.try_divide(hits, F.count(F.lit(1))), F.lit(0.0)), 4).alias("hit_rate"))


def kept_by_use(accesses: DataFrame, capacity: int) -> DataFrame:
    """Keys that stay in a cache of a capacity: the most recently used (ties by key): key, last_accessed, hit_count.

    The order over all keys is a global top list, which Spark takes per partition first.
    """
    used = accesses.groupBy("key").agg(F.max("at").alias("last_accessed"), F.count(F.lit(1)).alias("hit_count"))
    return used.orderBy(F.col("last_accessed").desc(), "key").limit(capacity)


def without(entries: DataFrame, keys: DataFrame | None = None, content_hashes: DataFrame | None = None) -> DataFrame:
    """Entries left after invalidating keys or all aspects of content hashes."""
    if keys is not None:
        entries = entries.join(keys.select("key"), "key", "left_anti")
    if content_hashes is not None:
        entries = entries.join(content_hashes.select("content_hash"), "content_hash", "left_anti")
    return entries


def cached_aspects(entries: DataFrame) -> DataFrame:
    """Aspects held for each content hash, sorted, whether expired or not."""
    return entries.groupBy("content_hash").agg(F.array_sort(F.collect_set(aspect_of(F.col("key")))).alias("aspects"))


def size_report(entries: DataFrame, now: Column) -> DataFrame:
    """One row: entries, keys, expired, bytes."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("key").alias("keys"), F.count_if(expired(F.col("expires_at"), now)).alias("expired"), F.sum(F.coalesce(F.octet_length("data"), F.lit(0))).alias("bytes"))


def cached(requests: DataFrame, entries: DataFrame, now: Column, call) -> tuple[DataFrame, DataFrame]:
    """Answers of requests and the entries to add: hits come from the cache, `call` (DataFrame to DataFrame with data) runs on the misses only."""
    seen = probe(requests, entries, now)
    made = call(seen.where("NOT hit").drop("hit", "cached"))
    hits = seen.where("hit").drop("hit").withColumnRenamed("cached", "data")
    fresh = made.where("data IS NOT NULL").select(cache_key(F.col("aspect"), F.col("content_hash")).alias("key"), "content_hash", "data")
    return hits.unionByName(made, allowMissingColumns=True), fresh


def ranked_versions(templates: DataFrame) -> DataFrame:
    """Template registrations with their place in history: 0 is current, then the ones before."""
    w = Window.partitionBy("name").orderBy(F.col("seq").desc())
    return templates.withColumn("back", F.row_number().over(w) - 1)
