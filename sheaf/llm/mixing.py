"""Mixes of sources with target shares of the tokens.

Tokens are summed by source, which gives each source of a mix a repetition rate
(at most max_repeats). A document then stands floor(rate) times in the mix, and
once more with the probability of the rest of the rate, by a hash of its id, the
mix and a seed. Nothing but the rates, one row per mix and source, goes to every
task, and only behind a check of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import small

SEED = 17


def source_key(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def rates(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: mix_id, source, target_share, source_tokens, source_docs, wanted_tokens, rate.

    docs has source and tokens. A target's share is its weight over its mix's sum;
    null and negative weights count as 0. The mix is total_ratio times all tokens.
    A source without tokens has rate 0, a null max_repeats is no limit. Targets of
    one mix that spell one source in several ways are one target.
    """
    all_tokens = docs.agg(F.sum("tokens")).first()[0] or 0
    by_source = docs.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    weight = F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))
    t = targets.groupBy("mix_id", source_key(F.col("source")).alias("source")).agg(F.sum(weight).alias("weight"), F.max("max_repeats").alias("most"), F.max("total_ratio").alias("ratio"))
    sums = t.groupBy("mix_id").agg(F.sum("weight").alias("weights")).withColumnRenamed("mix_id", "_mix")
    t = t.join(sums, F.col("mix_id").eqNullSafe(F.col("_mix"))).join(by_source, "source", "left")
    share = F.coalesce(F.try_divide("weight", "weights"), F.lit(0.0))
    wanted = share * F.col("ratio") * F.lit(all_tokens)
    rate = F.when(F.col("source_tokens") > 0, F.least(wanted / F.col("source_tokens"), F.col("most").cast("double"))).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return t.select("mix_id", "source", share.alias("target_share"), zero("source_tokens"), zero("source_docs"), wanted.alias("wanted_tokens"), F.greatest(F.coalesce(rate, F.lit(0.0)), F.lit(0.0)).alias("rate"))


def _times(rate: Column) -> Column:
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "mix_id", F.lit(SEED)), 11).cast("double") / float(2**53)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def chosen(docs: DataFrame, mix_rates: DataFrame) -> DataFrame:
    """Documents with the times they stand in each mix: mix_id, source, doc_id, tokens, times (> 0)."""
    r = small(mix_rates.where("rate > 0").select("mix_id", F.col("source").alias("_source"), "rate"))
    placed = docs.join(r, source_key(F.col("source")) == F.col("_source"))
    return placed.select("mix_id", F.col("_source").alias("source"), "doc_id", "tokens", _times(F.col("rate")).alias("times")).where("times > 0")


def mix(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The mixes: one row per document and copy: mix_id, doc_id, copy_no (from 0), tokens.

    docs has doc_id, source and tokens. Documents with a null source or a source
    without target stand in no mix. Empty tables give no rows.
    """
    picked = chosen(docs, rates(docs, targets))
    return picked.select("mix_id", "doc_id", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy_no"), "tokens")


def shares(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached, one row per target, sources without documents included.

    mix_id, source, target_share, source_tokens, source_docs, rate, docs, copies,
    tokens, reached_share (0 in an empty mix).
    """
    r = rates(docs, targets)
    got = chosen(docs, r).groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("times").alias("copies"), F.sum(F.col("times") * F.col("tokens")).alias("tokens"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("_whole"))
    rows = r.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    reached = F.coalesce(F.try_divide(F.col("tokens"), F.col("_whole")), F.lit(0.0)).alias("reached_share")
    return rows.select("mix_id", "source", "target_share", "source_tokens", "source_docs", "rate", zero("docs"), zero("copies"), zero("tokens"), reached)
