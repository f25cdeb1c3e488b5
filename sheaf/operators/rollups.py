"""Totals of runs: batches, retries, progress, usage, derived sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import small


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 without a whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def batch_totals(items: DataFrame, *by: str) -> DataFrame:
    """Items, successes, failures, success rate, and tokens and amount of the successes (columns success, tokens, amount)."""
    good = F.count_if("success")
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), good.alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.round(rate(good, F.count(F.lit(1))), 4).alias("success_rate"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"), F.round(F.coalesce(F.sum(F.when(F.col("success"), F.col("amount"))), F.lit(0.0)), 2).alias("amount"),
    )


def retry_outcomes(attempts: DataFrame, most: int) -> DataFrame:
    """Outcome per item of an attempt log (item, at, seq, ok): success and retries; without success retries are most + 1.

    The first success among the first most + 1 attempts counts. The window runs
    within an item, after the rows of one item beyond most + 1 are cut.
    """
    w = Window.partitionBy("item").orderBy("at", "seq")
    rows = attempts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most + 1)
    first = rows.groupBy("item").agg(F.min(F.when(F.col("ok"), F.col("n") - 1)).alias("r"))
    return first.select("item", F.col("r").isNotNull().alias("success"), F.coalesce("r", F.lit(most + 1)).alias("retries"))


def progress(pages: DataFrame, total: int, *by: str) -> DataFrame:
    """Percent done, mean seconds per page and seconds left (column seconds per finished page)."""
    n = F.count(F.lit(1))
    return pages.groupBy(*by).agg(
        F.round(100 * n / total, 1).alias("percent"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.round(F.avg("seconds") * F.greatest(F.lit(total) - n, F.lit(0)), 2).alias("seconds_left")
    )


def usage_cost(calls: DataFrame, rates: DataFrame, default_model: str) -> DataFrame:
    """Cost of calls (model, input_tokens, output_tokens) by model and in all (null model), one rollup.

    rates (model, input_per_m, output_per_m) is small and given by the caller; a
    model without a rate counts at the default model's. Input and output tokens
    make the tokens; cached ones don't.
    """
    r = small(rates.select(F.col("model").alias("_m"), "input_per_m", "output_per_m"))
    usual = rates.where(F.col("model") == default_model).first()
    i, o = (F.lit(usual[c] if usual else None).cast("double") for c in ("input_per_m", "output_per_m"))
    rows = calls.join(r, F.col("model") == F.col("_m"), "left")
    cost = (F.col("input_tokens") * F.coalesce("input_per_m", i) + F.col("output_tokens") * F.coalesce("output_per_m", o)) / 1e6
    return rows.rollup("model").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("long").alias("tokens"), F.round(F.sum(cost), 4).alias("cost")
    )


# Domains with their answer to unknown values.
CATEGORIES = ("core", "integration", "security", "analytics", "automation", "collaboration", "customization", "mobile", "api", "support", "other")
AUDIENCES = ("executive", "technical", "end_user", "manager", "developer", "procurement", "general")


def coerced(value: Column, domain: tuple[str, ...], other: str | None) -> Column:
    """A value of a domain in lower case; anything else becomes `other` (null: dropped)."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*domain), low).otherwise(F.lit(other))


def members(values: Column, domain: tuple[str, ...]) -> Column:
    """The values of an array that belong to the domain, in order."""
    return F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: x.isin(*domain))
