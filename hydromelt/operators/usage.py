"""API usage reports over the usage log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent_usage(log: DataFrame, as_of: Column) -> DataFrame:
    """Requests per organisation in the last 24 hours and 30 days before ``as_of``."""
    since = lambda interval: (F.col("requested_at") >= as_of - F.expr(interval)) & (F.col("requested_at") <= as_of)
    return log.groupBy("organization_id").agg(
        F.count_if(since("INTERVAL 24 HOURS")).alias("last_24_hours"),
        F.count_if(since("INTERVAL 30 DAYS")).alias("last_30_days"))


def recent_counts(seconds: DataFrame, as_of: Column) -> DataFrame:
    """:func:`recent_usage` as of the start of a second, from counts per organisation and second.

    ``at_start`` of a second's ``requests`` came at its very start: the others are later than it.
    """
    now = F.date_trunc("second", as_of)
    begun = lambda interval: F.col("second") >= now - F.expr(interval)
    counted = F.when(F.col("second") < now, F.col("requests")).when(F.col("second") == now, F.col("at_start"))
    total = lambda interval: F.coalesce(F.sum(F.when(begun(interval), counted)), F.lit(0))
    return seconds.groupBy("organization_id").agg(
        total("INTERVAL 24 HOURS").alias("last_24_hours"), total("INTERVAL 30 DAYS").alias("last_30_days"))


def per_minute(log: DataFrame) -> DataFrame:
    """Requests per key and fixed minute."""
    return log.groupBy("api_key_id", F.window("requested_at", "1 minute").alias("w")).agg(
        F.count("*").alias("requests")).select("api_key_id", F.col("w.start").alias("minute"), "requests")


def rate_breaches(log: DataFrame, limits: DataFrame | None = None, default_limit: int = 60) -> DataFrame:
    """Minutes in which a key went over its allowance, with the refused requests."""
    counted = per_minute(log)
    if limits is not None:
        counted = counted.join(limits.select("api_key_id", "requests_per_minute"), "api_key_id", "left")
        allowed = F.coalesce("requests_per_minute", F.lit(default_limit))
    else:
        allowed = F.lit(default_limit)
    return counted.withColumn("allowed", allowed).where(F.col("requests") > F.col("allowed")).select(
        "api_key_id", "minute", "requests", (F.col("requests") - F.col("allowed")).alias("refused"))
