"""Legal limits: loading, lookup, exceedances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import values
from hydromelt.operators.joins import checked_broadcast
from hydromelt.operators.numbering import first_per

LIMIT_KEY = ("standard_set", "item_code", "region_grade", "scale")


class LimitRequestError(ValueError):
    """A limit request names no valid discharge scale."""


def checked_scale(scale: str | None, required: bool = False) -> str | None:
    if not (scale or "").strip():
        if required:
            raise LimitRequestError("scale is required")
        return None
    if scale not in C.SCALES:
        raise LimitRequestError(f"scale must be one of {C.SCALES}, not {scale!r}")
    return scale


def typed_limits(raw: DataFrame) -> DataFrame:
    """Text limit rows to typed ones: blanks become null, the source defaults to demo."""
    text = lambda c: values.blank_to_null(F.col(c))
    return raw.select(
        text("standard_set").alias("standard_set"), text("item_code").alias("item_code"),
        text("region_grade").alias("region_grade"), text("scale").alias("scale"),
        text("limit_min").try_cast(values.DECIMAL).alias("limit_min"),
        text("limit_max").try_cast(values.DECIMAL).alias("limit_max"), text("unit").alias("unit"),
        text("legal_basis").alias("legal_basis"), text("legal_article").alias("legal_article"),
        text("effective_from").try_cast("date").alias("effective_from"),
        F.coalesce(text("source"), F.lit("demo")).alias("source"), text("note").alias("note"))


def newest_limits(limits: DataFrame, order: str = "id") -> DataFrame:
    """Newest row per key; null region and scale are key values like any other."""
    keys = [F.col("standard_set"), F.col("item_code"), F.coalesce("region_grade", F.lit("")),
            F.coalesce("scale", F.lit(""))]
    return first_per(limits, keys, [F.col(order).desc()])


def limits_lookup(limits: DataFrame, standard_set: str = C.DEFAULT_STANDARD_SET, scale: str | None = None,
                  region_grade: str | None = None, item_code: str | None = None) -> DataFrame:
    """Limits to draw: the region, if asked for, must match exactly."""
    scale = checked_scale(scale, required=True)
    found = limits.where((F.col("standard_set") == standard_set)
                         & (F.col("scale").isNull() | (F.col("scale") == scale)))
    if (region_grade or "").strip():
        found = found.where(F.col("region_grade") == region_grade)
    if (item_code or "").strip():
        found = found.where(F.col("item_code") == item_code)
    return found


def applicable_limits(limits: DataFrame, standard_set: str, region_grade: str, scale: str | None) -> DataFrame:
    """Limits that hold for a region and scale; a null region or scale holds everywhere.

    Without a scale only scale-free limits apply.
    """
    return limits.where((F.col("standard_set") == standard_set)
                        & (F.col("region_grade").isNull() | (F.col("region_grade") == region_grade))
                        & (F.col("scale").isNull() | (F.col("scale") == F.lit(scale or ""))))


def violated(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce((value > high) | (value < low), value > high, value < low, F.lit(False))


def not_influent() -> Column:
    return F.col("sample_type").isNull() | (F.col("sample_type") != C.INFLUENT)


def exceedances(measurements: DataFrame, limits: DataFrame, standard_set: str = C.DEFAULT_STANDARD_SET,
                region_grade: str = "가지역", scale: str | None = None) -> DataFrame:
    """Every treated-water value outside a legal limit that applies to it."""
    applying = applicable_limits(limits, standard_set, region_grade, checked_scale(scale)).select(
        "item_code", "limit_min", "limit_max", F.col("source").alias("limit_source"))
    value, low, high = F.col("value_num"), F.col("limit_min"), F.col("limit_max")
    return (measurements.where(value.isNotNull() & not_influent()).join(checked_broadcast(applying), "item_code")
            .withColumn("verdict", values.limit_verdict(value, low, high)).where("verdict is not null"))


def exceedance_counts(found: DataFrame) -> DataFrame:
    """All exceedances and those whose file reports another limit than the law."""
    return found.agg(F.count("*").alias("exceeded_count"), F.count_if(
        F.col("reported_limit") != F.col("limit_max")).alias("limit_mismatch_count"))


def top_exceedances(found: DataFrame, tiebreak: list[Column], rows: int | None) -> DataFrame:
    """Exceedances from the newest on: the first ``rows``, or all for None."""
    ordered = found.orderBy(F.col("measured_on").desc(), F.col("site_name"), *tiebreak)
    return ordered if rows is None else ordered.limit(rows)


def reported_exceedances(measurements: DataFrame) -> DataFrame:
    """Treated-water values above the limit their own file reports."""
    return measurements.where((F.col("value_num") > F.col("reported_limit")) & not_influent())


def standard_sets(limits: DataFrame) -> DataFrame:
    return limits.groupBy("standard_set").agg(
        F.count("*").alias("item_count"), F.count_distinct("item_code").alias("distinct_items"),
        F.min("legal_basis").alias("legal_basis"), F.min("source").alias("source"),
        F.count_if(F.col("source") != "law").alias("unverified_count"))


def region_grades(limits: DataFrame) -> DataFrame:
    return limits.where("region_grade is not null").select("region_grade").distinct()


