"""Summaries over measurements, files and mapping runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import values
from hydromelt.operators.numbering import first_per


def measurement_totals(measurements: DataFrame) -> DataFrame:
    """Totals over everything. Rows are reduced to items and sites before these are counted."""
    part = measurements.groupBy("item_code", "site_name").agg(
        F.count("*").alias("n"), F.min("measured_on").alias("first_date"), F.max("measured_on").alias("last_date"))
    return part.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_values"), F.count_distinct("item_code").alias("distinct_items"),
        F.count_distinct("site_name").alias("distinct_sites"), F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"))


def measurements_by_item(measurements: DataFrame) -> DataFrame:
    value = F.col("value_num")
    return measurements.groupBy("item_code").agg(
        F.count("*").alias("n"), F.round(F.avg(value), 3).alias("avg_value"),
        F.round(F.min(value), 3).alias("min_value"), F.round(F.max(value), 3).alias("max_value"))


def distinct_values(measurements: DataFrame, column: str) -> DataFrame:
    return measurements.where(F.col(column).isNotNull()).select(column).distinct()


def item_counts(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("item_code").agg(F.count("*").alias("n"))


def measured_period(measurements: DataFrame) -> DataFrame:
    return measurements.where("measured_on is not null").agg(
        F.min("measured_on").alias("first_date"), F.max("measured_on").alias("last_date"))


def _status_counts() -> list:
    status = values.known_status(F.col("status"))
    return [F.count("*").alias("total_columns"), F.count_if(status.isin(*C.AUTO_STATUSES)).alias("auto_mapped"),
            F.count_if(status == "needs_review").alias("needs_review"),
            F.count_if(status == "unmapped").alias("unmapped")]


def _with_rates(df: DataFrame) -> DataFrame:
    total = F.col("total_columns")
    return (df.withColumn("auto_mapped_rate", values.rate(F.col("auto_mapped"), total))
            .withColumn("needs_review_rate", values.rate(F.col("needs_review"), total))
            .withColumn("unmapped_rate", values.rate(F.col("unmapped"), total)))


def mapping_summary(columns: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Column counts and rates per file (or per given key)."""
    return _with_rates(columns.groupBy(*keys).agg(*_status_counts()))


def mapping_rollup(columns: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file and, where the key is null, over all files."""
    return _with_rates(columns.rollup(key).agg(*_status_counts(), F.grouping(key).alias("is_total")))


def round_growth(summaries: DataFrame, key: str = "filename") -> DataFrame:
    """First against second round per file, for files present in both."""
    part = lambda n: summaries.where(F.col("round_no") == n).select(
        key, F.col("auto_mapped_rate").alias(f"rate_{n}"))
    return part(1).join(part(2), key).withColumn("growth", F.col("rate_2") - F.col("rate_1"))


def latest_round(runs: DataFrame) -> DataFrame:
    return first_per(runs, ["file_id"], [F.col("round_no").desc()])


def next_round(runs: DataFrame, files: DataFrame) -> DataFrame:
    top = runs.groupBy("file_id").agg(F.max("round_no").alias("_top"))
    return files.select("file_id").join(top, "file_id", "left").select(
        "file_id", (F.coalesce("_top", F.lit(0)) + 1).alias("round_no"))


def round_delta(runs: DataFrame) -> DataFrame:
    """Rate change from the first to the last round per file; 0.0 for one round."""
    return runs.groupBy("file_id").agg(
        F.count("*").alias("rounds"),
        F.round(F.max_by("auto_mapped_rate", "round_no") - F.min_by("auto_mapped_rate", "round_no"), 1).alias("delta"))


def round_history(runs: DataFrame) -> DataFrame:
    """Rounds with the growth over the round before."""
    before = F.lag("auto_mapped_rate").over(Window.partitionBy("file_id").orderBy("round_no"))
    return runs.withColumn("growth", F.col("auto_mapped_rate") - before)


def ingestion_audit(records: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Counters per file: values, numeric failures, flags, columns and source rows.

    ``rows`` (file_id, source_row) gives row counts including rows without any
    value; without it only rows that produced a record are counted.
    """
    found = records.groupBy("file_id").agg(
        F.count("*").alias("inserted_values"), F.count_if(~F.col("is_numeric")).alias("non_numeric_values"),
        F.count_if(F.col("quality_flag").isNotNull()).alias("flagged_values"),
        F.count_distinct("source_column_index").alias("measured_columns"))
    if rows is None:
        return found
    return rows.groupBy("file_id").agg(F.count("*").alias("source_rows")).join(found, "file_id", "left").na.fill(
        0, ["inserted_values", "non_numeric_values", "flagged_values", "measured_columns"])


def file_overview(files: DataFrame, runs: DataFrame, reviews: DataFrame, measurements: DataFrame) -> DataFrame:
    """Files with their latest round, open reviews, measured period and status."""
    last = latest_round(runs).select("file_id", F.col("total_columns").alias("column_count"),
                                     "dictionary_version", "auto_mapped_rate")
    pending = reviews.groupBy("file_id").agg(F.count_if(F.col("verdict").isNull()).alias("pending_reviews"))
    period = measurements.groupBy("file_id").agg(F.min("measured_on").alias("measured_from"),
                                                 F.max("measured_on").alias("measured_to"))
    return (files.join(last, "file_id", "left").join(pending, "file_id", "left").join(period, "file_id", "left")
            .na.fill(0, ["pending_reviews"])
            .withColumn("review_state", F.when(F.col("column_count").isNull(), F.col("status")).when(
                F.col("pending_reviews") > 0, "reviewing").otherwise("completed")))


def owner_inventory(files: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Row counts per owner and table, plus stored bytes.

    Child tables are counted per file before they meet the file table.
    """
    own = files.select("file_id", "owner_user_id")
    parts = [files.groupBy("owner_user_id").agg(F.count("*").alias("n")).withColumn("table_name", F.lit("files")),
             files.groupBy("owner_user_id").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n")).withColumn(
                 "table_name", F.lit("stored_bytes"))]
    for name, child in children.items():
        per_file = child.groupBy("file_id").agg(F.count("*").alias("n"))
        parts.append(per_file.join(own, "file_id").groupBy("owner_user_id").agg(F.sum("n").alias("n")).withColumn(
            "table_name", F.lit(name)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def files_with_status(files: DataFrame, owner: int, status: str) -> DataFrame:
    """One owner's files in one state."""
    return files.where((F.col("owner_user_id") == owner) & (F.col("status") == status))


def source_audit(measurements: DataFrame, files: DataFrame, item_code: str, site: str | None = None) -> DataFrame:
    """Where one item's rows come from: counts, period and value range per file."""
    part = measurements.where(F.col("item_code") == item_code)
    if site is not None:
        part = part.where(F.col("site_name") == site)
    per_file = part.groupBy("file_id").agg(
        F.count("*").alias("item_rows"), F.min("measured_on").alias("first_date"),
        F.max("measured_on").alias("last_date"), F.min("value_num").alias("min_value"),
        F.max("value_num").alias("max_value"))
    return per_file.join(files.select("file_id", "owner_user_id", "original_filename"), "file_id")


def source_audit_by_site(measurements: DataFrame, files: DataFrame, item_code: str) -> DataFrame:
    """Sites and files with rows of one item."""
    per_site = measurements.where(F.col("item_code") == item_code).groupBy(
        "file_id", F.coalesce("site_name", F.lit("(NULL)")).alias("site_name")).agg(
        F.count("*").alias("item_rows"), F.min("measured_on").alias("first_date"),
        F.max("measured_on").alias("last_date"))
    return per_site.join(files.select("file_id", "owner_user_id", "original_filename"), "file_id")
