"""Newline-delimited JSON exchange of measurement records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import schemas
from hydromelt.sources.files import plain_path

_FIELDS = ("source_row", "source_column", "source_column_index", "site_name", "outlet", "sample_type",
           "measured_on", "period_label", "item_code", "unit", "value_num", "value_text", "is_numeric",
           "reported_limit", "quality_flag")


def record_lines(records: DataFrame) -> DataFrame:
    """Measurement records as JSON lines."""
    fields = [F.lit("row").alias("kind"), *[F.col(f) for f in _FIELDS if f in records.columns]]
    return records.select("file_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def meta_lines(meta: DataFrame) -> DataFrame:
    """One JSON line of ingestion facts per file."""
    fields = [F.lit("meta").alias("kind"), *[F.col(c) for c in meta.columns if c != "file_id"]]
    return meta.select("file_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to typed records, missing fields filled; meta and blank lines dropped."""
    row = F.from_json(F.col(value), schemas.MEASUREMENT_ROW)
    rest = [c for c in lines.columns if c != value]
    part = lines.where(F.trim(F.col(value)) != "").select(*rest, row.alias("r")).where(
        ~F.col("r.kind").eqNullSafe("meta")).select(*rest, "r.*").drop("kind")
    return with_defaults(part)


def with_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "source_column": F.coalesce("source_column", F.lit("")),
        "source_column_index": F.coalesce("source_column_index", F.lit(0)),
        "source_row": F.coalesce("source_row", F.lit(0)),
        "item_code": F.coalesce("item_code", F.lit("")),
        "is_numeric": F.coalesce("is_numeric", F.lit(True))})


def parse_meta(lines: DataFrame, value: str = "value") -> DataFrame:
    meta = F.from_json(F.col(value), schemas.INGEST_META)
    rest = [c for c in lines.columns if c != value]
    return lines.select(*rest, meta.alias("m")).where(F.col("m.kind") == "meta").select(*rest, "m.*").drop("kind")


def read_records(spark: SparkSession, path: str, file_id: Column | None = None) -> DataFrame:
    """Records of NDJSON files; each file stands for one source file."""
    lines = spark.read.text(path).select(
        (plain_path(F.col("_metadata.file_path")) if file_id is None else file_id).alias("file_id"), "value")
    return parse_lines(lines)
