"""Queries over the usage log and the streaming jobs."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt.catalog import standins as S
from hydromelt.catalog.registry import Topic
from hydromelt.operators import usage
from hydromelt.session import scratch_root
from hydromelt.sources import ndjson
from hydromelt.streaming import jobs

query = Topic()


def _usage_columns(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("api_key_id"), F.length("event_type").cast("bigint").alias("organization_id"),
                         F.col("ts").alias("requested_at"))


def _log(spark, folder) -> DataFrame:
    return _usage_columns(S.table(spark, folder, "events"))


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = S.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _places(spark: SparkSession, name: str) -> tuple[str, str]:
    root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/checkpoint"


_RECENT = """SELECT CAST(length(event_type) AS BIGINT) AS organization_id,
  CAST(count(*) FILTER (ts >= TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS BIGINT) AS last_24_hours,
  CAST(count(*) FILTER (ts >= TIMESTAMP '2023-12-21 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS BIGINT) AS last_30_days
  FROM events GROUP BY 1"""


@query(_RECENT)
def usage_recent(spark, folder):
    return usage.recent_usage(_log(spark, folder), F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00'"))


@query(_RECENT)
def stream_usage(spark, folder):
    """The same totals from counts that a stream keeps, after its parts were compacted."""
    path, checkpoint = _places(spark, "usage")
    requests = _usage_columns(_event_stream(spark, folder)).withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    jobs.land_usage(requests, path, checkpoint, horizon="400 days").awaitTermination()
    jobs.compact_usage(spark, path, horizon="400 days")
    return jobs.read_usage(spark, path, F.expr("TIMESTAMP '2024-01-20 12:00:00'"))


_MINUTES = "SELECT user_id AS api_key_id, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY 1, 2"


@query(f"""SELECT api_key_id, strftime(minute, '%Y-%m-%d %H:%M') AS minute, CAST(requests AS BIGINT) AS requests,
  CAST(requests - 1 AS BIGINT) AS refused FROM ({_MINUTES}) WHERE requests > 1""")
def rate_breach(spark, folder):
    """Minutes in which a key sent more than one request."""
    return usage.rate_breaches(_log(spark, folder), default_limit=1).select(
        "api_key_id", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "requests", "refused")


@query(f"""SELECT api_key_id, strftime(minute, '%Y-%m-%d %H:%M') AS minute, CAST(requests AS BIGINT) AS requests FROM ({_MINUTES})""")
def stream_rate(spark, folder):
    """Requests per key and minute, counted by a stream into a table."""
    path, checkpoint = _places(spark, "rate")
    jobs.land_rate_counts(_usage_columns(_event_stream(spark, folder)), path, checkpoint).awaitTermination()
    return jobs.read_rate_counts(spark, path).withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query(f"""SELECT event_id AS source_row, event_type AS item_code, CASE WHEN event_type <> 'view' THEN CAST(value AS DOUBLE) END AS value_num,
  CASE WHEN event_type = 'view' THEN 'non_numeric' WHEN CAST(ts AS DATE) > DATE '2024-01-15' THEN 'future_date' END AS quality_flag FROM events""")
def stream_ingest(spark, folder):
    """Text cells typed and landed as they arrive."""
    path, checkpoint = _places(spark, "ingest")
    jobs.land_cells(_event_cells(spark, folder), path, checkpoint, date(2024, 1, 15)).awaitTermination()
    return jobs.read_cells(spark, path).select("source_row", "item_code", F.col("value_num").cast("double").alias("value_num"),
                                               "quality_flag")


@query(f"""SELECT event_type AS file_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(value) FILTER (event_type <> 'view') AS DOUBLE) AS total
  FROM events WHERE event_type <> 'click' OR event_id % 3 = 0 GROUP BY 1""")
def stream_resend(spark, folder):
    """A file sent again with fewer cells keeps none of its old ones; a repeated sending changes nothing."""
    path, checkpoint = _places(spark, "resend")
    cells = _event_cells(spark, folder).withColumn("file_id", F.col("item_code"))
    again = cells.where((F.col("item_code") == "click") & (F.col("source_row") % 3 == 0))
    for load_id, sent in ((1, cells), (2, again), (3, again)):
        jobs.land_cells(sent, path, f"{checkpoint}-{load_id}", date(2024, 1, 15), load_id).awaitTermination()
    return jobs.read_cells(spark, path).groupBy("file_id").agg(
        F.count("*").alias("n"), F.sum("value_num").cast("double").alias("total"))


@query("""SELECT CAST(user_id % 7 AS BIGINT) AS file_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(value) AS DOUBLE) AS total FROM events
  WHERE user_id % 7 > 1 OR (user_id % 7 = 1 AND event_id % 3 = 0) GROUP BY 1""")
def stream_replace(spark, folder):
    """NDJSON lines landed by a stream: a file sent again with fewer lines, and one sent again with its meta line only."""
    path, checkpoint = _places(spark, "replace")
    events = _event_stream(spark, folder).withColumn("file_id", F.col("user_id") % 7)
    rows = events.select("file_id", F.col("event_id").alias("source_row"), F.lit(0).alias("source_column_index"),
                         F.lit("WQ-001").alias("item_code"), F.col("value").cast("decimal(18,6)").alias("value_num"))
    fewer = rows.where("file_id = 1 and source_row % 3 = 0")
    meta = ndjson.meta_lines(events.where("file_id = 0").select("file_id", F.lit(0).alias("source_rows")))
    for load_id, lines in ((1, ndjson.record_lines(rows)), (2, ndjson.record_lines(fewer)), (3, meta), (3, meta)):
        jobs.land_records(lines.withColumn("load_id", F.lit(load_id).cast("long")), path, f"{checkpoint}-{load_id}").awaitTermination()
    return jobs.read_records(spark, path).groupBy("file_id").agg(
        F.count("*").alias("n"), F.sum("value_num").cast("double").alias("total"))


def _event_cells(spark, folder) -> DataFrame:
    """Events as a stream of text cells."""
    return _event_stream(spark, folder).select(
        F.lit("f").alias("file_id"), F.col("event_id").alias("source_row"), F.lit("c").alias("source_column"),
        F.lit(0).alias("source_column_index"), F.lit(None).cast("string").alias("site_name"),
        F.lit(None).cast("string").alias("outlet"), F.lit(None).cast("string").alias("sample_type"),
        F.col("ts").cast("date").alias("measured_on"), F.lit(None).cast("string").alias("period_label"),
        F.col("event_type").alias("item_code"), F.lit(None).cast("string").alias("unit"),
        F.when(F.col("event_type") == "view", "불검출").otherwise(S.money("value")).alias("text"),
        F.lit(None).cast("string").alias("limit_text"))


@query("""SELECT lower(event_type) || user_id AS surface_norm, CAST(NULL AS VARCHAR) AS source_id, event_type || ' ' || user_id AS surface,
  CAST(min(ts) AS DATE) AS first_seen_on, CAST(max(ts) AS DATE) AS last_seen_on, CAST(count(*) AS BIGINT) AS seen_count,
  'pending' AS status FROM events GROUP BY 1, 3""")
def stream_unresolved(spark, folder):
    """Unresolved names accumulated over a stream."""
    path, checkpoint = _places(spark, "unresolved")
    sightings = _event_stream(spark, folder).select(
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("surface"),
        F.lit(None).cast("string").alias("source_id"), F.col("ts").cast("date").alias("seen_on"))
    jobs.accumulate_sightings(sightings, path, checkpoint).awaitTermination()
    return jobs.read_sightings(spark, path)
