"""Structured Streaming jobs; each shares its logic with a batch operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hydromelt.operators import melt, tables
from hydromelt.operators import usage as usage_ops
from hydromelt.sources import ndjson, sinks
from hydromelt.sources.snapshots import Store

#: Which files each load sent.
SENDINGS = "sendings"
#: Landed request counts, and how long a second is counted: the longest total's days and one for late requests.
USAGE, USAGE_HORIZON = "usage", "31 days"


def rate_counts(usage: DataFrame) -> DataFrame:
    """Requests per key and minute."""
    return usage.groupBy("api_key_id", F.date_trunc("minute", "requested_at").alias("minute")).agg(F.count("*").alias("requests"))


def land_rate_counts(usage: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Count requests as they arrive: each micro-batch lands its own counts under its number.

    However late a request is, it counts; a replayed batch replaces itself. Reading adds the parts up.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        sinks.write_partitions(rate_counts(batch).withColumn("batch_id", F.lit(batch_id)), path, ("batch_id",))

    return (usage.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_rate_counts(spark: SparkSession, path: str) -> DataFrame:
    """Landed requests per key and minute."""
    return spark.read.parquet(path).groupBy("api_key_id", "minute").agg(F.sum("requests").alias("requests"))


def breaches(counted: DataFrame, allowed: int) -> DataFrame:
    return counted.where(F.col("requests") > allowed).withColumn("refused", F.col("requests") - allowed)


def land_usage(usage: DataFrame, store: str, checkpoint: str, horizon: str = USAGE_HORIZON) -> StreamingQuery:
    """Count requests per organisation and second as they arrive, for rolling totals.

    Those at the very start of a second are told from those within it, so totals as of a whole second are exact.
    Spark's state holds each second's counts until the newest request is ``horizon`` past it; then the state goes, and what
    comes later for it no longer matters to any total. Every micro-batch commits the counts it changed.
    """
    sharp = F.col("requested_at") == F.date_trunc("second", "requested_at")
    counted = usage.withWatermark("requested_at", horizon).groupBy(
        "organization_id", F.window("requested_at", "1 second").alias("w")).agg(
        F.count("*").alias("requests"), F.count_if(sharp).alias("at_start"))

    def land(batch: DataFrame, batch_id: int) -> None:
        part = batch.select("organization_id", F.col("w.start").alias("second"), "requests", "at_start",
                            F.lit(batch_id).cast("long").alias("batch_id"))
        Store(batch.sparkSession, store).commit({(USAGE, f"{batch_id:012d}"): part})

    return (counted.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _seconds(stored: DataFrame) -> DataFrame:
    """The last counts of each organisation and second."""
    return stored.groupBy("organization_id", "second").agg(
        F.max_by("requests", "batch_id").alias("requests"), F.max_by("at_start", "batch_id").alias("at_start"),
        F.max("batch_id").alias("batch_id"))


def read_usage(spark: SparkSession, store: str, as_of: Column) -> DataFrame:
    """Requests per organisation in the last 24 hours and 30 days before the second that ``as_of`` lies in began."""
    return usage_ops.recent_counts(_seconds(Store(spark, store).read(USAGE)), as_of)


def compact_usage(spark: SparkSession, store: str, horizon: str = USAGE_HORIZON) -> int:
    """Rewrite the landed counts as one part: the last of each second, and none past the horizon."""
    held = Store(spark, store)
    now = held.manifest()
    seconds = _seconds(held.read(USAGE, now["version"]))
    newest = seconds.agg(F.max("second")).first()[0]
    live = seconds.where(F.col("second") >= F.lit(newest) - F.expr(f"INTERVAL {horizon}")) if newest else seconds
    return held.compact({USAGE: live.hint("rebalance")}, now)


def _land(stream: DataFrame, records: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> StreamingQuery:
    """Commits, for every micro-batch, its records and the sendings (file_id, load_id) it holds, both or neither.

    A replayed batch replaces itself. A sending is known by any line of it, so a file whose newest sending has no
    record is empty.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        key = f"{checkpoint}#{batch_id}"
        place = F.lit(batch_id).cast("long").alias("batch_id")
        Store(batch.sparkSession, store).commit({
            (sinks.MEASUREMENTS, key): records(batch).select("*", place),
            (SENDINGS, key): batch.select("file_id", "load_id").distinct()})

    return (stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _read(spark: SparkSession, store: str) -> DataFrame:
    """Records of each file's newest sending, one per source cell: the one landed last."""
    held = Store(spark, store)
    version = held.manifest()["version"]
    newest = held.read(SENDINGS, version).groupBy("file_id").agg(F.max("load_id").alias("load_id"))
    stored = held.read(sinks.MEASUREMENTS, version).join(newest, ["file_id", "load_id"], "left_semi")
    return tables.newest_records(stored).drop("load_id")


def land_records(lines: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Land NDJSON lines (file_id, value) as they arrive.

    A file may span batches. ``load_id``, if the stream has it, numbers the sendings of a file: a later one takes the place of
    all earlier ones, also if it has only a meta line or a blank one. Without it all lines of a file are one sending.
    """
    if "load_id" not in lines.columns:
        lines = lines.withColumn("load_id", F.lit(0).cast("long"))
    return _land(lines, ndjson.parse_lines, store, checkpoint)


def read_records(spark: SparkSession, store: str) -> DataFrame:
    """Landed records of each file's newest sending."""
    return _read(spark, store)


def land_cells(cells: DataFrame, store: str, checkpoint: str, as_of, load_id: int = 0) -> StreamingQuery:
    """Parse long text cells as they arrive; ``load_id`` numbers the sendings, so that a file sent again replaces itself.

    A cell without a row number only announces its file, which may have no other.
    """
    def typed(batch: DataFrame) -> DataFrame:
        return melt.typed_records(batch.where("source_row is not null"), F.lit(as_of)).withColumn("load_id", number)

    number = F.lit(load_id).cast("long")
    return _land(cells.withColumn("load_id", number), typed, store, checkpoint)


def read_cells(spark: SparkSession, store: str) -> DataFrame:
    """Landed records of each file's newest sending, one per source cell."""
    return _read(spark, store)


def accumulate_sightings(sightings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge unresolved-name sightings (surface, source_id, seen_on) into a queue.

    Every batch writes its own pre-aggregated part under its batch id; reading
    merges the parts, so a replayed batch replaces itself and counts once.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        empty = batch.sparkSession.createDataFrame(
            [], "surface string, source_id string, first_seen_on date, last_seen_on date, "
                "seen_count bigint, status string")
        part = tables.merge_sightings(empty, batch).withColumn("batch_id", F.lit(batch_id))
        sinks.write_partitions(part, path, ("batch_id",))

    return (sightings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_sightings(spark: SparkSession, path: str) -> DataFrame:
    """The accumulated queue."""
    parts = spark.read.parquet(path).drop("batch_id")
    return tables.merge_sightings(parts, spark.createDataFrame([], "surface string, source_id string, seen_on date"))
