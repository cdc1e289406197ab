"""From mapped files to stored measurements."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.operators import matching, melt, summaries, tables
from hydromelt.operators.joins import checked_broadcast
from hydromelt.session import stage
from hydromelt.sources import ndjson, sinks
from hydromelt.sources.snapshots import Store


def layouts_of(columns: DataFrame, data: DataFrame, units: DataFrame | None = None,
               priority: bool = False) -> DataFrame:
    """Roles and measured columns per file."""
    return melt.file_layouts(columns, melt.sample_type_columns(columns, data), units, priority)


def records_of(columns: DataFrame, data: DataFrame, as_of: date, overrides: DataFrame | None = None,
               units: DataFrame | None = None) -> DataFrame:
    """Measurement records of mapped files, reviewed codes applied first."""
    if overrides is not None:
        columns = matching.apply_overrides(columns, overrides)
    # The layouts are read twice, to see their number and to join them; finding them reads the data.
    return melt.melt(data, stage(layouts_of(columns, data, units), "layouts"), F.lit(as_of))


def ingest(columns: DataFrame, data: DataFrame, store: str, as_of: date,
           dictionary_version: str, overrides: DataFrame | None = None, units: DataFrame | None = None,
           batch_id: int | None = None, ran_at: datetime | None = None) -> DataFrame:
    """Load the measurements of these files, in place of what was stored of them, with their audit rows, in one commit.

    Every load is added under its batch number, by default the time in microseconds; readers see the newest load of each
    file through :func:`stored_measurements`, so a file that lost all its values is empty there. ``columns`` may carry
    the mapping_run_id they come from.
    """
    ran_at = ran_at or datetime.now(timezone.utc)
    batch_id = int(ran_at.timestamp() * 1_000_000) if batch_id is None else batch_id
    records = records_of(columns, data, as_of, overrides, units)
    loaded = data.select("file_id", "source_row")
    if "mapping_run_id" in columns.columns:
        runs = columns.select("file_id", "mapping_run_id").distinct()
        records = records.join(checked_broadcast(runs, C.BROADCAST_FILES), "file_id", "left")

    def audit(written: DataFrame) -> DataFrame:
        rows = summaries.ingestion_audit(written, loaded).withColumns({
            "dictionary_version": F.lit(dictionary_version), "ran_at": F.lit(ran_at)})
        return rows.join(runs, "file_id", "left") if "mapping_run_id" in columns.columns else rows

    return sinks.append_load(data.sparkSession, records, audit, store, batch_id)


def newest_mapping(runs: DataFrame, columns: DataFrame, reviews: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(columns, overrides) of the newest mapping run of each file.

    runs: mapping_run_id, file_id, round_no; columns: mapping_run_id and the mapped columns; reviews: file_id, column_index,
    code, dict_type of columns decided by a person, which override the mapping.
    """
    newest = runs.groupBy("file_id").agg(F.max_by("mapping_run_id", F.struct("round_no", "mapping_run_id")).alias("mapping_run_id"))
    chosen = columns.join(newest.select("mapping_run_id"), "mapping_run_id", "left_semi")
    if reviews is None:
        reviews = chosen.where("false").select("file_id", "column_index", "code", "dict_type")
    return chosen, reviews.where("code is not null").select("file_id", "column_index", "code", "dict_type")


def stored_measurements(spark: SparkSession, store: str) -> DataFrame:
    """The current measurements: those of the newest load of each file, all as of one commit."""
    held = Store(spark, store)
    version = held.manifest()["version"]
    return tables.current_rows(held.read(sinks.MEASUREMENTS, version), held.read(sinks.RUNS, version))


def stored_runs(spark: SparkSession, store: str) -> DataFrame:
    """The audit rows of the newest load of each file."""
    runs = Store(spark, store).read(sinks.RUNS)
    return tables.current_rows(runs, runs)


def export_ndjson(records: DataFrame, meta: DataFrame, path: str) -> None:
    """Records and meta lines as NDJSON, split into many part files."""
    ndjson.record_lines(records).select("value").write.mode("overwrite").text(f"{path}/rows")
    ndjson.meta_lines(meta).select("value").write.mode("overwrite").text(f"{path}/meta")
