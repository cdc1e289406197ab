"""Idempotent table changes: replace, upsert, purge, merge of sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import names
from hydromelt.operators.joins import checked_broadcast


def replace_by_file(current: DataFrame, fresh: DataFrame, loaded: DataFrame | None = None, key: str = "file_id") -> DataFrame:
    """The table with every loaded file replaced by its new rows.

    ``loaded`` lists the files of the load; without it these are the files that ``fresh`` has rows of.
    """
    gone = (fresh if loaded is None else loaded).select(key).distinct()
    return current.join(gone, key, "left_anti").unionByName(fresh)


def current_rows(stored: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows of the newest load of each file in a table of appended loads.

    ``audit`` has one row per file and load, also for loads that gave no value, so a
    file that became empty disappears. Up to a million files, no stored row is shuffled.
    """
    newest = audit.groupBy("file_id").agg(F.max("batch_id").alias("batch_id"))
    return stored.join(checked_broadcast(newest, C.BROADCAST_FILES), ["file_id", "batch_id"], "left_semi")


def newest_records(stored: DataFrame, keys: tuple[str, ...] = ("file_id", "source_row", "source_column_index"),
                   order: str = "batch_id") -> DataFrame:
    """One record per source cell: the one landed last."""
    rest = [c for c in stored.columns if c not in (*keys, order)]
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], updated: list[str],
           order: str | None = None) -> DataFrame:
    """Insert new keys and overwrite the ``updated`` columns of known ones.

    Other columns keep their first value. Null keys equal each other. Within
    ``changes`` the row with the highest ``order`` wins. One pre-aggregated
    shuffle on the key.
    """
    columns = current.columns
    kept = [c for c in columns if c not in keys and c not in updated]
    rank = F.col(order) if order else F.lit(0)
    both = current.select("*", F.lit(0).alias("_new"), F.lit(None).cast(
        dict(changes.dtypes)[order] if order else "int").alias("_ord")).unionByName(
        changes.select(*columns, F.lit(1).alias("_new"), rank.alias("_ord")))
    at = F.struct("_new", "_ord")
    picks = [F.max_by(F.struct(*updated), at).alias("_u")]
    if kept:
        picks.append(F.min_by(F.struct(*kept), at).alias("_k"))
    merged = both.groupBy(*keys).agg(*picks)
    return merged.select(*[F.col(c) if c in keys else F.col(f"_u.{c}") if c in updated else F.col(f"_k.{c}")
                           for c in columns])


def purge_files(tables: dict[str, DataFrame], files: DataFrame, owner: int) -> dict[str, DataFrame]:
    """All tables without the files of one owner and everything that hangs on them."""
    gone = files.where(F.col("owner_user_id") == owner).select("file_id")
    left = {name: df.join(gone, "file_id", "left_anti") for name, df in tables.items()}
    left["files"] = files.where(~F.col("owner_user_id").eqNullSafe(owner))
    return left


def latest_round_rows(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the newest round per file that has any rows at all."""
    loaded = rows.select("mapping_run_id").distinct().join(
        runs.select("mapping_run_id", "file_id", "round_no"), "mapping_run_id")
    newest = loaded.groupBy("file_id").agg(F.max("round_no").alias("round_no"))
    keep = loaded.join(newest, ["file_id", "round_no"]).select("mapping_run_id")
    return rows.join(keep, "mapping_run_id", "left_semi")


def backfill_index(measurements: DataFrame, columns: DataFrame) -> DataFrame:
    """Column index from the mapping of the same run and name; the leftmost on repeats."""
    index = columns.groupBy("mapping_run_id", F.col("raw").alias("source_column")).agg(
        F.min("column_index").alias("source_column_index"))
    return measurements.drop("source_column_index").join(index, ["mapping_run_id", "source_column"], "left")


def merge_sightings(queue: DataFrame, sightings: DataFrame) -> DataFrame:
    """Unresolved-name queue after new sightings: new names enter, known ones count up.

    queue: surface, source_id, first_seen_on, last_seen_on, seen_count, status;
    sightings: surface, source_id, seen_on.
    """
    new = sightings.select("surface", "source_id", F.col("seen_on").alias("first_seen_on"),
                           F.col("seen_on").alias("last_seen_on"), F.lit(1).cast("bigint").alias("seen_count"),
                           F.lit(None).cast("string").alias("status"))
    both = queue.select(*new.columns, F.lit(0).alias("_new")).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(names.wq_normalize(F.col("surface")).alias("surface_norm"),
                        F.coalesce("source_id", F.lit("")).alias("_source")).agg(
        F.min_by("surface", F.struct("_new", "first_seen_on", "surface")).alias("surface"),
        F.min("first_seen_on").alias("first_seen_on"), F.max("last_seen_on").alias("last_seen_on"),
        F.sum("seen_count").alias("seen_count"),
        F.coalesce(F.max("status"), F.lit("pending")).alias("status")).select(
        "surface_norm", F.nullif("_source", F.lit("")).alias("source_id"), "surface", "first_seen_on",
        "last_seen_on", "seen_count", "status")


def promote_sightings(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new synonyms, updated queue) for decided queue rows.

    decisions: id, code, reviewer. Unknown ids are an error for the caller to
    check with :func:`unknown_decisions`.
    """
    took = queue.join(decisions.select("id", "code", "reviewer"), "id")
    synonyms = took.select(
        F.when(F.col("code").startswith(C.MEASUREMENT_PREFIX), F.col("code")).alias("measurement_code"),
        F.when(F.col("code").startswith(C.METADATA_PREFIX), F.col("code")).alias("metadata_code"),
        "surface", F.coalesce("source_id", F.lit("MANUAL")).alias("source_id"),
        F.col("first_seen_on").alias("collected_on"), F.lit("column_name").alias("synonym_type"),
        F.lit("verified").alias("review_status"), F.col("reviewer").alias("reviewed_by"))
    decided = decisions.select("id", F.col("reviewer").alias("_by"))
    updated = queue.join(decided, "id", "left").withColumn(
        "status", F.when(F.col("_by").isNotNull(), "promoted").otherwise(F.col("status"))).withColumn(
        "resolved_by", F.coalesce("_by", "resolved_by")).drop("_by")
    return synonyms, updated


def unknown_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(queue.select("id"), "id", "left_anti")


def open_sightings(queue: DataFrame) -> DataFrame:
    """Names still to be decided, the most seen first."""
    return queue.where(F.col("status") == "pending").orderBy(F.col("seen_count").desc(), "surface_norm", "source_id")
