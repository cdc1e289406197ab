"""Table and report outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.operators.tables import current_rows
from hydromelt.session import stage
from hydromelt.sources.snapshots import Store

BOM = "﻿"


def write_partitions(df: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Replace exactly the partitions present in ``df``; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


MEASUREMENTS, RUNS, LIMITS = "measurements", "ingestion_runs", "limits"


def append_load(spark: SparkSession, records: DataFrame, audit: Callable[[DataFrame], DataFrame], store: str, batch_id: int) -> DataFrame:
    """Add one load, its records and one audit row per loaded file, under its batch number and in one commit; returns the audit.

    Records are written once, by the tasks that make them: they are the largest thing here, so they are not shuffled for it, and stay in the order
    of their rows, in which they pack best. ``audit`` makes the audit rows from what was written. Repeating a load replaces it, unless a
    compaction has taken it in: then nothing is written. Nothing old is rewritten: readers
    go through :func:`hydromelt.operators.tables.current_rows`, which knows emptied files from the audit.
    """
    held, key, number = Store(spark, store), str(batch_id), F.lit(batch_id)
    if key in held.manifest()["folded"]:
        return audit(records)
    part = held.write(MEASUREMENTS, key, records.withColumn("batch_id", number))
    runs = held.write(RUNS, key, audit(held.open(part).drop("batch_id")).withColumn("batch_id", number))
    held.commit({(MEASUREMENTS, key): part, (RUNS, key): runs})
    return held.open(runs).drop("batch_id")


def compact_loads(spark: SparkSession, store: str) -> int:
    """Rewrite a store of loads as one part per table that holds only each file's newest load.

    Records are written as they are read: Spark reads many small files in one task.
    """
    held = Store(spark, store)
    now = held.manifest()
    runs = held.read(RUNS, now["version"])
    records = current_rows(held.read(MEASUREMENTS, now["version"]), runs)
    return held.compact({MEASUREMENTS: records, RUNS: current_rows(runs, runs).hint("rebalance")}, now)


def replace_standard_set(fresh: DataFrame, store: str, standard_set: str = C.DEFAULT_STANDARD_SET) -> int:
    """Swap one stored set of limits for the rows ``fresh`` has of it, or drop it if there are none, in one commit."""
    rows = stage(fresh.where(F.col("standard_set").eqNullSafe(standard_set)), "limits")
    return Store(fresh.sparkSession, store).commit({(LIMITS, standard_set): None if rows.isEmpty() else rows})


def stored_limits(spark: SparkSession, store: str) -> DataFrame:
    """All stored sets."""
    return Store(spark, store).read(LIMITS)


def csv_line(columns: list[Column]) -> Column:
    """One CSV line with quoting where a cell needs it."""
    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(
            F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[cell(c) for c in columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with a header and a byte-order mark, for spreadsheet programs."""
    first, *rest = df.columns
    marked = df.select(F.col(f"`{first}`").alias(BOM + first), *[F.col(f"`{c}`") for c in rest])
    marked.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def mapped_lines(data: DataFrame, names: DataFrame) -> DataFrame:
    """Lines of the mapped wide files: header line 0, then the rows of each file.

    ``names``: file_id and the ordered list of unique output names.
    """
    line = lambda cells: F.array_join(F.transform(cells, lambda c: F.when(
        F.coalesce(c, F.lit("")).rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    ).otherwise(F.coalesce(c, F.lit("")))), ",")
    header = names.select("file_id", F.lit(0).cast("bigint").alias("line_no"),
                          F.concat(F.lit(BOM), line(F.col("names"))).alias("value"))
    body = data.join(names, "file_id").select(
        "file_id", (F.col("source_row") + 1).alias("line_no"),
        line(F.transform("names", lambda _, i: F.get("cells", i))).alias("value"))
    return header.unionByName(body)


def write_mapped_files(data: DataFrame, columns: DataFrame, path: str, stem: str = "stem") -> None:
    """One folder ``stem=…`` per source file holding its mapped CSV in row order.

    Rows are range-partitioned by file and line, so a large file becomes
    several ordered part files; only the first carries the header.
    """
    names = columns.groupBy("file_id", stem).agg(F.transform(F.array_sort(F.collect_list(
        F.struct("column_index", "unique_column"))), lambda s: s["unique_column"]).alias("names"))
    lines = mapped_lines(data, names.drop(stem)).join(names.select("file_id", stem), "file_id")
    (lines.repartitionByRange("file_id", "line_no").sortWithinPartitions("file_id", "line_no")
     .select(stem, "value").write.mode("overwrite").partitionBy(stem).text(path))


def file_reports(columns: DataFrame, summaries: DataFrame) -> DataFrame:
    """One nested report row per file: its summary and its columns in order.

    A file's columns are as many as the file is wide.
    """
    listed = columns.withColumn("any_code", F.coalesce("code", "candidate_code"))
    entry = F.struct("column_index", *[F.col(c).alias(key) for c, key in C.REPORT_COLUMN_KEYS.items()])
    lists = listed.groupBy("file_id", "filename", "header_row").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda c: c.dropFields("column_index")).alias("columns"))
    total = F.struct(*[F.col(c).alias(key) for c, key in C.REPORT_SUMMARY_KEYS.items()])
    return lists.join(summaries.select("file_id", total.alias("summary")), "file_id").select(
        *[F.col(c).alias(key) for c, key in C.REPORT_KEYS.items()], "columns", "summary")


def write_report(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_log(log: DataFrame, path: str, key: str) -> None:
    """Add one batch of log lines under its key; the same batch again takes its own place."""
    write_csv(log, f"{path}/queue={key}")
