"""Header detection and naming over raw cell grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import values
from hydromelt.operators.numbering import running_number


def header_rows(cells: DataFrame, scan_rows: int = C.HEADER_SCAN_ROWS) -> DataFrame:
    """The most header-like of the first rows of each file; the topmost wins ties.

    Score: texts that are neither blank nor numbers, plus one when all filled
    cells of the row differ.
    """
    filled = F.filter("cells", lambda c: c.isNotNull() & (values.strip(c) != ""))
    texts = F.size(F.filter("filled", lambda c: ~values.is_number_like(c) & ~c.rlike(
        r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")))
    top = cells.where(F.col("row_idx") < scan_rows).select("file_id", "row_idx", filled.alias("filled"))
    scored = top.withColumn("score", texts).withColumn("score", F.col("score") + F.when(
        (F.col("score") > 0) & (F.size(F.array_distinct("filled")) == F.size("filled")), 1).otherwise(0))
    return scored.groupBy("file_id").agg(
        F.max_by("row_idx", F.struct("score", -F.col("row_idx"))).alias("header_row"),
        F.max("score").alias("header_score"))


def file_columns(cells: DataFrame, headers: DataFrame, scan_rows: int = C.HEADER_SCAN_ROWS) -> DataFrame:
    """Column names per file, blanks filled from group headers above.

    Going up from the header row, rows with fewer than two labels end the
    group headers, so a title line is never absorbed.
    """
    top = (cells.where(F.col("row_idx") < scan_rows).join(headers.select("file_id", "header_row"), "file_id")
           .where(F.col("row_idx") <= F.col("header_row"))
           .withColumn("cells", F.transform("cells", lambda c: F.coalesce(values.strip(c), F.lit("")))))
    labels = F.size(F.filter("cells", lambda c: c != ""))
    stops = top.groupBy("file_id").agg(F.coalesce(F.max(F.when(
        (F.col("row_idx") < F.col("header_row")) & (labels < C.MERGED_HEADER_MIN_LABELS),
        F.col("row_idx"))), F.lit(-1)).alias("stop"))
    each = (top.join(stops, "file_id").where(F.col("row_idx") > F.col("stop"))
            .select("file_id", "row_idx", F.posexplode("cells").alias("column_index", "label")))
    name = F.max_by(F.when(F.col("label") != "", F.col("label")),
                    F.when(F.col("label") != "", F.col("row_idx")))
    return each.groupBy("file_id", "column_index").agg(name.alias("name")).select(
        "file_id", "column_index", F.coalesce("name", F.concat(
            F.lit(C.UNNAMED_PREFIX), F.col("column_index").cast("string"))).alias("raw"))


def data_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header, numbered from 0."""
    return (cells.join(headers.select("file_id", "header_row"), "file_id")
            .where(F.col("row_idx") > F.col("header_row"))
            .withColumn("source_row", F.col("row_idx") - F.col("header_row") - 1)
            .drop("row_idx", "header_row"))


def unique_output_names(columns: DataFrame, keys: tuple[str, ...] = ("file_id",),
                        name: str = "output_column", position: str = "column_index") -> DataFrame:
    """Repeated names of a file get #2, #3, … in column order."""
    numbered = running_number(columns, [*keys, name], position, "_nth")
    return numbered.withColumn("unique_column", F.when(F.col("_nth") == 1, F.col(name)).otherwise(
        F.concat(name, F.lit("#"), F.col("_nth").cast("string")))).drop("_nth")


def preview(data: DataFrame, rows: int = C.PREVIEW_ROW_LIMIT) -> DataFrame:
    """First rows of each file as texts, with the file's row count."""
    totals = data.groupBy("file_id").agg(F.count("*").alias("total_rows"))
    head = data.where(F.col("source_row") < rows).withColumn(
        "cells", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))))
    return head.join(totals, "file_id")
