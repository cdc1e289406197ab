"""CSV files read by line, split inside files.

A line that starts inside quotes reads differently from one that starts outside. Each line says, in the JVM, in which state
it ends for both; states compose, so every block of a file gives both readings of its end, a pass over the few blocks
chooses one, and rows are put together from there. Only files in which a line opens quotes without closing them need that.
"""

from __future__ import annotations

import csv
import sys
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydromelt import config as C
from hydromelt.operators.joins import checked_broadcast
from hydromelt.operators.numbering import running_number
from hydromelt.session import stage

#: Longest row put together from several lines, as the CSV parser bounds a cell. In a file with a longer one some quote was never
#: closed; its quotes hold within their line only.
ROW_BYTES = 131_072
KOREAN = "MS949"
#: A row of one blank cell, which is none.
_BLANK = r'^\s*("\s*"\s*)?$'
#: States of the CSV grammar: at the start of a field, inside a plain field, inside quotes, and after a quote inside quotes.
_START, _PLAIN, _QUOTED, _CLOSING = range(4)


@contextmanager
def java_charsets(spark: SparkSession):
    """Within it, ``decode`` knows all charsets of the JVM, and marks bytes that don't fit instead of failing."""
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    old = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _korean(raw: Column) -> Column:
    return F.decode(raw, KOREAN)


def _after_text(state: Column, text: Column) -> Column:
    """The state after a run of letters without quotes."""
    ends = F.when(F.endswith(text, F.lit(",")), _START).otherwise(_PLAIN)
    return F.when((state == _QUOTED) | (text == ""), state).when(
        (state == _PLAIN) & ~F.contains(text, F.lit(",")), _PLAIN).otherwise(ends)


def _after_quote(state: Column) -> Column:
    return F.when(state == _START, _QUOTED).when(state == _QUOTED, _CLOSING).when(state == _CLOSING, _QUOTED).otherwise(state)


def open_after(line: Column, inside: bool) -> Column:
    """Whether quotes are open at the end of a line that starts outside or ``inside`` of them."""
    runs = F.split(line, '"', -1)
    state = F.aggregate(F.slice(runs, F.lit(2), F.size(runs)), _after_text(F.lit(_QUOTED if inside else _START), runs[0]),
                        lambda held, run: _after_text(_after_quote(held), run))
    return F.when(F.contains(line, F.lit('"')), state == _QUOTED).otherwise(F.lit(inside))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parsed(rows: pd.Series) -> pd.Series:
    csv.field_size_limit(sys.maxsize)

    def cells(text: str) -> list[str | None]:
        return [None if c in C.MISSING_CELL_TEXTS else c for c in next(csv.reader([text]), [])]

    return rows.map(cells)


def with_cells(rows: DataFrame) -> DataFrame:
    """Rows with ``text`` get ``cells``. Rows without quotes are cut by Spark, others by the CSV parser."""
    plain = ~F.contains("text", F.lit('"'))
    cut = F.transform(F.split("text", ",", -1), lambda c: F.when(~c.isin(*C.MISSING_CELL_TEXTS), c))
    return rows.where(plain).withColumn("cells", cut).unionByName(
        rows.where(~plain).withColumn("cells", _parsed("text")))


def _text(encoding: Column, line: Column) -> Column:
    """A line's text; a mark before a file's first letter goes."""
    return F.when(encoding == "cp949", _korean(line)).otherwise(F.regexp_replace(line.cast("string"), "\\A\ufeff", ""))


def _shifts(blocks: DataFrame, rows: str = "rows") -> Column:
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(rows).over(before), F.lit(0))


def _starts(order: Window, closes: Column, turns: Column) -> tuple[Column, Column]:
    """The states at an element's start, if the first starts outside and if it starts inside of quotes.

    ``closes``: the state after an element that ends alike for both; ``turns``: whether it swaps the two (null ``closes``).
    """
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    turned = F.coalesce(F.sum(turns.cast("long")).over(before), F.lit(0)) % 2 == 1
    own = F.sum(turns.cast("long")).over(so_far) % 2 == 1
    return turned, F.when(closes.isNotNull(), closes != own)


def _readings(rows: DataFrame, order: Window) -> DataFrame:
    """Rows with ``out`` and ``ins``, the ends for both starts, get ``if_out`` and ``if_in``, their own starts for both."""
    closes = F.when(F.col("out") == F.col("ins"), F.col("out"))
    turned, fixed = _starts(order, closes, F.col("out") & ~F.col("ins"))
    rows = rows.withColumns({"turned": turned, "fixed": fixed})
    last = F.last("fixed", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("last", last).withColumns({
        "if_out": F.coalesce("last", F.lit(False)) != F.col("turned"),
        "if_in": F.coalesce("last", F.lit(True)) != F.col("turned")}).drop("turned", "fixed", "last")


def _end(start: str) -> Column:
    return F.when(F.col(start), F.col("ins")).otherwise(F.col("out"))


def torn_rows(raw: DataFrame, files: DataFrame, row_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows, files given up) of files with line breaks inside quotes: file_id, encoding, row_idx, text.

    ``raw``: file_id, block, line of all lines in order of the scan; ``files``: file_id, encoding. A file in
    which a row would be longer than ``row_bytes`` is given up.
    """
    part = raw.withColumn("id", F.monotonically_increasing_id()).join(checked_broadcast(files), "file_id").withColumn(
        "text", _text(F.col("encoding"), F.col("line"))).drop("line")
    lines = stage(part.withColumns({"out": open_after(F.col("text"), False), "ins": open_after(F.col("text"), True)}), "torn-lines")
    # A block is as large as a task's share of a file, so no window holds more than that.
    lines = stage(_readings(lines, Window.partitionBy("file_id", "block").orderBy("id")), "torn-readings")
    full = ~F.col("text").rlike(_BLANK)
    ends = lines.groupBy("file_id", "block").agg(
        F.max_by(F.struct(_end("if_out").alias("out"), _end("if_in").alias("ins")), "id").alias("end"),
        F.count_if(full & ~F.col("if_out")).alias("rows_out"), F.count_if(full & ~F.col("if_in")).alias("rows_in"))
    blocks = _readings(ends.select("file_id", "block", "end.*", "rows_out", "rows_in"), Window.partitionBy("file_id").orderBy("block"))
    # A file starts outside of quotes.
    blocks = blocks.select("file_id", "block", F.col("if_out").alias("inside"),
                           F.when(F.col("if_out"), F.col("rows_in")).otherwise(F.col("rows_out")).alias("rows"))
    blocks = stage(blocks.withColumn("shift", _shifts(blocks)).drop("rows"), "torn-blocks")
    begun = F.when(F.col("inside"), F.col("if_in")).otherwise(F.col("if_out"))
    known = lines.join(checked_broadcast(blocks, C.BROADCAST_BLOCKS), ["file_id", "block"]).withColumn("begun", begun)
    known = known.where(F.col("begun") | full)  # a blank line outside of quotes is no row
    so_far = Window.partitionBy("file_id", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    known = stage(known.select(
        "file_id", "encoding", "id", "text", F.when(F.col("begun"), F.col("ins")).otherwise(F.col("out")).alias("open"), "begun",
        (F.col("shift") + F.sum((~F.col("begun")).cast("long")).over(so_far) - 1).alias("row_idx")), "torn-numbered")
    several = known.where("begun or open")
    long = several.groupBy("file_id", "row_idx").agg(F.sum(F.octet_length("text") + 1).alias("size")).where(F.col("size") > row_bytes)
    given_up = stage(long.select("file_id").distinct(), "torn-given-up")
    joined = several.join(given_up, "file_id", "left_anti").groupBy("file_id", "encoding", "row_idx").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("id", "text"))), lambda line: line["text"]), "\n").alias("text"))
    single = known.where("not begun and not open").join(given_up, "file_id", "left_anti").select(
        "file_id", "encoding", "row_idx", "text")
    rows = single.unionByName(joined)
    blank = F.col("text").rlike(_BLANK)
    if not joined.where(blank).isEmpty():  # blank cells over several lines were numbered too
        rows = running_number(rows.where(~blank), ["file_id"], "row_idx", "number").withColumn(
            "row_idx", F.col("number") - 1).drop("number")
    return rows, given_up


def read_lines(raw: DataFrame, row_bytes: int = ROW_BYTES) -> tuple[DataFrame, DataFrame]:
    """(cell grid, unsplittable files) of CSV files given by their lines: file_id, block, line (bytes), in order of the scan.

    Lines are written once with their task-local number, so that numbering and parsing see the same split. A row's index is
    its place in its file block plus the rows of earlier blocks. Rows are padded to, and called ragged against, the first row,
    and files no encoding fits give one row without cells. Files that end lines, or break them inside quotes, with a carriage
    return alone cannot be split and are listed apart.
    """
    spark = raw.sparkSession
    with java_charsets(spark):
        return _read_lines(raw, row_bytes)


def _read_lines(raw: DataFrame, row_bytes: int) -> tuple[DataFrame, DataFrame]:
    full = raw.where(~F.regexp_replace(F.col("line").cast("string"), "\\A\ufeff", "").rlike(_BLANK))
    lines = stage(full.withColumn("id", F.monotonically_increasing_id()), "lines")
    plain = F.regexp_replace(F.col("line").cast("string"), "\\A\ufeff", "")
    blocks = stage(lines.groupBy("file_id", "block").agg(
        F.count("*").alias("rows"), F.min("id").alias("first_id"), F.bool_or(open_after(plain, False)).alias("torn"),
        F.bool_or(plain.rlike("\r.")).alias("returns"), F.bool_and(F.expr("is_valid_utf8(cast(line as string))")).alias("utf8")), "blocks")
    whole = blocks.groupBy("file_id").agg(F.bool_or("torn").alias("torn"), F.bool_or("returns").alias("returns"),
                                          F.bool_and("utf8").alias("utf8"))
    korean = lines.join(whole.where("NOT utf8").select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(
        F.bool_and(~F.contains(_korean(F.col("line")), F.lit("\ufffd"))).alias("cp949"))
    whole = stage(whole.join(korean, "file_id", "left").select(
        "file_id", "torn", "returns", F.when(F.col("utf8"), "utf-8-sig").when(F.col("cp949"), "cp949").alias("encoding")), "encodings")
    usable = whole.where("encoding IS NOT NULL AND NOT returns")
    by_line, rows = usable.where("NOT torn").select("file_id", "encoding"), None
    torn = usable.where("torn").select("file_id", "encoding")
    if not torn.isEmpty():
        rows, given_up = torn_rows(raw, torn, row_bytes)
        by_line = by_line.unionByName(torn.join(given_up, "file_id", "left_semi"))
    shifts = blocks.withColumn("shift", _shifts(blocks) - F.col("first_id")).select("file_id", "block", "shift").join(by_line, "file_id")
    numbered = lines.join(checked_broadcast(shifts, C.BROADCAST_BLOCKS), ["file_id", "block"]).select(
        "file_id", "encoding", (F.col("id") + F.col("shift")).alias("row_idx"), _text(F.col("encoding"), F.col("line")).alias("text"))
    numbered = numbered if rows is None else numbered.unionByName(rows)
    numbered = numbered.withColumn("text", F.regexp_replace("text", "\r\\z", ""))
    widths = with_cells(numbered.where("row_idx = 0")).select("file_id", F.size("cells").alias("width"))
    short = F.col("width") - F.size("cells")
    padded = F.when(short > 0, F.concat("cells", F.array_repeat(F.lit(None).cast("string"), short))).otherwise(F.col("cells"))
    grid = with_cells(numbered).join(checked_broadcast(widths), "file_id").select(
        "file_id", "encoding", (short < 0).alias("ragged"), "row_idx", padded.alias("cells"))
    lost = whole.where("encoding IS NULL AND NOT returns").select(
        "file_id", "encoding", F.lit(False).alias("ragged"), F.lit(-1).cast("long").alias("row_idx"),
        F.lit(None).cast("array<string>").alias("cells"))
    return grid.unionByName(lost), whole.where("returns").select("file_id")
