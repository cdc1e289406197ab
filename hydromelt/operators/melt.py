"""Wide files to long measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import values
from hydromelt.operators.joins import checked_broadcast
from hydromelt.operators.numbering import top_per


def value_subset(cells_long: DataFrame, keys: list[str], value: str, allowed: tuple[str, ...]) -> DataFrame:
    """Per key: whether all filled values lie inside ``allowed`` (and any exist)."""
    text = values.blank_to_null(F.col(value))
    outside = F.max(F.when(text.isNotNull(), ~text.isin(*allowed)))
    return cells_long.groupBy(*keys).agg(F.coalesce(~outside, F.lit(False)).alias("all_allowed"))


#: Columns that one mask of bits speaks for.
_MASK = 63


def allowed_columns(data: DataFrame, listed: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """file_id, column_index of the ``wanted`` columns whose filled cells, of which there are some, all lie inside ``allowed``.

    ``listed``: file_id and its wanted columns. A row tells of up to 63 columns in one mask of bits, and masks of many rows are joined
    before they are shuffled, so no cell becomes a row.
    """
    parts = F.transform(F.sequence(F.lit(1), F.size("wanted"), F.lit(_MASK)), lambda begin: F.slice("wanted", begin, F.lit(_MASK)))
    masks = listed.where(F.size("wanted") > 0).select("file_id", F.explode(parts).alias("part"))

    def mask(test) -> Column:
        bits = F.transform("part", lambda i, n: F.when(test(values.blank_to_null(F.get("cells", i))), F.call_function("shiftleft", F.lit(1).cast("long"), n)))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda held, bit: held.bitwiseOR(F.coalesce(bit, F.lit(0).cast("long"))))

    seen = data.join(masks, "file_id").groupBy("file_id", "part").agg(
        F.bit_or(mask(lambda text: text.isNotNull())).alias("filled"), F.bit_or(mask(lambda text: ~text.isin(*allowed))).alias("other"))
    inside = F.col("filled").bitwiseAND(F.bitwise_not(F.col("other")))
    return seen.select("file_id", F.posexplode("part").alias("n", "column_index"), inside.alias("inside")).where(
        F.expr("getbit(inside, n) = 1")).select("file_id", "column_index")


def sample_type_columns(columns: DataFrame, data: DataFrame) -> DataFrame:
    """First sample-type column per file: by its name, or by holding only such values.

    Values are read for undecided columns alone.
    """
    named = F.lit(False)
    for word in C.SAMPLE_TYPE_RAW_NAMES:
        named = named | F.col("raw").contains(word)
    by_name = columns.where(named).select("file_id", "column_index")
    open_columns = columns.where(~named & F.col("code").isNull()).select("file_id", "column_index")
    listed = open_columns.groupBy("file_id").agg(F.array_sort(F.collect_set("column_index")).alias("wanted"))
    by_value = allowed_columns(data, listed, C.SAMPLE_TYPE_VALUES)
    return by_name.unionByName(by_value).groupBy("file_id").agg(F.min("column_index").alias("sample_type"))


def file_layouts(columns: DataFrame, sample_types: DataFrame, units: DataFrame | None = None,
                 priority: bool = False) -> DataFrame:
    """One row per file: position of every role, and its measured columns.

    The leftmost column of a role serves it; with ``priority`` the code listed
    first for the role does. The sample-type column serves no other role. Each
    measured column carries the limit column that reports on it. One pass over
    the columns; a file's list is as long as its rows are wide.
    """
    if units is not None:
        columns = columns.drop("unit").join(units.select("code", "unit"), "code", "left")
    elif "unit" not in columns.columns:
        columns = columns.withColumn("unit", F.lit(None).cast("string"))
    label = F.replace(F.coalesce(F.nullif("site", F.lit("")), F.col("raw")), F.lit(" "), F.lit(""))
    entry = F.struct("column_index", "code", "raw", "unit", label.alias("label"),
                     F.col("dict_type").eqNullSafe(C.DICT_MEASUREMENT).alias("measured"),
                     F.col("code").isin(*C.LIMIT_CODES).alias("reports_limit"))
    lists = (columns.groupBy("file_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
             .join(sample_types, "file_id", "left"))
    usable = F.filter("entries", lambda e: e["code"].isNotNull() & ~e["column_index"].eqNullSafe(
        F.col("sample_type")))
    part = lists.select(
        "file_id", "sample_type",
        F.filter(usable, lambda e: e["reports_limit"] & (e["label"] != "")).alias("limits"),
        F.filter(usable, lambda e: e["measured"] & ~e["reports_limit"]).alias("items"),
        F.filter(usable, lambda e: ~e["measured"] & ~e["reports_limit"]).alias("others"))
    roles = [_role(codes, priority).alias(role) for role, codes in C.ROLE_CODES.items()]
    return part.select("file_id", "sample_type", *roles, F.transform("items", lambda e: F.struct(
        e["column_index"].alias("column_index"), e["code"].alias("code"), e["raw"].alias("raw"),
        e["unit"].alias("unit"), _limit_of(e["raw"]).alias("limit_index"))).alias("measures"))


def _role(codes: tuple[str, ...], priority: bool) -> Column:
    """Index of the column serving a role."""
    listed = F.array(*[F.lit(c) for c in codes])
    fits = F.filter("others", lambda e: F.array_contains(listed, e["code"]))
    ranked = F.array_sort(F.transform(fits, lambda e: F.struct(
        (F.array_position(listed, e["code"]) if priority else F.lit(0)).alias("rank"), e["column_index"])))
    return F.get(ranked, F.lit(0))["column_index"]


def _limit_of(raw: Column) -> Column:
    """The limit column of an item: the first whose label occurs in the item's name.

    A label that repeats in a file keeps its first place but its last column.
    """
    name = F.replace(raw, F.lit(" "), F.lit(""))
    label = F.get(F.filter("limits", lambda e: F.contains(name, e["label"])), F.lit(0))["label"]
    same = F.filter("limits", lambda e: e["label"] == label)
    return F.when(F.size("limits") > 0, F.try_element_at(same, F.lit(-1))["column_index"])


def _cell(index: Column) -> Column:
    return values.blank_to_null(F.get("cells", index))


def melt(data: DataFrame, layouts: DataFrame, as_of: Column) -> DataFrame:
    """One record per row and filled measured column, with provenance and flags.

    The layout is joined before the rows fan out. What fans out is one entry per measured column with its own texts; the row's
    cells end before. A blank cell gives no record: missing is not zero.
    """
    # Cells are trimmed after the fan-out: lambdas are interpreted, and repeat what they name twice.
    entries = F.transform("measures", lambda m: F.struct(
        m["raw"].alias("source_column"), m["column_index"].alias("source_column_index"), m["code"].alias("item_code"),
        m["unit"].alias("unit"), F.get("cells", m["column_index"]).alias("cell"), F.get("cells", m["limit_index"]).alias("limit_cell")))
    wide = data.join(checked_broadcast(layouts), "file_id").select(
        "file_id", "source_row", entries.alias("entries"), _cell(F.col("site")).alias("site_name"),
        _cell(F.col("outlet")).alias("outlet"), _cell(F.col("sample_type")).alias("sample_type"),
        *[_cell(F.col(role)).alias(f"{role}_text") for role in ("date", "datetime", "year", "month", "period")])
    dated = values.resolve_dates(wide, "date_text", "datetime_text", "year_text", "month_text", "period_text")
    # Row-level work ends before the rows fan out. For an inner fan-out Spark would compute the entries again, to see whether there are any.
    fanned = dated.select("file_id", "source_row", "site_name", "outlet", "sample_type", "measured_on",
                          "period_label", F.explode_outer("entries").alias("m"))
    cells = fanned.select("*", "m.*").where(values.is_filled(F.col("cell"))).withColumns({
        "text": values.blank_to_null(F.col("cell")), "limit_text": values.blank_to_null(F.col("limit_cell"))})
    return typed_records(cells.drop("m", "cell", "limit_cell"), as_of)


def typed_records(cells: DataFrame, as_of: Column) -> DataFrame:
    """Parse the text of long cells into value, flags and reported limit.

    The whole text is kept; a number too large for the stored type is flagged ``out_of_range``.
    """
    text, number = F.col("text"), F.col("_number")
    reason = F.when(number.isNull(), "non_numeric").when(F.col("value_num").isNull(), "out_of_range").otherwise("ok")
    return cells.withColumn("_number", values.number_text(text)).withColumn(
        "value_num", number.try_cast(values.DECIMAL)).select(
        "file_id", "source_row", "source_column", "source_column_index", "site_name", "outlet", "sample_type",
        "measured_on", "period_label", "item_code", "unit", "value_num",
        text.alias("value_text"), number.isNotNull().alias("is_numeric"),
        values.is_censored(text, number).alias("censored"),
        values.parse_number(F.col("limit_text")).alias("reported_limit"),
        values.quality_flag(F.col("value_num"), reason, F.col("measured_on"), as_of).alias("quality_flag"))


def melt_table(wide: DataFrame, ids: list[str], measures: dict[str, tuple[int, str, str]]) -> DataFrame:
    """Unpivot one table of known schema: column -> (index, source name, item code).

    Measured columns come in as texts; blank cells are dropped.
    """
    entries = [F.struct(F.lit(i).alias("source_column_index"), F.lit(name).alias("source_column"),
                        F.lit(code).alias("item_code"), values.blank_to_null(F.col(column)).alias("text"))
               for column, (i, name, code) in measures.items()]
    long = wide.select(*ids, F.explode(F.array(*entries)).alias("m"))
    return long.select(*ids, "m.*").where("text is not null")


def wide_rename(data: DataFrame, columns: DataFrame) -> DataFrame:
    """Each data row as a map from unique output column to cell text."""
    names = columns.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("column_index", "unique_column"))), lambda s: s["unique_column"]).alias("names"))
    padded = F.transform("names", lambda _, i: F.get("cells", i))
    return data.join(names, "file_id").select("file_id", "source_row",
                                              F.map_from_arrays("names", padded).alias("values"))


def value_counts(cells_long: DataFrame, keys: list[str], position: str = "source_row", value: str = "value") -> DataFrame:
    """Every distinct value per column, with its count and first position; blank cells count as a null."""
    return cells_long.groupBy(*keys, values.blank_to_null(F.col(value)).alias("text")).agg(
        F.count("*").alias("n"), F.min(position).alias("first_at"))


def value_summaries(cells_long: DataFrame, keys: list[str], position: str = "source_row",
                    value: str = "value", *, samples: int) -> DataFrame:
    """Row count, distinct filled values, the first ``samples`` of these and uniqueness per column.

    Values are counted per column first; only the first few distinct ones per
    column are ever gathered. All of them are in :func:`value_counts`.
    """
    counted = value_counts(cells_long, keys, position, value)
    totals = counted.groupBy(*keys).agg(
        F.sum("n").alias("row_count"), F.count("text").alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"))
    heads = top_per(counted.where("text is not null"), keys, [F.col("first_at"), F.col("text")], samples, "nth")
    shown = heads.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))),
                                                   lambda s: s["text"]).alias("samples"))
    return totals.join(shown, keys, "left").select(
        *keys, "row_count", "distinct_count",
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        ((F.col("filled") > 0) & (F.col("distinct_count") == F.col("filled"))).alias("all_unique"))


def undecided_cells(data: DataFrame, columns: DataFrame) -> DataFrame:
    """Long cells of the columns a person must decide, and of no others."""
    wanted = columns.where(~F.col("status").isin(*C.AUTO_STATUSES)).groupBy("file_id").agg(
        F.collect_set("column_index").alias("wanted"))
    return data.join(wanted, "file_id").select("file_id", "source_row", F.explode(F.transform(
        "wanted", lambda i: F.struct(i.alias("column_index"), F.get("cells", i).alias("value")))).alias("v")).select(
        "file_id", "source_row", "v.column_index", "v.value")
