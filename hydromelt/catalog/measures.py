"""Queries over measurements: melt, series, limits, summaries."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.catalog import standins as S
from hydromelt.catalog.registry import Topic
from hydromelt.functions import values
from hydromelt.operators import analysis, headers, numbering, paging, quality, standards, summaries
from hydromelt.operators import melt as melting
from hydromelt.operators.analysis import AnalysisRequest
from hydromelt.plans import ingest
from hydromelt.session import scratch_root, spread

query = Topic()


# --- melt ----------------------------------------------------------------------

def grid(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as data rows of text cells, one file per supplier."""
    quantity = F.when(F.col("l_quantity") < 50, S.money("l_quantity")).otherwise(" ")
    discount = F.when(F.col("l_discount") > 0, S.money("l_discount")).otherwise("불검출")
    tax = F.when(F.col("l_tax") > 0, S.money("l_tax")).otherwise("<0.01")
    cells = F.array(
        F.concat(F.lit(" site-"), F.col("l_suppkey").cast("string")), F.col("l_returnflag"), S._sample_type(),
        F.date_format("l_shipdate", "yyyy.MM.dd HH:mm"), quantity, S.money("l_extendedprice"), discount, tax,
        (F.col("l_linenumber") * 8).cast("string"))
    return spread(S.table(spark, folder, "lineitem"), "l_orderkey").select(
        F.col("l_suppkey").alias("file_id"), F.col("l_orderkey").alias("source_row"), cells.alias("cells"))


def grid_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The mapping of those files' columns."""
    text = "string"
    entries = [
        (0, "측정소명", "MD-001", C.DICT_METADATA, None), (1, "방류구", "MD-033", C.DICT_METADATA, None),
        (2, "시료구분", None, None, None), (3, "측정일자", "MD-006", C.DICT_METADATA, None),
        *[(i, name, code, C.DICT_MEASUREMENT, None) for i, name, code, _ in S.MEASURES],
        (8, "수 량 기준", "MD-054", C.DICT_METADATA, "수 량")]
    columns = F.array(*[F.struct(
        F.lit(i).alias("column_index"), F.lit(raw).alias("raw"), F.lit(code).cast(text).alias("code"),
        F.lit(kind).cast(text).alias("dict_type"), F.lit(site).cast(text).alias("site"))
        for i, raw, code, kind, site in entries])
    return S.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("file_id"), F.explode(columns).alias("c")).select("file_id", "c.*")


def _melted(spark: SparkSession, folder: str) -> DataFrame:
    columns, data = grid_columns(spark, folder), grid(spark, folder)
    return ingest.records_of(columns, data, S.AS_OF)


_MELT_OUT = ["file_id", "source_row", "source_column", "source_column_index", "site_name", "outlet", "sample_type",
             "measured_on", "item_code", "value_num", "value_text", "is_numeric", "reported_limit", "quality_flag"]


def _melt_sql(site: str) -> str:
    texts = {
        "WQ-001": ("CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR)", "l_quantity", "l_quantity < 50"),
        "WQ-002": ("CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)", "l_extendedprice", "true"),
        "WQ-005": ("CASE WHEN l_discount > 0 THEN CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) ELSE '불검출' END",
                   "CASE WHEN l_discount > 0 THEN l_discount END", "true"),
        "WQ-006": ("CASE WHEN l_tax > 0 THEN CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) ELSE '<0.01' END",
                   "CASE WHEN l_tax > 0 THEN l_tax ELSE 0.01 END", "true")}
    parts = []
    for i, name, code, _ in S.MEASURES:
        text, number, kept = texts[code]
        limit = "CAST(l_linenumber * 8 AS DOUBLE)" if code == "WQ-001" else "CAST(NULL AS DOUBLE)"
        parts.append(f"""SELECT l_suppkey AS file_id, l_orderkey AS source_row, '{name}' AS source_column,
          {i} AS source_column_index, {site} AS site_name, l_returnflag AS outlet,
          CASE WHEN l_linestatus = 'F' THEN '원폐수' WHEN l_returnflag <> 'R' THEN '방류수' END AS sample_type,
          CAST(l_shipdate AS DATE) AS measured_on, '{code}' AS item_code, CAST({number} AS DOUBLE) AS value_num,
          {text} AS value_text, {limit} AS reported_limit FROM lineitem WHERE {kept}""")
    return f"""SELECT *, value_num IS NOT NULL AS is_numeric, CASE WHEN value_num IS NULL THEN 'non_numeric'
      WHEN measured_on > DATE '{S.AS_OF}' THEN 'future_date' END AS quality_flag FROM ({" UNION ALL ".join(parts)})"""


@query(_melt_sql("'site-' || l_suppkey"))
def melt(spark, folder):
    return _melted(spark, folder).select(_MELT_OUT).withColumns(S.dbl("value_num", "reported_limit"))


@query(_melt_sql("'site-' || l_suppkey"))
def melt_unpivot(spark, folder):
    """The same records from the typed table, by unpivoting its known columns."""
    wide = spread(S.table(spark, folder, "lineitem"), "l_orderkey").select(
        F.col("l_suppkey").alias("file_id"), F.col("l_orderkey").alias("source_row"),
        F.concat(F.lit("site-"), F.col("l_suppkey").cast("string")).alias("site_name"),
        F.col("l_returnflag").alias("outlet"), S._sample_type().alias("sample_type"),
        F.col("l_shipdate").cast("date").alias("measured_on"), F.lit(None).cast("string").alias("period_label"),
        F.when(F.col("l_quantity") < 50, S.money("l_quantity")).alias("c4"), S.money("l_extendedprice").alias("c5"),
        F.when(F.col("l_discount") > 0, S.money("l_discount")).otherwise("불검출").alias("c6"),
        F.when(F.col("l_tax") > 0, S.money("l_tax")).otherwise("<0.01").alias("c7"),
        (F.col("l_linenumber") * 8).cast("string").alias("limit_cell"))
    ids = ["file_id", "source_row", "site_name", "outlet", "sample_type", "measured_on", "period_label", "limit_cell"]
    long = melting.melt_table(wide, ids, {f"c{i}": (i, name, code) for i, name, code, _ in S.MEASURES})
    cells = long.withColumn("limit_text", F.when(F.col("source_column_index") == 4, F.col("limit_cell"))).withColumn(
        "unit", F.lit(None).cast("string"))
    return melting.typed_records(cells, F.lit(S.AS_OF)).select(_MELT_OUT).withColumns(S.dbl("value_num", "reported_limit"))


@query(f"""SELECT item_code, quality_flag, CAST(count(*) AS BIGINT) AS n FROM ({_melt_sql("''")})
  WHERE quality_flag IS NOT NULL GROUP BY ALL""")
def quality_flags(spark, folder):
    return quality.flag_counts(_melted(spark, folder))


@query("""SELECT s_suppkey AS file_id, 0 AS site, 1 AS outlet, 2 AS sample_type, 3 AS "date",
  '수량:8,금액,할인,세율' AS measures FROM supplier""")
def resolve_roles(spark, folder):
    """Roles and measured columns with their limit columns, per file."""
    layouts = ingest.layouts_of(grid_columns(spark, folder), grid(spark, folder))
    shown = F.transform("measures", lambda m: F.concat_ws(":", m["raw"], m["limit_index"].cast("string")))
    return layouts.select("file_id", "site", "outlet", "sample_type", "date", F.array_join(shown, ",").alias("measures"))


@query("""SELECT s_suppkey AS file_id, '수량' AS raw, 8 AS limit_index FROM supplier""")
def reported_limit(spark, folder):
    """The limit column found for each measured column."""
    layouts = ingest.layouts_of(grid_columns(spark, folder), grid(spark, folder))
    return layouts.select("file_id", F.explode("measures").alias("m")).where("m.limit_index is not null").select(
        "file_id", "m.raw", "m.limit_index")


@query("""SELECT l_suppkey AS file_id, 'returnflag' AS column_name, bool_and(l_returnflag IN ('A', 'R')) AS all_allowed
  FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'linestatus', bool_and(l_linestatus IN ('O', 'F')) FROM lineitem
  GROUP BY 1""")
def subset_test(spark, folder):
    """Per file: do the values of a column stay inside a closed list?"""
    line = S.table(spark, folder, "lineitem")
    part = lambda column, allowed: melting.value_subset(
        line.select(F.col("l_suppkey").alias("file_id"), F.lit(column[2:]).alias("column_name"),
                    F.col(column).alias("value")), ["file_id", "column_name"], "value", allowed)
    return part("l_returnflag", ("A", "R")).unionByName(part("l_linestatus", ("O", "F")))


_ORDER_ROWS = """SELECT o_custkey AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS source_row,
  o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"""


def _order_rows(spark, folder) -> DataFrame:
    """Orders as data rows of one file per customer, numbered in order."""
    rows = numbering.running_number(S.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("file_id"), "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), ["file_id"], "o_orderkey", "nth")
    return rows.withColumn("source_row", F.col("nth") - 1)


@query(S.with_tables("", """SELECT file_id, source_row, o_orderstatus || '|' || o_orderpriority || '|' || day AS cells,
  CAST(count(*) OVER (PARTITION BY file_id) AS BIGINT) AS total_rows FROM rows QUALIFY source_row < 10""",
                     rows=_ORDER_ROWS))
def preview(spark, folder):
    data = _order_rows(spark, folder).select("file_id", "source_row", F.array(
        "o_orderstatus", "o_orderpriority", "day").alias("cells"))
    return headers.preview(data).withColumn("cells", F.array_join("cells", "|"))


@query(S.with_tables("", """SELECT file_id, source_row, o_orderstatus AS "WQ-001", day AS "WQ-001#2",
  o_orderpriority AS "UNMAPPED_x" FROM rows""", rows=_ORDER_ROWS))
def wide_rename(spark, folder):
    """Wide rows under unique standard names."""
    data = _order_rows(spark, folder).select("file_id", "source_row", F.array(
        "o_orderstatus", "day", "o_orderpriority").alias("cells"))
    names = data.select("file_id").distinct().select("file_id", F.posexplode(F.array(
        F.lit("WQ-001"), F.lit("WQ-001"), F.lit("UNMAPPED_x"))).alias("column_index", "output_column"))
    shown = melting.wide_rename(data, headers.unique_output_names(names))
    return shown.select("file_id", "source_row", *[
        F.col("values").getItem(n).alias(n) for n in ("WQ-001", "WQ-001#2", "UNMAPPED_x")])


_SUMMARY_CELLS = """SELECT l_suppkey AS file_id, 0 AS column_index, l_orderkey AS source_row, l_returnflag AS value FROM lineitem
  UNION ALL SELECT l_suppkey, 1, l_orderkey, CASE WHEN l_quantity < 50 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE ' ' END FROM lineitem"""


def _summary_cells(spark, folder) -> DataFrame:
    quantity = F.when(F.col("l_quantity") < 50, F.col("l_quantity").cast("int").cast("string")).otherwise(" ")
    return S.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("file_id"), F.col("l_orderkey").alias("source_row"),
        F.posexplode(F.array("l_returnflag", quantity)).alias("column_index", "value"))


@query(S.with_tables("", """SELECT t.file_id, t.column_index, row_count, distinct_count, samples, all_unique FROM (
  SELECT file_id, column_index, CAST(sum(n) AS BIGINT) AS row_count, CAST(count(text) AS BIGINT) AS distinct_count,
    count(text) > 0 AND count(text) = sum(n) FILTER (text IS NOT NULL) AS all_unique FROM counted GROUP BY ALL) t
  JOIN (SELECT file_id, column_index, string_agg(text, ',' ORDER BY nth) AS samples FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id, column_index ORDER BY first_at, text) AS nth FROM counted
    WHERE text IS NOT NULL) WHERE nth <= 12 GROUP BY ALL) s ON s.file_id = t.file_id AND s.column_index = t.column_index""",
                     counted=f"""SELECT file_id, column_index, nullif(trim(value), '') AS text, count(*) AS n,
  min(source_row) AS first_at FROM ({_SUMMARY_CELLS}) GROUP BY ALL"""))
def value_summary(spark, folder):
    return melting.value_summaries(_summary_cells(spark, folder), ["file_id", "column_index"], samples=12).withColumn("samples", F.array_join("samples", ","))


# --- series --------------------------------------------------------------------

def _avg(digits: int) -> str:
    """Exact half-up average of six-decimal values, as a double."""
    tenth = ("((2 * CAST(sum(value_num) * 1000000 AS HUGEINT) * 10000 + count(value_num))"
             " // (2 * nullif(count(value_num), 0)))")
    step = 10 ** (10 - digits)
    return f"CAST((2 * {tenth} + {step}) // {2 * step} AS DOUBLE) / {10 ** digits}.0"


_BUCKET_SQL = {"month": "strftime(measured_on, '%Y-%m')",
               "quarter": "year(measured_on) || '-Q' || quarter(measured_on)",
               "year": "CAST(year(measured_on) AS VARCHAR)", "none": "CAST(measured_on AS VARCHAR)"}


def _series_sql(bucket: str, value: str, where: str = "true") -> str:
    return S.with_tables("m", """SELECT bucket, item_code, value, n, missing, unit FROM points""",
                         points=f"""SELECT {_BUCKET_SQL[bucket]} AS bucket, item_code, {value} AS value,
      CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(value_num) AS BIGINT) AS missing, min(unit) AS unit
      FROM m WHERE {where} GROUP BY 1, 2""")


def _series(spark, folder, request: AnalysisRequest) -> DataFrame:
    return analysis.series(S.measurements(spark, folder), request).withColumns(S.dbl("value"))


@query(_series_sql("month", _avg(4)))
def analysis_month(spark, folder):
    return _series(spark, folder, AnalysisRequest())


@query(_series_sql("quarter", "CAST(max(value_num) AS DOUBLE)",
                   """item_code IN ('WQ-001', 'WQ-002') AND outlet IN ('A', 'N')
                   AND measured_on >= DATE '1996-02-10' AND measured_on <= DATE '2000-11-30'"""))
def analysis_quarter(spark, folder):
    return _series(spark, folder, AnalysisRequest(
        item_codes=["WQ-001", "WQ-002"], outlets=["A", "N"], from_date=date(1996, 2, 10),
        to_date=date(2000, 11, 30), bucket="quarter", metric="max"))


@query(_series_sql("year", "CAST(count(value_num) AS DOUBLE)", "sample_type = '방류수'"))
def analysis_year(spark, folder):
    return _series(spark, folder, AnalysisRequest(sample_type="방류수", bucket="year", metric="count"))


@query(_series_sql("none", "CAST(min(value_num) AS DOUBLE)"))
def analysis_none(spark, folder):
    return _series(spark, folder, AnalysisRequest(bucket="none", metric="min"))


_REPLAYED = AnalysisRequest(item_codes=["WQ-005"], outlets=["R"], sample_type="원폐수", from_date=date(1997, 1, 1),
                            to_date=date(1997, 6, 30))
_REPLAYED_SQL = """item_code = 'WQ-005' AND outlet = 'R' AND sample_type = '원폐수'
  AND measured_on >= DATE '1997-01-01' AND measured_on <= DATE '1997-06-30'"""
_EVIDENCE = ["filename", "file_id", "source_row", "source_column", "source_column_index", "site_name", "measured_on",
             "item_code", "value_num", "quality_flag"]
_EVIDENCE_SQL = S.with_tables("m files", f"""SELECT original_filename AS filename, m.file_id, source_row, source_column,
  source_column_index, site_name, measured_on, item_code, CAST(value_num AS DOUBLE) AS value_num, quality_flag
  FROM m JOIN files USING (file_id) WHERE {_REPLAYED_SQL}""")


def _evidence(spark, folder) -> DataFrame:
    """Rows behind a stored request, from its stored form."""
    request = AnalysisRequest.from_conditions(_REPLAYED.conditions())
    rows = analysis.evidence(S.measurements(spark, folder), S.files(spark, folder), request)
    return rows.select(_EVIDENCE).withColumns(S.dbl("value_num"))


@query(_EVIDENCE_SQL)
def evidence_rows(spark, folder):
    return _evidence(spark, folder)


@query(_EVIDENCE_SQL + """ ORDER BY measured_on, m.file_id, source_row, source_column_index, value_num NULLS FIRST
  LIMIT 50 OFFSET 50""")
def evidence_page(spark, folder):
    """Second page through a stored index of pages."""
    order = [F.col(c) for c in (*analysis.EVIDENCE_ORDER, "value_num")]
    path = f"{scratch_root(spark)}/pages-{uuid.uuid4().hex}"
    return paging.PageIndex.build(_evidence(spark, folder), order, path).page(number=2, size=50)


@query(S.with_tables("m files", """SELECT file_id, item_code, CAST(count(*) AS BIGINT) AS n FROM m
  WHERE file_id IN (SELECT file_id FROM files WHERE owner_user_id = 7) GROUP BY 1, 2"""))
def owner_semi(spark, folder):
    rows = analysis.owned(S.measurements(spark, folder), S.files(spark, folder), 7)
    return rows.groupBy("file_id", "item_code").agg(F.count("*").alias("n"))


_RECORD_SQL = S.with_tables("m limits", f"""SELECT 'run-1' AS execution_id, '{C.RULESET_VERSION}' AS ruleset_version, 0 AS assumed,
  CAST(count(*) AS BIGINT) AS row_count, (SELECT CAST(count(*) AS BIGINT) FROM lines) AS limit_count,
  CAST(count(*) FILTER (EXISTS (SELECT 1 FROM lines l WHERE l.item_code = p.item_code AND (value > limit_max OR value < limit_min)))
  AS BIGINT) AS exceeded_count FROM points p""",
                            points="""SELECT CAST(measured_on AS VARCHAR) AS bucket, item_code,
  CAST(max(value_num) AS DOUBLE) AS value, count(*) AS n FROM m GROUP BY 1, 2""",
                            lines="""SELECT * FROM limits WHERE standard_set = '배출허용기준' AND (region_grade IS NULL OR region_grade = '가지역')
  AND (scale IS NULL OR scale = 'large')""")


@query(_RECORD_SQL)
def analysis_record(spark, folder):
    """The stored record of a run; its counts are over all points."""
    request = AnalysisRequest(region_grade="가지역", scale="large", bucket="none", metric="max", from_date=date(1990, 1, 1))
    points = analysis.series(S.measurements(spark, folder), request)
    record = analysis.run_record(points, analysis.series_limits(S.limits(spark), request), request, "", "run-1")
    return record.select("execution_id", "ruleset_version", F.size(F.from_json("assumptions", "array<string>")).alias("assumed"),
                         "row_count", "limit_count", "exceeded_count")


@query(f"""SELECT file_id, column_index,
  nullif(trim(value), '') AS text, CAST(count(*) AS BIGINT) AS n, min(source_row) AS first_at FROM ({_SUMMARY_CELLS}) GROUP BY ALL""")
def value_counts(spark, folder):
    """All distinct values per column."""
    return melting.value_counts(_summary_cells(spark, folder), ["file_id", "column_index"])


# --- limits --------------------------------------------------------------------

def _exceeding(spark, folder) -> DataFrame:
    return standards.exceedances(S.measurements(spark, folder), S.limits(spark), region_grade="가지역", scale="large")


_EXCEED_SQL = """SELECT m.*, limit_min, limit_max, l.source AS limit_source,
  CASE WHEN value_num > limit_max THEN '상한 초과' WHEN value_num < limit_min THEN '하한 미달' END AS verdict
  FROM m JOIN limits l ON l.item_code = m.item_code AND l.standard_set = '배출허용기준'
   AND (l.region_grade IS NULL OR l.region_grade = '가지역') AND (l.scale IS NULL OR l.scale = 'large')
  WHERE value_num IS NOT NULL AND (sample_type IS NULL OR sample_type <> '원폐수')
   AND (value_num > limit_max OR value_num < limit_min)"""
_EXCEED_OUT = ["site_name", "outlet", "sample_type", "measured_on", "item_code", "value_num", "unit", "limit_min",
               "limit_max", "limit_source", "reported_limit", "verdict", "file_id", "source_row", "source_column_index"]


@query(S.with_tables("m limits", f"""SELECT site_name, outlet, sample_type, measured_on, item_code,
  CAST(value_num AS DOUBLE) AS value_num, unit, CAST(limit_min AS DOUBLE) AS limit_min, CAST(limit_max AS DOUBLE) AS limit_max,
  limit_source, CAST(reported_limit AS DOUBLE) AS reported_limit, verdict, file_id, source_row, source_column_index
  FROM found""",
                     found=_EXCEED_SQL))
def exceedances(spark, folder):
    return _exceeding(spark, folder).select(_EXCEED_OUT).withColumns(S.dbl("value_num", "limit_min", "limit_max", "reported_limit"))


@query(S.with_tables("m limits", """SELECT CAST(count(*) AS BIGINT) AS exceeded_count,
  CAST(count(*) FILTER (reported_limit <> limit_max) AS BIGINT) AS limit_mismatch_count FROM found""", found=_EXCEED_SQL))
def exceedance_counts(spark, folder):
    return standards.exceedance_counts(_exceeding(spark, folder))


@query(S.with_tables("m limits", f"""SELECT bucket, item_code, value FROM points p WHERE EXISTS (SELECT 1 FROM limits l
  WHERE l.item_code = p.item_code AND standard_set = '배출허용기준' AND (region_grade IS NULL OR region_grade = '가지역')
  AND (scale IS NULL OR scale = 'large') AND (value > limit_max OR value < limit_min))""",
                     points="""SELECT strftime(measured_on, '%Y-%m') AS bucket, item_code, CAST(max(value_num) AS DOUBLE) AS value FROM m
  GROUP BY 1, 2"""))
def series_exceeded(spark, folder):
    request = AnalysisRequest(region_grade="가지역", scale="large", metric="max")
    points = analysis.series(S.measurements(spark, folder), request)
    return analysis.exceeded_points(points, analysis.series_limits(S.limits(spark), request)).select(
        "bucket", "item_code", F.col("value").cast("double").alias("value"))


@query(S.with_tables("m", """SELECT site_name, outlet, item_code, measured_on, CAST(value_num AS DOUBLE) AS value_num,
  CAST(reported_limit AS DOUBLE) AS reported_limit FROM m WHERE value_num > reported_limit
  AND (sample_type IS NULL OR sample_type <> '원폐수')"""))
def reported_exceed(spark, folder):
    found = standards.reported_exceedances(S.measurements(spark, folder))
    return found.select("site_name", "outlet", "item_code", "measured_on", "value_num", "reported_limit").withColumns(
        S.dbl("value_num", "reported_limit"))


_LIMIT_OUT = ["standard_set", "item_code", "region_grade", "scale", "limit_min", "limit_max", "legal_basis",
              "effective_from", "source"]
_LIMIT_SQL = """SELECT standard_set, item_code, region_grade, scale, CAST(limit_min AS DOUBLE) AS limit_min,
  CAST(limit_max AS DOUBLE) AS limit_max, legal_basis, effective_from, source FROM limit_rows"""


def _typed_limits(spark, folder) -> DataFrame:
    return standards.typed_limits(S.limit_rows(spark, folder))


@query(S.with_tables("limit_rows", _LIMIT_SQL))
def limits_load(spark, folder):
    return _typed_limits(spark, folder).select(_LIMIT_OUT).withColumns(S.dbl("limit_min", "limit_max"))


@query(S.with_tables("limit_rows", _LIMIT_SQL + """ WHERE standard_set = 'SMALL' AND region_grade = 'Brand#3'
  AND (scale IS NULL OR scale = 'large')"""))
def limits_lookup(spark, folder):
    return standards.limits_lookup(_typed_limits(spark, folder), "SMALL", "large", "Brand#3").select(
        _LIMIT_OUT).withColumns(S.dbl("limit_min", "limit_max"))


@query(S.with_tables("limit_rows", """SELECT standard_set, CAST(count(*) AS BIGINT) AS item_count,
  CAST(count(DISTINCT item_code) AS BIGINT) AS distinct_items, min(legal_basis) AS legal_basis, min(source) AS source,
  CAST(count(*) FILTER (source <> 'law') AS BIGINT) AS unverified_count FROM limit_rows GROUP BY 1"""))
def standard_sets(spark, folder):
    return standards.standard_sets(_typed_limits(spark, folder))


@query(S.with_tables("limit_rows", """SELECT DISTINCT region_grade FROM limit_rows WHERE region_grade IS NOT NULL"""))
def region_grades(spark, folder):
    return standards.region_grades(_typed_limits(spark, folder))


@query(S.with_tables("limit_rows", """SELECT id, standard_set, item_code, region_grade, scale FROM limit_rows
  QUALIFY row_number() OVER (PARTITION BY standard_set, item_code, coalesce(region_grade, ''), coalesce(scale, '')
  ORDER BY id DESC) = 1"""))
def dedupe_newest(spark, folder):
    raw = S.limit_rows(spark, folder)
    text = lambda c: values.blank_to_null(F.col(c)).alias(c)
    return standards.newest_limits(raw.select("id", *[text(c) for c in standards.LIMIT_KEY])).select(
        "id", *standards.LIMIT_KEY)


# --- summaries -----------------------------------------------------------------

@query(S.with_tables("m", """SELECT CAST(count(*) AS BIGINT) AS total_values, CAST(count(DISTINCT item_code) AS BIGINT)
  AS distinct_items, CAST(count(DISTINCT site_name) AS BIGINT) AS distinct_sites, min(measured_on) AS first_date,
  max(measured_on) AS last_date FROM m"""))
def measure_totals(spark, folder):
    return summaries.measurement_totals(S.measurements(spark, folder))


@query(S.with_tables("m", f"""SELECT item_code, CAST(count(*) AS BIGINT) AS n, {_avg(3)} AS avg_value,
  CAST(min(value_num) AS DOUBLE) AS min_value, CAST(max(value_num) AS DOUBLE) AS max_value FROM m GROUP BY 1"""))
def measure_by_item(spark, folder):
    return summaries.measurements_by_item(S.measurements(spark, folder)).withColumns(
        S.dbl("avg_value", "min_value", "max_value"))


def _options(column: str):
    def run(spark, folder):
        return summaries.distinct_values(S.measurements(spark, folder), column)
    run.__name__ = {"site_name": "options_sites", "outlet": "options_outlets",
                    "sample_type": "options_sample_types"}[column]
    return query(S.with_tables("m", f"SELECT DISTINCT {column} FROM m WHERE {column} IS NOT NULL"))(run)


for _column in ("site_name", "outlet", "sample_type"):
    _options(_column)


@query(S.with_tables("m", "SELECT item_code, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1"))
def options_items(spark, folder):
    return summaries.item_counts(S.measurements(spark, folder))


@query(S.with_tables("m", "SELECT min(measured_on) AS first_date, max(measured_on) AS last_date FROM m"))
def options_period(spark, folder):
    return summaries.measured_period(S.measurements(spark, folder))


@query(S.with_tables("m", """SELECT file_id, CAST(count(*) AS BIGINT) AS inserted_values,
  CAST(count(*) FILTER (NOT is_numeric) AS BIGINT) AS non_numeric_values,
  CAST(count(quality_flag) AS BIGINT) AS flagged_values,
  CAST(count(DISTINCT source_column_index) AS BIGINT) AS measured_columns,
  CAST(count(*) FILTER (item_code = 'WQ-001') AS BIGINT) AS source_rows FROM m GROUP BY 1"""))
def ingestion_audit(spark, folder):
    return summaries.ingestion_audit(S.measurements(spark, folder), grid(spark, folder).select("file_id", "source_row"))


@query(S.with_tables("m files", """SELECT file_id, owner_user_id, original_filename, item_rows, first_date, last_date,
  min_value, max_value FROM (SELECT file_id, CAST(count(*) AS BIGINT) AS item_rows, min(measured_on) AS first_date,
  max(measured_on) AS last_date, CAST(min(value_num) AS DOUBLE) AS min_value, CAST(max(value_num) AS DOUBLE) AS max_value
  FROM m WHERE item_code = 'WQ-002' GROUP BY 1) JOIN files USING (file_id)"""))
def source_audit(spark, folder):
    return summaries.source_audit(S.measurements(spark, folder), S.files(spark, folder), "WQ-002").withColumns(
        S.dbl("min_value", "max_value")).select("file_id", "owner_user_id", "original_filename", "item_rows",
                                                "first_date", "last_date", "min_value", "max_value")


@query(S.with_tables("m files", """SELECT file_id, site_name, owner_user_id, original_filename, item_rows, first_date,
  last_date FROM (SELECT file_id, coalesce(site_name, '(NULL)') AS site_name, CAST(count(*) AS BIGINT) AS item_rows,
  min(measured_on) AS first_date, max(measured_on) AS last_date FROM m WHERE item_code = 'WQ-002' GROUP BY 1, 2)
  JOIN files USING (file_id)"""))
def source_audit_by_site(spark, folder):
    return summaries.source_audit_by_site(S.measurements(spark, folder), S.files(spark, folder), "WQ-002").select(
        "file_id", "site_name", "owner_user_id", "original_filename", "item_rows", "first_date", "last_date")
