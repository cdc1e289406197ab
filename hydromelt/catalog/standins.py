"""The engine's tables, derived from the driver's parquet tables.

Each table exists twice: as a DataFrame and as a SQL common table expression,
so that every registered query can be checked against a database.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import values
from hydromelt.session import ship, spread

AS_OF = date(2000, 1, 1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dbl(*columns: str) -> dict[str, Column]:
    """Decimals as doubles, for comparison across engines."""
    return {c: F.col(c).cast("double") for c in columns}


def money(column: str) -> Column:
    """A two-decimal amount as cell text."""
    return F.col(column).cast("decimal(18,2)").cast("string")


# --- measurements -------------------------------------------------------------

MEASURES = (  # index, source column, item code, table column
    (4, "수량", "WQ-001", "l_quantity"), (5, "금액", "WQ-002", "l_extendedprice"),
    (6, "할인", "WQ-005", "l_discount"), (7, "세율", "WQ-006", "l_tax"))


def _sample_type() -> Column:
    return (F.when(F.col("l_linestatus") == "F", C.INFLUENT)
            .when(F.col("l_returnflag") != "R", "방류수"))


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as a stored long table: one value per row and measured column."""
    none = F.lit(None).cast(values.DECIMAL)
    entries = [F.struct(
        F.lit(i).alias("source_column_index"), F.lit(name).alias("source_column"), F.lit(code).alias("item_code"),
        F.lit("mg/L" if i < 6 else None).cast("string").alias("unit"),
        (F.when(F.col(c) > 0, F.col(c)) if c == "l_discount" else F.col(c)).cast(values.DECIMAL).alias("value_num"),
        ((F.col("l_linenumber") * 8).cast(values.DECIMAL) if i == 4 else none).alias("reported_limit"))
        for i, name, code, c in MEASURES]
    long = spread(table(spark, folder, "lineitem"), "l_orderkey").select(
        F.col("l_suppkey").alias("file_id"), F.col("l_orderkey").alias("source_row"),
        F.concat(F.lit("site-"), F.col("l_suppkey").cast("string")).alias("site_name"),
        F.col("l_returnflag").alias("outlet"), _sample_type().alias("sample_type"),
        F.col("l_shipdate").cast("date").alias("measured_on"),
        (F.col("l_suppkey") * 10 + F.when(F.year("l_shipdate") < 1998, 0).otherwise(1)).alias("mapping_run_id"),
        F.explode(F.array(*entries)).alias("m"))
    flag = values.quality_flag(F.col("value_num"), F.when(F.col("value_num").isNull(), "non_numeric").otherwise("ok"),
                               F.col("measured_on"), F.lit(AS_OF))
    return long.select("*", "m.*").drop("m").withColumn(
        "is_numeric", F.col("value_num").isNotNull()).withColumn("quality_flag", flag)


_ROWS = """SELECT l_suppkey AS file_id, l_orderkey AS source_row, 'site-' || l_suppkey AS site_name,
  l_returnflag AS outlet,
  CASE WHEN l_linestatus = 'F' THEN '원폐수' WHEN l_returnflag <> 'R' THEN '방류수' END AS sample_type,
  CAST(l_shipdate AS DATE) AS measured_on,
  l_suppkey * 10 + CASE WHEN year(l_shipdate) < 1998 THEN 0 ELSE 1 END AS mapping_run_id, """

M_SQL = " UNION ALL ".join(
    f"""{_ROWS} {i} AS source_column_index, '{name}' AS source_column, '{code}' AS item_code,
  {"'mg/L'" if i < 6 else "CAST(NULL AS VARCHAR)"} AS unit,
  CAST({f"CASE WHEN {c} > 0 THEN {c} END" if c == "l_discount" else c} AS DECIMAL(18,6)) AS value_num,
  {"CAST(l_linenumber * 8 AS DECIMAL(18,6))" if i == 4 else "CAST(NULL AS DECIMAL(18,6))"} AS reported_limit
  FROM lineitem""" for i, name, code, c in MEASURES)
M_SQL = f"""SELECT *, value_num IS NOT NULL AS is_numeric,
  CASE WHEN value_num IS NULL THEN 'non_numeric' WHEN measured_on > DATE '{AS_OF}' THEN 'future_date'
       WHEN value_num < 0 THEN 'negative' END AS quality_flag FROM ({M_SQL})"""

_LIMITS = (  # standard_set, item, region, scale, min, max, source
    ("배출허용기준", "WQ-001", "가지역", "large", None, "30", "law"),
    ("배출허용기준", "WQ-001", "가지역", "small", None, "40", "law"),
    ("배출허용기준", "WQ-001", "나지역", "large", None, "45", "law"),
    ("배출허용기준", "WQ-002", "가지역", None, "5000", "90000", "law"),
    ("배출허용기준", "WQ-002", None, "large", None, "80000", "demo"),
    ("배출허용기준", "WQ-005", None, None, "0.02", None, "law"),
    ("방류수수질기준", "WQ-006", None, None, None, "0.05", "law"))


def limits(spark: SparkSession) -> DataFrame:
    """The limits dimension that measurements are checked against."""
    rows = spark.createDataFrame(_LIMITS, "standard_set string, item_code string, region_grade string, "
                                          "scale string, limit_min string, limit_max string, source string")
    return rows.select("standard_set", "item_code", "region_grade", "scale",
                       F.col("limit_min").cast(values.DECIMAL).alias("limit_min"),
                       F.col("limit_max").cast(values.DECIMAL).alias("limit_max"), "source",
                       F.lit("mg/L").alias("unit"), F.lit("별표 13").alias("legal_basis"))


def _lit(value, kind: str) -> str:
    return f"CAST(NULL AS {kind})" if value is None else f"CAST('{value}' AS {kind})"


L_SQL = " UNION ALL ".join(
    f"SELECT {_lit(s, 'VARCHAR')} AS standard_set, {_lit(i, 'VARCHAR')} AS item_code, {_lit(r, 'VARCHAR')} AS region_grade,"
    f" {_lit(c, 'VARCHAR')} AS scale, {_lit(lo, 'DECIMAL(18,6)')} AS limit_min, {_lit(hi, 'DECIMAL(18,6)')} AS limit_max,"
    f" '{src}' AS source" for s, i, r, c, lo, hi, src in _LIMITS)


# --- files, rounds, review items ----------------------------------------------

def files(spark: SparkSession, folder: str) -> DataFrame:
    balance = F.col("s_acctbal")
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("file_id"), F.col("s_nationkey").alias("owner_user_id"),
        F.concat("s_name", F.lit(".csv")).alias("original_filename"),
        F.when(balance < 2000, "uploaded").when(balance < 6000, "reviewing").otherwise("completed").alias("status"),
        (balance * 100).cast("decimal(18,0)").cast("bigint").alias("size_bytes"))


F_SQL = """SELECT s_suppkey AS file_id, s_nationkey AS owner_user_id, s_name || '.csv' AS original_filename,
  CASE WHEN s_acctbal < 2000 THEN 'uploaded' WHEN s_acctbal < 6000 THEN 'reviewing' ELSE 'completed' END AS status,
  CAST(round(s_acctbal * 100) AS BIGINT) AS size_bytes FROM supplier"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as mapping rounds of a file, counts taken from the whole text."""
    count = lambda letter: F.length("text") - F.length(F.replace(F.col("text"), F.lit(letter), F.lit("")))
    part = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 10 + F.col("turn")).alias("mapping_run_id"), F.col("conv_id").alias("file_id"),
        (F.col("turn") + 1).cast("int").alias("round_no"), F.length("text").alias("total_columns"),
        count("e").alias("auto_mapped"), count("n").alias("needs_review"),
        F.concat(F.lit("dict-"), F.col("turn").cast("string")).alias("dictionary_version"), "role")
    return part.withColumn("auto_mapped_rate", values.rate(F.col("auto_mapped"), F.col("total_columns")))


R_SQL = """SELECT *, CAST(CASE WHEN total_columns = 0 THEN 0
  ELSE (2000 * auto_mapped + total_columns) // (2 * total_columns) END AS INTEGER) AS rate10 FROM (
  SELECT conv_id * 10 + turn AS mapping_run_id, conv_id AS file_id, CAST(turn + 1 AS INTEGER) AS round_no,
  CAST(length(text) AS BIGINT) AS total_columns, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS auto_mapped,
  CAST(length(text) - length(replace(text, 'n', '')) AS BIGINT) AS needs_review,
  'dict-' || turn AS dictionary_version, role FROM conversations)"""


def review_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as review items; labels are the verdicts of those decided so far."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    lang = F.col("lang")
    verdict = (F.when(F.col("toxic") == 1, "기각").when((F.col("quality") == 1) & (lang == "de"), "MD-009")
               .when(F.col("quality") == 1, "승인").when(F.col("quality") == 0, "no_match"))
    return docs.select(
        F.col("doc_id").alias("id"), F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("file_id"),
        lang.alias("raw"), F.length("source").alias("column_index"),
        F.when(lang == "de", "unmapped").otherwise("needs_review").alias("mapping_status"),
        F.when(lang == "en", "WQ-001").when(lang == "fr", "WQ-002").when(lang == "es", "WQ-003").alias("candidate_code"),
        verdict.alias("verdict"), F.col("n_chars").alias("created_at"),
        F.when(verdict.isNotNull(), F.col("n_chars") + F.col("doc_id")).alias("reviewed_at"),
        F.when(verdict.isNotNull() & (F.col("n_chars") < 1000), F.col("n_chars")).alias("exported_at"),
        F.when(verdict.isNotNull(), F.lit("검수자")).alias("reviewed_by"),
        F.lit(None).cast("string").alias("verdict_note"))


I_SQL = """SELECT doc_id AS id, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS file_id, lang AS raw,
  CAST(length(source) AS INTEGER) AS column_index,
  CASE WHEN lang = 'de' THEN 'unmapped' ELSE 'needs_review' END AS mapping_status,
  CASE lang WHEN 'en' THEN 'WQ-001' WHEN 'fr' THEN 'WQ-002' WHEN 'es' THEN 'WQ-003' END AS candidate_code,
  verdict, n_chars AS created_at, CASE WHEN verdict IS NOT NULL THEN n_chars + doc_id END AS reviewed_at,
  CASE WHEN verdict IS NOT NULL AND n_chars < 1000 THEN n_chars END AS exported_at,
  CASE WHEN verdict IS NOT NULL THEN '검수자' END AS reviewed_by
  FROM (SELECT d.doc_id, d.source, d.lang, d.n_chars,
    CASE WHEN l.toxic = 1 THEN '기각' WHEN l.quality = 1 AND d.lang = 'de' THEN 'MD-009'
         WHEN l.quality = 1 THEN '승인' WHEN l.quality = 0 THEN 'no_match' END AS verdict
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


# --- file columns and their mapping --------------------------------------------

def mapped_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as mapped file columns: a brand is a file, the part key a position."""
    kind, size = F.col("p_type"), F.lpad(F.col("p_size").cast("string"), 3, "0")
    status = (F.when(kind.isin("ECONOMY", "STANDARD"), "exact").when(kind == "SMALL", "fuzzy_auto")
              .when(kind == "MEDIUM", "needs_review").when(kind == "PROMO", "unmapped").otherwise("unheard-of"))
    code = F.concat(F.when(F.col("p_size") <= 30, "WQ-").otherwise("MD-"), size)
    auto = status.isin(*C.AUTO_STATUSES)
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("filename"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint").alias("file_id"),
        F.col("p_partkey").cast("int").alias("column_index"), F.col("p_name").alias("raw"), status.alias("status"),
        F.when(auto, code).alias("code"), F.when(status == "needs_review", code).alias("candidate_code"),
        F.when(kind == "STANDARD", F.split_part("p_name", F.lit(" "), F.lit(1))).alias("site"),
        F.when(~auto, F.col("p_size").cast("decimal(4,1)")).alias("score"),
        F.when(auto, values.dict_type_of(code)).alias("dict_type"))


C_SQL = """SELECT filename, file_id, column_index, raw, status, CASE WHEN auto THEN full_code END AS code,
  CASE WHEN status = 'needs_review' THEN full_code END AS candidate_code, site,
  CASE WHEN NOT auto THEN CAST(p_size AS DECIMAL(4,1)) END AS score,
  CASE WHEN auto THEN CASE WHEN full_code LIKE 'WQ-%' THEN '측정항목' ELSE '메타' END END AS dict_type
  FROM (SELECT *, status IN ('exact', 'fuzzy_auto') AS auto FROM (
    SELECT p_brand AS filename, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS file_id,
      CAST(p_partkey AS INTEGER) AS column_index, p_name AS raw, p_size,
      CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'exact' WHEN p_type = 'SMALL' THEN 'fuzzy_auto'
           WHEN p_type = 'MEDIUM' THEN 'needs_review' WHEN p_type = 'PROMO' THEN 'unmapped' ELSE 'unheard-of' END AS status,
      CASE WHEN p_size <= 30 THEN 'WQ-' ELSE 'MD-' END || lpad(CAST(p_size AS VARCHAR), 3, '0') AS full_code,
      CASE WHEN p_type = 'STANDARD' THEN split_part(p_name, ' ', 1) END AS site FROM part))"""


# --- dictionary tables ---------------------------------------------------------

def synonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as dictionary spellings, one row per spelling and source."""
    size, number = F.col("p_size"), F.lpad(F.col("p_size").cast("string"), 3, "0")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_no"),
        F.when(size <= 30, F.concat(F.lit("WQ-"), number)).alias("measurement_code"),
        F.when(size > 30, F.concat(F.lit("MD-"), number)).alias("metadata_code"),
        F.when(size <= 30, "measurement").otherwise("metadata").alias("term_kind"),
        F.concat_ws(" ", "p_name", "p_type").alias("surface"), F.col("p_brand").alias("source_id"),
        F.when(F.col("p_type") == "PROMO", "rejected").otherwise("verified").alias("review_status"),
        F.date_add(F.lit(date(2024, 1, 1)), size).alias("collected_on"))


S_SQL = """SELECT p_partkey AS row_no,
  CASE WHEN p_size <= 30 THEN 'WQ-' || lpad(CAST(p_size AS VARCHAR), 3, '0') END AS measurement_code,
  CASE WHEN p_size > 30 THEN 'MD-' || lpad(CAST(p_size AS VARCHAR), 3, '0') END AS metadata_code,
  CASE WHEN p_size <= 30 THEN 'WQ-' ELSE 'MD-' END || lpad(CAST(p_size AS VARCHAR), 3, '0') AS code,
  CASE WHEN p_size <= 30 THEN 'measurement' ELSE 'metadata' END AS term_kind,
  p_name || ' ' || p_type AS surface, p_brand AS source_id,
  CASE WHEN p_type = 'PROMO' THEN 'rejected' ELSE 'verified' END AS review_status,
  DATE '2024-01-01' + p_size AS collected_on FROM part"""


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Brands as spelling sources; one without any spelling is added by the regions."""
    brands = table(spark, folder, "part").select(F.col("p_brand").alias("source_id")).distinct()
    regions = table(spark, folder, "region").select(F.col("r_name").alias("source_id"))
    return brands.unionByName(regions).select(
        "source_id", F.lower("source_id").alias("source_name"),
        F.when(F.col("source_id").endswith("1"), "inferred").otherwise("observed").alias("reliability"))


SRC_SQL = """SELECT source_id, lower(source_id) AS source_name,
  CASE WHEN source_id LIKE '%1' THEN 'inferred' ELSE 'observed' END AS reliability
  FROM (SELECT DISTINCT p_brand AS source_id FROM part UNION ALL SELECT r_name FROM region)"""


def terms(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Part sizes as standard terms of one kind."""
    size = F.col("p_size")
    wanted = size <= 30 if kind == "measurement" else size > 30
    prefix = "WQ-" if kind == "measurement" else "MD-"
    part = table(spark, folder, "part").where(wanted).groupBy("p_size").agg(
        F.min("p_name").alias("low"), F.max("p_name").alias("high"), F.max("p_type").alias("kind"),
        F.count("*").alias("n"))
    base = part.select(
        F.concat(F.lit(prefix), F.lpad(size.cast("string"), 3, "0")).alias("code"), size.alias("row_no"),
        F.concat_ws(" ", "low", F.lit("STANDARD")).alias("std_name"), F.col("high").alias("name_en"),
        F.when(size < 10, "-").otherwise(F.concat(F.lit("T"), size.cast("string"))).alias("abbr"),
        F.when(F.col("low") < "b", "draft").otherwise("verified").alias("review_status"))
    if kind == "measurement":
        return base.select("*", F.lit("mg/L").alias("unit"), F.col("name_en").alias("category"),
                           F.lit("별표 13").alias("legal_basis"), F.lit("statutory").alias("legal_status"))
    return base.select("*", F.lit("station").alias("facet"), F.lit("공통표준용어").alias("standard_basis"))


def T_SQL(kind: str) -> str:
    wanted, prefix = ("<= 30", "WQ-") if kind == "measurement" else ("> 30", "MD-")
    own = ("'mg/L' AS unit, max(p_name) AS category, '별표 13' AS legal_basis, 'statutory' AS legal_status"
           if kind == "measurement" else "'station' AS facet, '공통표준용어' AS standard_basis")
    return f"""SELECT '{prefix}' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS code, p_size AS row_no,
  min(p_name) || ' STANDARD' AS std_name, max(p_name) AS name_en,
  CASE WHEN p_size < 10 THEN '-' ELSE 'T' || p_size END AS abbr,
  CASE WHEN min(p_name) < 'b' THEN 'draft' ELSE 'verified' END AS review_status, {own}
  FROM part WHERE p_size {wanted} GROUP BY p_size"""


def limit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as raw limit rows: texts with blanks, as a limits file holds them."""
    text = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" "))
    bound = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), text("p_type").alias("standard_set"),
        F.concat(F.lit("WQ-"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("item_code"),
        F.col("p_name").alias("item_name"),
        F.when(F.col("p_brand") == "Brand#1", " ").otherwise(F.col("p_brand")).alias("region_grade"),
        F.when(F.col("p_size") < 20, "large").when(F.col("p_size") < 40, "small").otherwise("").alias("scale"),
        F.when(F.col("p_type") == "SMALL", bound).otherwise("").alias("limit_min"),
        F.when(F.col("p_type") == "LARGE", "n/a").otherwise(bound).alias("limit_max"), F.lit("mg/L").alias("unit"),
        F.lower("p_name").alias("legal_basis"), F.lit("").alias("legal_article"),
        F.when(F.col("p_type") == "PROMO", "2026-13-01").otherwise("2026-06-22").alias("effective_from"),
        F.when(F.col("p_brand").endswith("2"), "").otherwise("law").alias("source"), F.lit("").alias("note"))


LR_SQL = """SELECT p_partkey AS id, p_type AS standard_set, 'WQ-' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS item_code,
  CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS region_grade,
  CASE WHEN p_size < 20 THEN 'large' WHEN p_size < 40 THEN 'small' END AS scale,
  CASE WHEN p_type = 'SMALL' THEN CAST(p_retailprice AS DECIMAL(18,2)) END AS limit_min,
  CASE WHEN p_type <> 'LARGE' THEN CAST(p_retailprice AS DECIMAL(18,2)) END AS limit_max,
  lower(p_name) AS legal_basis, CASE WHEN p_type <> 'PROMO' THEN DATE '2026-06-22' END AS effective_from,
  CASE WHEN p_brand LIKE '%2' THEN 'demo' ELSE 'law' END AS source FROM part"""


CTES = {
    "m": M_SQL, "limits": L_SQL, "files": F_SQL, "runs": R_SQL, "items": I_SQL, "cols": C_SQL, "syn": S_SQL,
    "src": SRC_SQL, "mterms": T_SQL("measurement"), "dterms": T_SQL("metadata"), "limit_rows": LR_SQL,
}


def with_tables(tables: str, query: str, /, **extra: str) -> str:
    """A query over the named stand-in tables and further expressions, in order."""
    parts = [f"{n} AS ({CTES[n]})" for n in tables.split()] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query


def squared_body(expr: str, loops: int = 4) -> str:
    """SQL for the name key of a text: brackets out, separators out, unit tails out."""
    body = f"lower(regexp_replace(trim({expr}), '\\([^()]*\\)', '', 'g'))"
    body = f"regexp_replace({body}, '{C.SEPARATORS}', '', 'g')"
    for _ in range(loops):
        body = f"regexp_replace({body}, '{C.TRAILING_UNIT}', '')"
    return body


def ratio_sql(a: str, b: str) -> str:
    """SQL for the indel similarity of two texts of up to 60 characters, 0..100.

    The common subsequence is folded over the characters of ``b`` on the bits of ``a``.
    """
    full = f"((CAST(1 AS BIGINT) << CAST(length({a}) AS INTEGER)) - 1)"
    masks = (f"list_transform(string_split({b}, ''), lambda ch: CAST(list_sum(list_transform(generate_series(1, length({a})), "
             f"lambda i: CASE WHEN substr({a}, CAST(i AS INTEGER), 1) = ch THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER) "
             f"ELSE 0 END)) AS BIGINT))")
    row = f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    common = f"(length({a}) - bit_count({row}))"
    total = f"CAST(length({a}) + length({b}) AS DOUBLE)"
    return f"((1.0 - (length({a}) + length({b}) - 2 * {common}) / {total}) * 100.0)"
