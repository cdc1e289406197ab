"""Queries over cell texts, headers, hashes and JSON columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hydromelt.catalog import standins as S
from hydromelt.catalog.registry import Topic
from hydromelt.functions import names, values
from hydromelt.operators import headers
from hydromelt.operators.lexicon import flag_listed
from hydromelt.session import scratch_root
from hydromelt.sources import files, lines, ndjson

query = Topic()


# --- numbers -------------------------------------------------------------------

def _price_cells(spark, folder):
    """Order totals in the notations number cells come in."""
    price, kind = S.money("o_totalprice"), F.col("o_orderpriority")
    whole = F.floor(F.col("o_totalprice").cast("decimal(18,2)")).cast("bigint")
    thousands = F.concat(F.floor(whole / 1000).cast("string"), F.lit(","),
                         F.lpad((whole - F.floor(whole / 1000) * 1000).cast("string"), 3, "0"))
    text = (F.when(F.col("o_orderstatus") == "P", F.when(kind == "1-URGENT", "N.D.").when(kind == "2-HIGH", "1e5")
                   .when(kind == "3-MEDIUM", "불검출").when(kind == "5-LOW", "-"))
            .when(kind == "1-URGENT", thousands).when(kind == "2-HIGH", F.concat(F.lit("<"), price))
            .when(kind == "3-MEDIUM", F.concat(F.lit("≥ "), price)).when(kind == "5-LOW", F.concat(F.lit("-"), price))
            .otherwise(price))
    return S.table(spark, folder, "orders").select("o_orderkey", text.alias("text"))


_PRICES_SQL = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL
  WHEN o_orderpriority = '1-URGENT' THEN floor(CAST(o_totalprice AS DECIMAL(18,2)))
  WHEN o_orderpriority = '5-LOW' THEN -CAST(o_totalprice AS DECIMAL(18,2))
  ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS number,
  CASE WHEN o_orderstatus <> 'P' THEN 'ok' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'empty' ELSE 'non_numeric' END AS reason,
  o_orderstatus <> 'P' AND o_orderpriority IN ('2-HIGH', '3-MEDIUM') AS censored FROM orders"""


@query(f"SELECT o_orderkey, CAST(number AS DOUBLE) AS value, reason, censored FROM ({_PRICES_SQL})")
def parse_number(spark, folder):
    text = F.col("text")
    return _price_cells(spark, folder).select(
        "o_orderkey", values.parse_number(text).cast("double").alias("value"), values.parse_reason(text).alias("reason"),
        values.is_censored(text, values.number_text(text)).alias("censored"))


# --- dates ---------------------------------------------------------------------

def _date_text():
    day, kind = F.col("o_orderdate"), F.col("o_orderpriority")
    return (F.when(F.col("o_orderstatus") == "F", F.concat(F.date_format(day, "yyyy-MM/dd")))
            .when(kind == "1-URGENT", F.date_format(day, "yyyy-M-d")).when(kind == "2-HIGH", F.date_format(day, "yyyy/MM/dd"))
            .when(kind == "3-MEDIUM", F.date_format(day, "yyyy.MM.dd HH:mm"))
            .when(kind == "5-LOW", F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "yy-MM-dd")))


_READABLE = "o_orderstatus <> 'F' AND o_orderpriority <> '4-NOT SPECIFIED'"


@query(f"SELECT o_orderkey, CASE WHEN {_READABLE} THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders")
def parse_date(spark, folder):
    return S.table(spark, folder, "orders").select("o_orderkey", values.parse_date(_date_text()).alias("parsed"))


@query(f"""SELECT o_orderkey, CASE WHEN {_READABLE} THEN CAST(o_orderdate AS DATE)
    WHEN o_orderstatus = 'O' THEN make_date(year(o_orderdate), month(o_orderdate), 1)
    WHEN o_orderstatus = 'F' THEN make_date(year(o_orderdate), 1, 1) END AS measured_on,
  CASE WHEN NOT ({_READABLE}) THEN '1분기' END AS period_label FROM orders""")
def resolve_date(spark, folder):
    """Dates from a date cell, else from year and month cells."""
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    cells = S.table(spark, folder, "orders").select(
        "o_orderkey", _date_text().alias("d"), F.lit(None).cast("string").alias("dt"),
        F.when(status != "P", F.concat(F.year(day).cast("string"), F.lit(".0"))).alias("y"),
        F.when(status == "F", "13").otherwise(F.date_format(day, "MM")).alias("m"), F.lit("1분기").alias("label"))
    return values.resolve_dates(cells, "d", "dt", "y", "m", "label")


# --- headers -------------------------------------------------------------------

def _grids(spark, folder):
    """Customers as small files: a title line, a header line, two data lines."""
    balance, name = S.money("c_acctbal"), F.col("c_name")
    none = F.lit(None).cast("string")
    title = F.when(F.col("c_acctbal") < 5000, F.array(name, none, none, none)).otherwise(
        F.array(name, F.col("c_mktsegment"), F.lit("nan"), F.lit("1e5")))
    head = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("a"), F.lit("a"), F.lit("c"), F.lit(" "))).otherwise(
        F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("12")))
    rows = F.array(title, head, F.array(name, balance, F.lit("1,000"), F.lit("3")),
                   F.array(F.lit("x"), F.lit("-1.5"), F.lit("2024-01-02 00:00:00"), none))
    return S.table(spark, folder, "customer").select(F.col("c_custkey").alias("file_id"),
                                                     F.posexplode(rows).alias("row_idx", "cells"))


_GRID_SQL = """SELECT c_custkey AS file_id, unnest([0, 1, 2, 3]) AS row_idx, unnest([
  CASE WHEN c_acctbal < 5000 THEN [c_name, NULL, NULL, NULL] ELSE [c_name, c_mktsegment, 'nan', '1e5'] END,
  CASE WHEN c_mktsegment = 'BUILDING' THEN ['a', 'a', 'c', ' '] ELSE ['a', 'b', 'c', '12'] END,
  [c_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '1,000', '3'],
  ['x', '-1.5', '2024-01-02 00:00:00', NULL]]) AS cells FROM customer"""


@query(S.with_tables("", """SELECT file_id, CAST(row_idx AS BIGINT) AS header_row, CAST(score AS BIGINT) AS header_score
  FROM (SELECT *, texts + CASE WHEN texts > 0 AND distinct_cells = filled THEN 1 ELSE 0 END AS score FROM scored)
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, row_idx) = 1""",
                     grid=_GRID_SQL, long="SELECT file_id, row_idx, unnest(cells) AS cell FROM grid",
                     scored="""SELECT file_id, row_idx, count(*) AS filled, count(DISTINCT cell) AS distinct_cells,
  count(*) FILTER (try_cast(replace(cell, ',', '') AS DOUBLE) IS NULL AND cell NOT LIKE '____-__-__ __:__:__') AS texts
  FROM long WHERE trim(cell) <> '' GROUP BY ALL"""))
def header_detect(spark, folder):
    return headers.header_rows(_grids(spark, folder)).select(
        "file_id", F.col("header_row").cast("bigint").alias("header_row"),
        F.col("header_score").cast("bigint").alias("header_score"))


@query(S.with_tables("", """SELECT c_custkey AS file_id, i AS column_index,
  CASE WHEN segment AND low AND i = 3 THEN 'UNNAMED_3' WHEN high THEN
    CASE i WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN 'nan' ELSE '1e5' END
  ELSE CASE i WHEN 0 THEN 'a' WHEN 1 THEN CASE WHEN segment THEN 'a' ELSE 'b' END WHEN 2 THEN 'c' ELSE '12' END END AS raw
  FROM flags, (SELECT unnest([0, 1, 2, 3]) AS i)""",
                     flags="""SELECT *, c_mktsegment = 'BUILDING' AS segment, c_acctbal < 5000 AS low,
  c_acctbal >= 5000 AND c_mktsegment = 'BUILDING' AS high FROM customer"""))
def merged_header(spark, folder):
    """Column names of those files, blanks filled from group headers above."""
    cells = _grids(spark, folder)
    return headers.file_columns(cells, headers.header_rows(cells))


# --- files ----------------------------------------------------------------------

@query("""SELECT CAST(c_custkey AS VARCHAR) AS first_cell, c_mktsegment AS second_cell,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN c_name END AS third_cell,
  CASE WHEN c_custkey % 11 = 0 AND c_custkey % 7 <> 0 THEN 4 ELSE 3 END AS width,
  c_custkey % 11 = 0 AND c_custkey % 7 <> 0 AS ragged, 'utf-8-sig' AS encoding FROM customer""")
def csv_read_back(spark, folder):
    """Customers written as CSV lines, some short, some too long, some with missing marks, and read again by line."""
    key = F.col("c_custkey")
    name = F.when(key % 7 != 0, F.when(key % 5 == 0, "NA").otherwise(F.col("c_name")))
    cells = F.concat_ws(",", key.cast("string"), "c_mktsegment", name, F.when((key % 11 == 0) & (key % 7 != 0), "too much"))
    body = S.table(spark, folder, "customer").select((key % 4).alias("part"), F.lit(1).alias("place"), cells.alias("line"))
    heads = body.select("part").distinct().select("part", F.lit(0).alias("place"), F.lit("key,segment,name").alias("line"))
    path = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    # One file per part, its header first; the separator and quote marks never occur, so lines are written as they are.
    (body.unionByName(heads).repartition(4, "part").sortWithinPartitions("part", "place").select("part", "line").write
     .options(sep="\x01", quote="\x02", escape="\x02").partitionBy("part").csv(path))
    grid = files.read_folder(spark, path, whole_bytes=0).where("row_idx > 0")
    return grid.select(*[F.get("cells", F.lit(i)).alias(f"{nth}_cell") for i, nth in enumerate(("first", "second", "third"))],
                       F.size("cells").alias("width"), "ragged", "encoding")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS first_cell, CASE WHEN c_custkey % 9 = 0 THEN NULL
    ELSE '"' || c_name || '"' || repeat(chr(10) || '물, ' || c_mktsegment, CAST(c_custkey % 4 AS INTEGER)) END AS second_cell,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS third_cell, CASE WHEN c_custkey % 2 = 0 THEN 'utf-8-sig' ELSE 'cp949' END AS encoding
  FROM customer""")
def csv_quoted(spark, folder):
    """Customers written as CSV with quotes and line breaks in cells, in two encodings, and read by line in small blocks."""
    key = F.col("c_custkey")
    text = F.when(key % 9 != 0, F.concat(F.lit('"'), "c_name", F.lit('"'), F.repeat(F.concat(
        F.lit("\n물, "), "c_mktsegment"), (key % 4).cast("int"))))
    rows = S.table(spark, folder, "customer").select(
        key.cast("string").alias("key"), text.alias("text"), F.when(key % 5 != 0, F.col("c_mktsegment")).alias("segment"), (key % 2).alias("odd"))
    path = f"{scratch_root(spark)}/quoted-{uuid.uuid4().hex}"
    with lines.java_charsets(spark):
        for odd, encoding in ((0, "UTF-8"), (1, lines.KOREAN)):
            rows.where(F.col("odd") == odd).drop("odd").write.options(header=True, escape='"', encoding=encoding).csv(f"{path}/{odd}")
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        grid = files.read_folder(spark, path, whole_bytes=0).where("row_idx > 0")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    return grid.select(*[F.get("cells", F.lit(i)).alias(f"{nth}_cell") for i, nth in enumerate(("first", "second", "third"))], "encoding")


# --- keys, hashes, JSON ----------------------------------------------------------

_SPELLED = "p_name || ' (' || p_type || ') ' || p_brand"


def _spelled(spark, folder):
    return S.table(spark, folder, "part").select(F.concat(
        "p_name", F.lit(" ("), "p_type", F.lit(") "), "p_brand").alias("name")).distinct()


def _key_sql(key: str) -> str:
    return f"SELECT name, {key} AS key FROM (SELECT DISTINCT {_SPELLED} AS name FROM part)"


@query(_key_sql("lower(regexp_replace(name, '[^0-9A-Za-z가-힣]', '', 'g'))"))
def wq_normalize(spark, folder):
    return _spelled(spark, folder).select("name", names.wq_normalize(F.col("name")).alias("key"))


@query(_key_sql("regexp_replace(lower(name), '[\\s_\\-./()\\[\\]{}]+', '', 'g')"))
def org_alias_norm(spark, folder):
    return _spelled(spark, folder).select("name", names.alias_key(F.col("name")).alias("key"))


@query(_key_sql("regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g')"))
def alnum_key(spark, folder):
    return _spelled(spark, folder).select("name", names.alnum_key(F.col("name")).alias("key"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents")
def content_hash(spark, folder):
    """Hash and size of every whole text."""
    return S.table(spark, folder, "documents").select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size_bytes"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k
  FROM events""")
def json_props(spark, folder):
    """A JSON column with unreadable texts replaced by a fallback."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), "props")).otherwise(F.col("props"))
    parsed = values.json_or(text, "struct<k:bigint>", F.struct(F.lit(-1).cast("bigint").alias("k")))
    return S.table(spark, folder, "events").select("event_id", parsed["k"].alias("k"))


@query("""SELECT event_id AS source_row, user_id AS source_column_index, event_type AS source_column,
  CASE WHEN event_type = 'view' THEN NULL ELSE CAST(value AS DOUBLE) END AS value_num, event_type <> 'view' AS is_numeric,
  CAST(ts AS DATE) AS measured_on FROM events""")
def ndjson_rows(spark, folder):
    """Records written as JSON lines and read back, meta and blank lines dropped."""
    viewed = F.col("event_type") == "view"
    records = S.table(spark, folder, "events").select(
        F.lit("f").alias("file_id"), F.col("event_id").alias("source_row"), F.col("event_type").alias("source_column"),
        F.col("user_id").cast("int").alias("source_column_index"), F.lit("WQ-001").alias("item_code"),
        F.when(~viewed, F.col("value")).cast(values.DECIMAL).alias("value_num"), (~viewed).alias("is_numeric"),
        F.col("ts").cast("date").alias("measured_on"))
    lines = ndjson.record_lines(records)
    extra = records.groupBy("file_id").agg(F.count("*").alias("source_rows"))
    blank = extra.select("file_id", F.lit("  ").alias("value"))
    every = lines.unionByName(ndjson.meta_lines(extra)).unionByName(blank)
    return ndjson.parse_lines(every).select(
        "source_row", F.col("source_column_index").cast("bigint").alias("source_column_index"), "source_column",
        F.col("value_num").cast("double").alias("value_num"), "is_numeric", "measured_on")


@query("""SELECT p_partkey, p_size, CASE WHEN n_name IS NOT NULL THEN true WHEN p_type = 'STANDARD' THEN false END
  AS is_toxic_substance, CASE WHEN n_name IS NOT NULL THEN '제' || n_nationkey || '호(' || n_name || ')'
  WHEN p_type = 'STANDARD' THEN '별표 3 목록에 없음' ELSE '' END AS toxic_substance_basis
  FROM part LEFT JOIN nation ON n_nationkey = p_size""")
def flag_by_list(spark, folder):
    """Terms flagged by membership in an official list; the nations serve as the list."""
    code = lambda c: F.lpad(F.col(c).cast("string"), 3, "0").alias("code")
    listed = S.table(spark, folder, "nation").select(
        code("n_nationkey"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("label"))
    status = F.when(F.col("p_type") == "STANDARD", "statutory").otherwise("non_statutory")
    terms = S.table(spark, folder, "part").select("p_partkey", "p_size", code("p_size"), status.alias("legal_status"))
    return flag_listed(terms, listed).select("p_partkey", "p_size", "is_toxic_substance", "toxic_substance_basis")
