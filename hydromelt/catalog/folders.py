"""Queries that run the folder jobs on files written from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.catalog import mapping as names
from hydromelt.catalog import standins as S
from hydromelt.catalog.registry import Topic
from hydromelt.functions.names import alias_key
from hydromelt.plans import mapping
from hydromelt.session import scratch_root
from hydromelt.sources import dictionaries, sinks

query = Topic()


def _folder(spark) -> str:
    return f"{scratch_root(spark)}/folders-{uuid.uuid4().hex}"


def _numbered_types(spark, folder):
    """Part types with a code each, in order."""
    types = S.table(spark, folder, "part").select("p_type").distinct()
    return types.withColumn("k", F.row_number().over(Window.orderBy("p_type")) - 1).withColumn(  # a few types
        "code", F.concat(F.lit("WQ-"), F.lpad((F.col("k") + 1).cast("string"), 3, "0")))


@query("""WITH types AS (SELECT row_number() OVER (ORDER BY p_type) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM part)),
files AS (SELECT c_nationkey AS nation, count(*) AS data_rows FROM customer GROUP BY 1)
SELECT CAST(nation AS BIGINT) AS nation, CAST(data_rows AS BIGINT) AS data_rows, CAST(2 AS BIGINT) AS auto_mapped, CAST(1 AS BIGINT) AS unmapped,
  'WQ-' || lpad(CAST(nth AS VARCHAR), 3, '0') AS code, CAST((SELECT sum(data_rows + 1) FROM files) AS BIGINT) AS mapped_lines,
  CAST((SELECT count(*) FROM files) AS BIGINT) AS reports, CAST((SELECT count(*) FROM files) AS BIGINT) AS queued
FROM files JOIN types ON nth - 1 = nation % n""")
def folder_mapping(spark, folder):
    """A file per nation with a key, a known and an unknown column, mapped through dictionary files; all outputs read back."""
    root, types = _folder(spark), _numbered_types(spark, folder)
    blank = lambda *columns: [F.lit("").alias(c) for c in columns]
    head = ("name_en", "abbr", "synonyms", "unit", "category", "verified", "note")
    sinks.write_csv(types.select("code", F.col("p_type").alias("name_ko"), *blank(*head)).coalesce(1), f"{root}/dict/{C.DICT_FILES['measurement']}")
    sinks.write_csv(spark.createDataFrame([("MD-001", "custkey")], "code string, name_ko string").select(
        "code", "name_ko", *blank(*head)).coalesce(1), f"{root}/dict/{C.DICT_FILES['metadata']}")
    customers = S.table(spark, folder, "customer").withColumn("nation", F.col("c_nationkey").cast("long"))
    body = customers.select("nation", F.lit(1).alias("place"), F.concat_ws(
        ",", F.col("c_custkey").cast("string"), S.money("c_acctbal"), "c_mktsegment").alias("line"))
    count = types.count()
    heads = body.select("nation").distinct().join(types, F.col("nation") % count == F.col("k")).select("nation", F.lit(0).alias("place"), F.concat(
        F.lit("custkey,"), "p_type", F.lit(",zz"), F.col("nation").cast("string"), F.lit("qq")).alias("line"))
    # The separator and quote marks never occur, so lines are written as they are.
    (body.unionByName(heads).repartition("nation").sortWithinPartitions("nation", "place").select("nation", "line").write
     .options(sep="\x01", quote="\x02", escape="\x02").partitionBy("nation").csv(f"{root}/data"))
    job = mapping.run(spark, f"{root}/data", f"{root}/dict", f"{root}/out")
    nation = F.regexp_extract("file_id", r"nation=(\d+)", 1).cast("long").alias("nation")
    columns = job.columns.groupBy(nation).agg(
        F.count_if(F.col("status").isin(*C.AUTO_STATUSES)).alias("auto_mapped"), F.count_if(F.col("status") == "unmapped").alias("unmapped"),
        F.max(F.when(F.col("code").startswith("WQ-"), F.col("code"))).alias("code"))
    rows = job.data.groupBy(nation).agg(F.count("*").alias("data_rows"))
    lines = spark.read.option("recursiveFileLookup", True).text(f"{root}/out/mapped").count()
    reports = spark.read.text(f"{root}/out/report").count()
    queued = spark.read.option("header", True).csv(f"{root}/out/review_queue").count()
    return rows.join(columns, "nation").withColumns({name: F.lit(n).cast("long") for name, n in (
        ("mapped_lines", lines), ("reports", reports), ("queued", queued))})


@query(f"""SELECT CAST(p_partkey AS BIGINT) AS column_index, CAST(p_size % 5 AS BIGINT) AS organization_id, p_name AS raw,
  CASE WHEN o.code IS NOT NULL THEN 'organization_exact' ELSE m.status END AS status, coalesce(o.code, m.code) AS code,
  CASE WHEN o.code IS NOT NULL THEN 'organization_dictionary' ELSE 'global_dictionary' END AS source
FROM part JOIN ({names.query.oracles["map_fuzzy"]}) m ON m.raw = p_name LEFT JOIN (
  SELECT p_size % 5 AS org, regexp_replace(lower(p_name), '[\\s_\\-./()\\[\\]{{}}]+', '', 'g') AS alias,
    'MD-' || lpad(CAST(max(p_size) AS VARCHAR), 3, '0') AS code FROM part WHERE p_name LIKE 'old %' AND p_size % 5 = 1 GROUP BY 1, 2) o
  ON o.org = p_size % 5 AND o.alias = regexp_replace(lower(p_name), '[\\s_\\-./()\\[\\]{{}}]+', '', 'g')""")
def organisation_mapping(spark, folder):
    """Names of organisations mapped, one organisation's own aliases before the shared dictionary."""
    part = S.table(spark, folder, "part").withColumn("organization_id", (F.col("p_size") % 5).cast("long"))
    own = part.where(F.col("p_name").startswith("old ") & (F.col("organization_id") == 1)).groupBy(
        "organization_id", alias_key(F.col("p_name")).alias("alias_normalized")).agg(
        F.concat(F.lit("MD-"), F.lpad(F.max("p_size").cast("string"), 3, "0")).alias("standard_code"))
    columns = part.select("organization_id", F.col("p_partkey").cast("long").alias("column_index"), F.col("p_name").alias("raw"))
    return mapping.map_for_organisation(columns, names._lexicon(spark, folder), own).select(
        "column_index", "organization_id", "raw", "status", "code", "source")


@query("""SELECT substr(sha256(a || b), 1, 16) AS hash, FALSE AS stale, TRUE AS stale_after_change FROM (
  SELECT string_agg(p_partkey || ',' || p_name || chr(10), '' ORDER BY p_partkey) AS a FROM part), (
  SELECT string_agg(s_suppkey || ',' || s_name || chr(10), '' ORDER BY s_suppkey) AS b FROM supplier)""")
def dictionary_staleness(spark, folder):
    """The hash of two dictionary files, against itself and against that of a changed pair."""
    root = _folder(spark)
    paths = []
    for name, key, text in (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name")):
        paths.append(f"{root}/{name}")
        S.table(spark, folder, name).orderBy(key).select(F.concat_ws(",", F.col(key).cast("string"), text)).coalesce(1).write.text(paths[-1])
    now = dictionaries.dictionary_hash(spark, *paths)
    return spark.createDataFrame([(now, dictionaries.is_stale(spark, now, *paths), dictionaries.is_stale(spark, now, *reversed(paths)))],
                                 "hash string, stale boolean, stale_after_change boolean")
