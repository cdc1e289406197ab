"""Queries over the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.catalog import standins as S
from hydromelt.catalog.registry import Topic
from hydromelt.functions import values
from hydromelt.operators import review
from hydromelt.plans import mapping as mapping_plan

query = Topic()


@query(S.with_tables("cols", """SELECT raw AS "원본명", filename AS "출처파일",
  CASE status WHEN 'needs_review' THEN candidate_code ELSE '' END AS "후보 표준코드",
  CASE status WHEN 'needs_review' THEN CAST(score AS VARCHAR) ELSE '' END AS "점수", '' AS "사람판정", '' AS "판정자"
  FROM cols WHERE status IN ('needs_review', 'unmapped')"""))
def review_queue(spark, folder):
    return review.review_queue(S.mapped_columns(spark, folder))


@query(S.with_tables("items", "SELECT id, file_id, raw, mapping_status, candidate_code FROM items WHERE verdict IS NULL"))
def review_pending(spark, folder):
    return review.listing(S.review_items(spark, folder)).select("id", "file_id", "raw", "mapping_status", "candidate_code")


_CANON = """CASE WHEN lower(trim(verdict)) IN ('승인', 'approved') THEN candidate_code
  WHEN lower(trim(verdict)) IN ('no_match', '기각', 'rejected', 'none', 'unmapped') THEN 'no_match' ELSE trim(verdict) END"""


@query(S.with_tables("items", f"""SELECT id, {_CANON} AS canonical, CASE WHEN verdict IN ('no_match', '기각') THEN NULL
  WHEN verdict = '승인' THEN candidate_code ELSE verdict END AS adopted FROM items WHERE verdict IS NOT NULL"""))
def verdict_canon(spark, folder):
    verdict, candidate = F.col("verdict"), F.col("candidate_code")
    return S.review_items(spark, folder).where(verdict.isNotNull()).select(
        "id", values.canonical_verdict(verdict, candidate).alias("canonical"),
        values.adopted_code(verdict, candidate).alias("adopted"))


@query(S.with_tables("items", """SELECT id, file_id, raw, verdict FROM items QUALIFY row_number() OVER (
  PARTITION BY file_id, raw, column_index ORDER BY verdict IS NOT NULL DESC, id DESC) = 1"""))
def dedupe_decided_first(spark, folder):
    return review.decided_first(S.review_items(spark, folder)).select("id", "file_id", "raw", "verdict")


def _new_columns(spark, folder):
    """Columns of a new mapping round: one per document source, position and language, all undecided."""
    docs = S.table(spark, folder, "documents")
    both = docs.select("source", "lang").distinct().select("source", "lang", F.explode(F.array(
        F.length("source"), F.length("source") + 1)).alias("column_index"))
    return both.select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("file_id"), "column_index",
        F.col("lang").alias("raw"), F.when(F.col("lang") == "de", "unmapped").otherwise("needs_review").alias("status"),
        F.lit("body").alias("via"), F.lit(None).cast("string").alias("code"), F.lit("WQ-008").alias("candidate_code"),
        F.when(F.col("lang") == "es", "site").alias("site"), F.lit("v").alias("matched_variant"),
        F.lit(70.0).alias("score"), F.lit(C.DICT_MEASUREMENT).alias("dict_type"), F.col("lang").alias("output_column"))


_NEW_SQL = """SELECT CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS file_id, CAST(length(source) + o AS INTEGER) AS column_index,
  lang AS raw, CASE WHEN lang = 'de' THEN 'unmapped' ELSE 'needs_review' END AS status, CASE WHEN lang = 'es' THEN 'site' END AS site
  FROM (SELECT DISTINCT source, lang FROM documents), (SELECT unnest([0, 1]) AS o)"""
_LATEST_SQL = f"""SELECT file_id, column_index, raw, true AS had_review, CASE WHEN verdict IN ('no_match', '기각') THEN NULL
  WHEN verdict = '승인' THEN candidate_code ELSE verdict END AS adopted FROM items
  QUALIFY row_number() OVER (PARTITION BY file_id, column_index, raw ORDER BY created_at DESC, id DESC) = 1"""
_CARRIED_SQL = """SELECT n.file_id, n.column_index, n.raw, CASE WHEN adopted IS NOT NULL THEN 'exact' ELSE status END AS status,
  CASE WHEN adopted IS NOT NULL THEN 'review' ELSE 'body' END AS via, adopted AS code,
  CASE WHEN adopted IS NULL THEN 'WQ-008' END AS candidate_code, CASE WHEN adopted IS NULL THEN 70.0 END AS score,
  CASE WHEN adopted IS NULL THEN 'v' WHEN adopted IN ('WQ-001', 'WQ-002') THEN 'name ' || adopted END AS matched_variant,
  CASE WHEN adopted LIKE 'MD-%' THEN '메타' ELSE '측정항목' END AS dict_type,
  CASE WHEN adopted IS NULL THEN n.raw ELSE adopted || CASE WHEN site IS NOT NULL THEN '@' || site ELSE '' END END AS output_column,
  coalesce(had_review, false) AS had_review FROM fresh n LEFT JOIN earlier USING (file_id, column_index, raw)"""


def _known_terms(spark, folder):
    """Terms the dictionary knows: two of the candidate codes."""
    return S.table(spark, folder, "region").where("r_regionkey in (1, 2)").select(
        F.concat(F.lit("WQ-00"), F.col("r_regionkey").cast("string")).alias("code")).select(
        "code", F.concat(F.lit("name "), "code").alias("name"), F.lit(C.DICT_MEASUREMENT).alias("dict_type"))


def _carried(spark, folder):
    return review.carry_over(_new_columns(spark, folder), S.review_items(spark, folder), _known_terms(spark, folder))


@query(S.with_tables("items", """SELECT file_id, column_index, raw, status, via, code, candidate_code, CAST(score AS DOUBLE) AS score,
  matched_variant, dict_type, output_column, had_review FROM carried""", fresh=_NEW_SQL, earlier=_LATEST_SQL, carried=_CARRIED_SQL))
def review_carryover(spark, folder):
    return _carried(spark, folder).select("file_id", "column_index", "raw", "status", "via", "code", "candidate_code", "score",
                                          "matched_variant", "dict_type", "output_column", "had_review")


@query(S.with_tables("items", "SELECT file_id, column_index, raw FROM carried WHERE status <> 'exact' AND NOT had_review",
                     fresh=_NEW_SQL, earlier=_LATEST_SQL, carried=_CARRIED_SQL))
def review_new_items(spark, folder):
    return review.new_items(_carried(spark, folder)).select("file_id", "column_index", "raw")


@query(S.with_tables("items runs", """SELECT c.file_id, r.round_no, total_columns, auto_mapped, needs_review, unmapped,
  CASE WHEN coalesce(o.n, 0) + coalesce(w.n, 0) > 0 THEN 'reviewing' ELSE 'completed' END AS status FROM (
    SELECT file_id, CAST(count(*) AS BIGINT) AS total_columns, CAST(count(*) FILTER (status = 'exact') AS BIGINT) AS auto_mapped,
    CAST(count(*) FILTER (status = 'needs_review') AS BIGINT) AS needs_review, CAST(count(*) FILTER (status = 'unmapped') AS BIGINT) AS unmapped
    FROM carried GROUP BY 1) c JOIN (SELECT s_suppkey AS file_id, CAST(coalesce(max(round_no), 0) + 1 AS INTEGER) AS round_no
    FROM supplier LEFT JOIN runs ON runs.file_id = s_suppkey GROUP BY 1) r USING (file_id)
  LEFT JOIN (SELECT file_id, count(*) AS n FROM items WHERE verdict IS NULL GROUP BY 1) o USING (file_id)
  LEFT JOIN (SELECT file_id, count(*) AS n FROM carried WHERE status <> 'exact' AND NOT had_review GROUP BY 1) w USING (file_id)""",
                     fresh=_NEW_SQL, earlier=_LATEST_SQL, carried=_CARRIED_SQL))
def mapping_round(spark, folder):
    """A new round over every file: verdicts carried over, counts, resulting file status."""
    done = mapping_plan.mapping_round(_new_columns(spark, folder), S.review_items(spark, folder), _known_terms(spark, folder),
                                      S.runs(spark, folder), S.files(spark, folder))
    return done["runs"].join(done["status"], "file_id").select(
        "file_id", "round_no", "total_columns", "auto_mapped", "needs_review", "unmapped", "status")


@query(S.with_tables("items", f"""SELECT id, CASE WHEN problem IS NULL AND asked IS NOT NULL THEN canon ELSE verdict END AS verdict,
  CASE WHEN problem IS NULL AND asked IS NOT NULL THEN coalesce(nullif(trim(who), ''), '미상') ELSE reviewed_by END AS reviewed_by,
  problem AS rejected_because FROM (SELECT *, CASE WHEN asked IS NULL THEN NULL WHEN asked = 'approved' AND candidate_code IS NULL
    THEN 'candidate missing' WHEN canon NOT IN ('no_match', 'WQ-001', 'WQ-002') THEN 'code unknown' END AS problem FROM (
  SELECT *, CASE asked WHEN 'approved' THEN candidate_code WHEN 'None' THEN 'no_match' ELSE asked END AS canon FROM (
    SELECT items.*, asked, who FROM items LEFT JOIN (SELECT doc_id, CASE lang WHEN 'en' THEN 'approved' WHEN 'fr' THEN 'None'
      WHEN 'es' THEN 'WQ-002' ELSE 'approved' END AS asked, CASE WHEN lang = 'fr' THEN ' ' ELSE source END AS who FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM labels)) ON doc_id = id)))"""))
def verdict_apply(spark, folder):
    """A batch of verdicts for all open items."""
    items = S.review_items(spark, folder).withColumn("reviewed_at", F.col("reviewed_at").cast("bigint"))
    docs = S.table(spark, folder, "documents").join(S.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")
    lang = F.col("lang")
    verdicts = docs.select(
        F.col("doc_id").alias("id"), F.when(lang == "fr", "None").when(lang == "es", " WQ-002 ").otherwise("approved").alias("verdict"),
        F.lit("note").alias("note"), F.when(lang == "fr", " ").otherwise(F.col("source")).alias("reviewer"),
        F.col("n_chars").alias("decided_at"))
    return review.apply_verdicts(items, verdicts, _known_terms(spark, folder)).select(
        "id", "verdict", "reviewed_by", "rejected_because")


_EXPORT_SQL = "verdict IS NOT NULL AND verdict NOT IN ('기각', 'no_match') AND exported_at IS NULL AND reviewed_at >= 500"


@query(S.with_tables("items files", f"""SELECT id, raw, candidate_code, verdict, reviewed_at, original_filename FROM items
  JOIN files USING (file_id) WHERE {_EXPORT_SQL}"""))
def unexported(spark, folder):
    return review.export_candidates(S.review_items(spark, folder), S.files(spark, folder), F.lit(500)).select(
        "id", "raw", "candidate_code", "verdict", "reviewed_at", "original_filename")


@query(S.with_tables("items files", f"""SELECT id, CASE WHEN file_id IN (SELECT file_id FROM files) AND {_EXPORT_SQL} THEN 9
  ELSE exported_at END AS exported_at FROM items"""))
def mark_exported(spark, folder):
    items = S.review_items(spark, folder)
    chosen = review.export_candidates(items, S.files(spark, folder), F.lit(500))
    return review.mark_exported(items, chosen, F.lit(9).cast("bigint")).select("id", "exported_at")


@query(S.with_tables("files runs items", """SELECT file_id, CASE WHEN status = 'reviewing' AND file_id IN (SELECT file_id FROM runs)
  AND file_id NOT IN (SELECT file_id FROM items WHERE verdict IS NULL) THEN 'completed' ELSE status END AS status FROM files"""))
def status_repair(spark, folder):
    return review.repaired_status(S.files(spark, folder), S.runs(spark, folder), S.review_items(spark, folder)).select(
        "file_id", "status")


@query(S.with_tables("cols", """SELECT q.filename AS "출처파일", q.raw AS "원본명", q.n AS lines, row_count, distinct_count,
  sample || CASE WHEN distinct_count > 12 THEN ' …' ELSE '' END AS values FROM (SELECT filename, raw, CAST(count(*) AS BIGINT) AS n FROM cols
  WHERE status IN ('needs_review', 'unmapped') GROUP BY 1, 2) q LEFT JOIN (SELECT filename, raw, CAST(sum(n) AS BIGINT) AS row_count,
  CAST(count(*) AS BIGINT) AS distinct_count, string_agg(text, ', ' ORDER BY nth) FILTER (nth <= 12) AS sample FROM (SELECT *,
    row_number() OVER (PARTITION BY filename, raw ORDER BY first_at, text) AS nth FROM counted) GROUP BY 1, 2) s
  ON s.filename = q.filename AND s.raw = q.raw""",
                     counted="""SELECT p_brand AS filename, p_name AS raw, CAST(p_size AS VARCHAR) AS text, count(*) AS n,
  min(p_partkey) AS first_at FROM part GROUP BY 1, 2, 3"""))
def review_sheet(spark, folder):
    """Queue lines beside a summary of what their column holds."""
    from hydromelt.operators import melt as melting
    cells = S.table(spark, folder, "part").select(
        F.col("p_brand").alias("filename"), F.col("p_name").alias("raw"), F.col("p_partkey").alias("source_row"),
        F.col("p_size").cast("string").alias("value"))
    queue = review.review_queue(S.mapped_columns(spark, folder)).groupBy("출처파일", "원본명").agg(F.count("*").alias("lines"))
    return review.review_sheet(queue, melting.value_summaries(cells, ["filename", "raw"], samples=12)).select(
        "출처파일", "원본명", "lines", "row_count", "distinct_count", "values")


@query("""SELECT code, synonym FROM (SELECT *, row_number() OVER (PARTITION BY code, lower(replace(synonym, ' ', '')) ORDER BY row_no) AS nth FROM (
  SELECT c_custkey AS row_no, c_mktsegment || ' ' || c_nationkey AS synonym, CASE WHEN c_acctbal < 0 THEN NULL
    WHEN c_acctbal < 3000 THEN 'WQ-00' || n_regionkey ELSE 'MD-900' END AS code
    FROM customer JOIN nation ON n_nationkey = c_nationkey)
  WHERE code IN (SELECT 'WQ-00' || r_regionkey FROM region) AND lower(replace(synonym, ' ', '')) NOT LIKE 'building%')  WHERE nth = 1""")
def accepted_spellings(spark, folder):
    """Spellings a filled queue adds to the dictionary, each key once per code."""
    customer = S.table(spark, folder, "customer").join(
        S.table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    kind = F.col("n_regionkey").cast("string")
    queue = customer.select(
        F.col("c_custkey").alias("row_no"), F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("원본명"),
        F.lit("f.csv").alias("출처파일"), F.concat(F.lit("WQ-00"), kind).alias("후보 표준코드"),
        F.when(F.col("c_acctbal") < 0, "기각").when(F.col("c_acctbal") < 3000, "OK").otherwise("MD-900").alias("사람판정"),
        F.lit("p").alias("판정자"))
    known = S.table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("building-"), F.col("c_nationkey").cast("string")).alias("text")).distinct().agg(
        F.array_join(F.array_sort(F.collect_list("text")), "|").alias("synonyms"))
    terms = S.table(spark, folder, "region").select(
        F.concat(F.lit("WQ-00"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("name_ko"),
        F.lit("").alias("name_en"), F.lit("").alias("abbr"), F.lit("measurement_terms.csv").alias("dict_file"),
        F.lit(1).alias("_one")).join(known.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return review.accepted_spellings(queue, terms).select("code", "synonym")
