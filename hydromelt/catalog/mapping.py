"""Queries over names, columns, rounds and files."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt import session
from hydromelt.catalog import standins as S
from hydromelt.catalog.registry import Topic
from hydromelt.functions import names, values
from hydromelt.operators import headers, lexicon, matching, paging, quality, summaries, tables
from hydromelt.plans import ingest
from hydromelt.sources import sinks, snapshots

query = Topic()


# --- name cascade ----------------------------------------------------------------

def _names(spark, folder):
    """Column names built from parts: plain, behind a site, and in brackets."""
    part = S.table(spark, folder, "part")
    raw = F.explode(F.array(
        F.col("p_name"), F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit("_"), "p_name"),
        F.concat("p_brand", F.lit(" ("), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit(")"))))
    return part.select(raw.alias("raw")).distinct()


_NAMES_SQL = """SELECT DISTINCT unnest([p_name, p_brand || '-' || p_size || '_' || p_name,
  p_brand || ' (' || replace(p_name, ' ', '-') || ')']) AS raw FROM part"""


def _lexicon(spark, folder):
    """Part names as spellings; two families of names stay unknown to it."""
    part = S.table(spark, folder, "part").where(~F.col("p_name").startswith("old ") & ~F.col("p_name").startswith("hot "))
    spelled = part.groupBy(F.col("p_name").alias("variant")).agg(F.min("p_size").alias("size")).withColumn(
        "code", F.concat(F.lit("WQ-"), F.lpad(F.col("size").cast("string"), 3, "0")))
    forms = spelled.withColumn("variant_norm", names.normalize_name("variant")["body"])
    return lexicon.unique_entries(forms.select(
        F.col("variant").alias("seq"), F.lit(C.DICT_MEASUREMENT).alias("dict_type"), "code",
        F.lit("name_ko").alias("field"), "variant", "variant_norm"))


_LEXICON_SQL = f"""SELECT * FROM (SELECT p_name AS variant, {S.squared_body('p_name')} AS variant_norm,
  'WQ-' || lpad(CAST(min(p_size) AS VARCHAR), 3, '0') AS code FROM part
  WHERE p_name NOT LIKE 'old %' AND p_name NOT LIKE 'hot %' GROUP BY 1)
  QUALIFY row_number() OVER (PARTITION BY variant_norm ORDER BY variant) = 1"""
_TOKENS_SQL = r"""SELECT raw, t AS token FROM (SELECT raw, regexp_replace(unnest(regexp_extract_all(lower(raw),
  '\(([^()]*)\)', 1)), '[\s\-_.]+', '', 'g') AS t FROM names)"""
_EXACT_SQL = """SELECT raw, CASE WHEN b.code IS NOT NULL THEN 'body' WHEN t.code IS NOT NULL THEN 'paren' END AS via,
  coalesce(b.code, t.code) AS code, coalesce(b.variant, t.variant) AS variant
  FROM (SELECT raw, """ + S.squared_body("raw") + """ AS body FROM names)
  LEFT JOIN lex b ON b.variant_norm = body
  LEFT JOIN (SELECT raw AS token_raw, code, variant FROM tokens JOIN lex ON variant_norm = token) t ON token_raw = raw"""


@query(S.with_tables("", "SELECT raw, via, code, variant FROM exact", names=_NAMES_SQL, lex=_LEXICON_SQL,
                     tokens=_TOKENS_SQL, exact=_EXACT_SQL))
def map_exact(spark, folder):
    parsed = matching.parse_names(_names(spark, folder))
    return matching.exact_lookup(parsed, _lexicon(spark, folder)).select("raw", "hit.via", "hit.code", "hit.variant")


_TAILS_SQL = f"""SELECT raw, cut, body, regexp_replace(substr(raw, 1, cut), '{C.SEPARATORS}', '', 'g') AS site,
  min(cut) FILTER (length(body) < 2) OVER (PARTITION BY raw) AS stop FROM (
  SELECT raw, cut, {S.squared_body('substr(raw, cut + 1)')} AS body FROM (
    SELECT raw, CAST(unnest(generate_series(1, length(raw) - 1)) AS INTEGER) AS cut FROM names))"""
_HITS_SQL = """SELECT raw, coalesce(via, CASE WHEN c.code IS NOT NULL THEN 'composite' END) AS via,
  coalesce(e.code, c.code) AS code, coalesce(e.variant, c.variant) AS variant, CASE WHEN via IS NULL THEN site END AS site
  FROM exact e LEFT JOIN (SELECT raw AS tail_raw, code, variant, site FROM tails
    JOIN lex ON variant_norm = body WHERE (stop IS NULL OR cut < stop) AND site <> ''
    QUALIFY row_number() OVER (PARTITION BY raw ORDER BY cut) = 1) c ON tail_raw = raw"""
_CASCADE = dict(names=_NAMES_SQL, lex=_LEXICON_SQL, tokens=_TOKENS_SQL, exact=_EXACT_SQL, tails=_TAILS_SQL, hits=_HITS_SQL)


@query(S.with_tables("", "SELECT raw, via, code, site FROM hits", **_CASCADE))
def map_composite(spark, folder):
    """Exact, bracketed and site-prefixed tiers together; undecided names stay null."""
    hits = matching.first_hits(matching.lookup_keys(matching.parse_names(_names(spark, folder))), _lexicon(spark, folder))
    return hits.select("raw", "hit.via", "hit.code", "hit.site")


@query(S.with_tables("", """SELECT raw, CASE WHEN h.code IS NOT NULL THEN 'exact' WHEN score >= 85 THEN 'fuzzy_auto'
    WHEN score >= 70 THEN 'needs_review' ELSE 'unmapped' END AS status,
  CASE WHEN h.code IS NOT NULL THEN h.via WHEN score >= 70 THEN n.via END AS via,
  CASE WHEN h.code IS NOT NULL THEN h.code WHEN score >= 85 THEN n.code END AS code,
  CASE WHEN h.code IS NULL AND score >= 70 AND score < 85 THEN n.code END AS candidate_code, site,
  CASE WHEN h.code IS NOT NULL THEN h.variant WHEN score >= 70 THEN n.variant END AS matched_variant,
  CASE WHEN h.code IS NULL THEN score END AS score FROM hits h LEFT JOIN near n USING (raw)""", **_CASCADE,
                     asked=f"""SELECT raw, 0 AS place, {S.squared_body('raw')} AS q FROM hits WHERE code IS NULL
  UNION ALL SELECT hits.raw, 1, token FROM hits JOIN tokens USING (raw) WHERE hits.code IS NULL""",
                     pairs=f"""SELECT q, variant_norm, {S.ratio_sql('q', 'variant_norm')} AS ratio FROM (SELECT DISTINCT q FROM asked WHERE q <> ''), lex""",
                     near="""SELECT raw, CASE place WHEN 0 THEN 'body' ELSE 'paren' END AS via, code, variant, round_even(ratio, 1) AS score
  FROM asked JOIN pairs USING (q) JOIN lex USING (variant_norm)
  QUALIFY row_number() OVER (PARTITION BY raw ORDER BY ratio DESC, place, variant) = 1"""))
def map_fuzzy(spark, folder):
    """The whole cascade with the similarity tier."""
    return matching.map_names(_names(spark, folder), _lexicon(spark, folder)).select(
        "raw", "status", "via", "code", "candidate_code", "site", "matched_variant", "score")


# --- trigram tier ------------------------------------------------------------------

def _grams_sql(key: str) -> str:
    return (f"list_distinct(list_transform(generate_series(1, length({key}) + 1), "
            f"lambda i: substr('  ' || {key} || ' ', CAST(i AS INTEGER), 3)))")


_SIMILARITY = "len(list_intersect(a.grams, b.grams)) / CAST(len(list_distinct(a.grams || b.grams)) AS DOUBLE)"


_KEYED_GRAMS = {
    "l": f"SELECT key, {_grams_sql('key')} AS grams FROM (SELECT DISTINCT lower(replace(p_name || p_type, ' ', '')) AS key FROM part)",
    "r": f"SELECT key, {_grams_sql('key')} AS grams FROM (SELECT DISTINCT lower(replace(replace(p_name || p_brand, ' ', ''), '#', '')) AS key FROM part)"}
_PAIRS_SQL = f"SELECT a.key AS left_key, b.key AS right_key, round({_SIMILARITY}, 9) AS similarity FROM l a, r b WHERE {_SIMILARITY} >= 0.45"


def _spellings(spark, folder):
    part = S.table(spark, folder, "part")
    return (part.select(names.wq_normalize(F.concat("p_name", "p_type")).alias("key")),
            part.select(names.wq_normalize(F.concat("p_name", "p_brand")).alias("key")))


@query(S.with_tables("", _PAIRS_SQL, **_KEYED_GRAMS))
def trigram_pairs(spark, folder):
    """All pairs of spellings whose trigram similarity reaches the threshold."""
    return matching.trigram_pairs(*_spellings(spark, folder)).withColumn("similarity", F.round("similarity", 9))


@query(S.with_tables("", f"""SELECT left_key, right_key, similarity, CAST(row_number() OVER (
  PARTITION BY left_key ORDER BY similarity DESC, right_key) AS BIGINT) AS place FROM ({_PAIRS_SQL}) QUALIFY place <= 5""", **_KEYED_GRAMS))
def trigram_topk(spark, folder):
    """The five most similar spellings of each."""
    return matching.nearest_by_trigram(*_spellings(spark, folder), limit=5).withColumns({
        "similarity": F.round("similarity", 9), "place": F.col("place").cast("bigint")})


_TERMS_UNION = """SELECT code, std_name, 'measurement' AS term_kind FROM mterms
  UNION ALL SELECT code, std_name, 'metadata' FROM dterms"""
_WQ = "lower(regexp_replace({}, '[^0-9A-Za-z가-힣]', '', 'g'))"


@query(S.with_tables("syn mterms dterms", f"""SELECT surface, CAST(rank AS INTEGER) AS rank, code, term_kind, std_name, match_type, score, via_surface, via_source
  FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY score DESC, code) AS rank FROM best) WHERE rank <= 5""",
                     terms=_TERMS_UNION,
                     asked=f"SELECT DISTINCT p_name || ' ' || p_brand AS surface, {_WQ.format('p_name || p_brand')} AS key FROM part",
                     live=f"""SELECT code, surface AS via_surface, source_id AS via_source, {_WQ.format('surface')} AS key
  FROM syn WHERE review_status <> 'rejected'""",
                     a=f"SELECT key, {_grams_sql('key')} AS grams FROM (SELECT DISTINCT key FROM asked)",
                     b=f"SELECT key, {_grams_sql('key')} AS grams FROM (SELECT DISTINCT key FROM live)",
                     tiers=f"""SELECT asked.key, code, 1 AS tier, 1.0 AS score, std_name AS via_surface, CAST(NULL AS VARCHAR) AS via_source
  FROM asked JOIN terms ON {_WQ.format('std_name')} = key
  UNION ALL SELECT asked.key, code, 2, 0.95, via_surface, via_source FROM asked JOIN live USING (key)
  UNION ALL SELECT a.key, code, 3, round({_SIMILARITY}, 3), via_surface, via_source
  FROM a JOIN b ON {_SIMILARITY} >= 0.45 JOIN live ON live.key = b.key""",
                     best="""SELECT surface, t.code, term_kind, std_name,
  CASE tier WHEN 1 THEN 'exact_standard' WHEN 2 THEN 'exact_synonym' ELSE 'fuzzy' END AS match_type,
  CAST(score AS DOUBLE) AS score, via_surface, via_source FROM (SELECT DISTINCT * FROM tiers
  QUALIFY row_number() OVER (PARTITION BY key, code ORDER BY tier, score DESC, via_surface, via_source NULLS FIRST) = 1) t
  JOIN asked USING (key) LEFT JOIN terms ON terms.code = t.code"""))
def match_cascade(spark, folder):
    """Candidate codes per surface from the dictionary tables, five at most."""
    asked = S.table(spark, folder, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("surface"))
    every = S.terms(spark, folder, "measurement").select("code", "std_name", F.lit("measurement").alias("term_kind")).unionByName(
        S.terms(spark, folder, "metadata").select("code", "std_name", F.lit("metadata").alias("term_kind")))
    live = S.synonyms(spark, folder).where(F.col("review_status") != "rejected").withColumn("code", lexicon.code_of())
    return matching.match_cascade(asked, every, live).withColumns(S.dbl("score"))


# --- overrides -----------------------------------------------------------------------

@query(r"""SELECT c_custkey AS column_index, c_nationkey AS organization_id, raw, CASE WHEN hit THEN 'organization_exact' ELSE 'unmapped' END AS status,
  CASE WHEN hit THEN code END AS code, CASE WHEN hit THEN 'organization_dictionary' ELSE 'global_dictionary' END AS source
  FROM (SELECT c_custkey, c_nationkey, raw, o.code, o.code IS NOT NULL AS hit FROM (
    SELECT *, c_mktsegment || ' (' || c_nationkey || ')' AS raw FROM customer)
    LEFT JOIN (SELECT s_nationkey, 'MD-' || lpad(CAST(max(s_suppkey) AS VARCHAR), 3, '0') AS code FROM supplier GROUP BY 1) o
    ON o.s_nationkey = c_nationkey AND c_mktsegment = 'BUILDING')""")
def org_override(spark, folder):
    """An organisation's own alias against the shared result."""
    customer = S.table(spark, folder, "customer")
    cols = customer.select(
        F.col("c_nationkey").alias("organization_id"), F.col("c_custkey").alias("column_index"),
        F.concat("c_mktsegment", F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(")")).alias("raw"),
        F.lit("unmapped").alias("status"), F.lit(None).cast("string").alias("code"),
        F.lit(None).cast("string").alias("dict_type"), F.lit("").alias("output_column"))
    own = S.table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("organization_id")).agg(
        F.concat(F.lit("MD-"), F.lpad(F.max("s_suppkey").cast("string"), 3, "0")).alias("standard_code")).withColumn(
        "alias_normalized", F.concat(F.lit("building"), F.col("organization_id").cast("string")))
    return matching.organisation_override(cols, own).select(
        "column_index", "organization_id", "raw", "status", "code", "source")


_OVERRIDE_CODE = "CASE WHEN p_type = 'MEDIUM' THEN 'WQ-099' WHEN p_type = 'PROMO' THEN ' ' END"


@query(S.with_tables("cols", f"""SELECT c.file_id, c.column_index, CASE WHEN fix THEN 'WQ-099' ELSE c.code END AS code,
  CASE WHEN fix THEN '측정항목' ELSE c.dict_type END AS dict_type, CASE WHEN fix THEN 'exact' ELSE c.status END AS status,
  CASE WHEN fix THEN 'review' END AS via FROM cols c JOIN (SELECT p_partkey, p_type = 'MEDIUM' AS fix FROM part) ON p_partkey = column_index"""))
def file_override(spark, folder):
    """Reviewed codes replace single columns; blank codes change nothing."""
    cols = S.mapped_columns(spark, folder).withColumn("via", F.lit(None).cast("string"))
    fixes = cols.where(F.col("status").isin("needs_review", "unmapped")).select(
        "file_id", "column_index", F.when(F.col("status") == "needs_review", "WQ-099").otherwise(" ").alias("code"),
        F.lit(C.DICT_MEASUREMENT).alias("dict_type"))
    return matching.apply_overrides(cols, fixes).select("file_id", "column_index", "code", "dict_type", "status", "via")


# --- naming and summaries --------------------------------------------------------------

_OUTPUT = """CASE WHEN status IN ('exact', 'fuzzy_auto') THEN code || CASE WHEN coalesce(site, '') <> '' THEN '@' || site ELSE '' END
  WHEN status = 'unmapped' THEN 'UNMAPPED_' || raw ELSE raw END"""


def _output():
    return values.output_column(F.col("status"), F.col("code"), F.col("site"), F.col("raw"))


@query(S.with_tables("cols", f"SELECT file_id, column_index, {_OUTPUT} AS output_column FROM cols"))
def output_names(spark, folder):
    return S.mapped_columns(spark, folder).select("file_id", "column_index", _output().alias("output_column"))


@query(S.with_tables("cols", f"""SELECT file_id, column_index, output_column || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END
  AS unique_column FROM (SELECT *, row_number() OVER (PARTITION BY file_id, output_column ORDER BY column_index) AS nth FROM (
  SELECT file_id, column_index, {_OUTPUT} AS output_column FROM cols))"""))
def dedupe_names(spark, folder):
    cols = S.mapped_columns(spark, folder).select("file_id", "column_index", _output().alias("output_column"))
    return headers.unique_output_names(cols).select("file_id", "column_index", "unique_column")


def _rate(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} = 0 THEN 0 ELSE (2000 * {part} + {whole}) // (2 * {whole}) END) / 10.0"


_COUNTS = """CAST(count(*) AS BIGINT) AS total_columns,
  CAST(count(*) FILTER (status IN ('exact', 'fuzzy_auto')) AS BIGINT) AS auto_mapped,
  CAST(count(*) FILTER (status = 'needs_review') AS BIGINT) AS needs_review,
  CAST(count(*) FILTER (status NOT IN ('exact', 'fuzzy_auto', 'needs_review')) AS BIGINT) AS unmapped"""
_RATES = ", ".join(f"CAST({_rate(p, 'total_columns')} AS DOUBLE) AS {p}_rate" for p in ("auto_mapped", "needs_review", "unmapped"))
_RATE_NAMES = ("auto_mapped_rate", "needs_review_rate", "unmapped_rate")


@query(S.with_tables("cols", f"SELECT *, {_RATES} FROM (SELECT file_id, {_COUNTS} FROM cols GROUP BY 1)"))
def mapping_summary(spark, folder):
    return summaries.mapping_summary(S.mapped_columns(spark, folder)).withColumns(S.dbl(*_RATE_NAMES))


@query(S.with_tables("cols", f"""SELECT *, {_RATES} FROM (SELECT file_id, {_COUNTS}, CAST(grouping(file_id) AS INTEGER) AS is_total
  FROM cols GROUP BY ROLLUP (file_id))"""))
def mapping_rollup(spark, folder):
    return summaries.mapping_rollup(S.mapped_columns(spark, folder)).withColumns(S.dbl(*_RATE_NAMES)).withColumn(
        "is_total", F.col("is_total").cast("int"))


@query(S.with_tables("cols", f"""SELECT s.file_id, auto_mapped_rate, expected_rate FROM (SELECT *, {_RATES} FROM (
  SELECT file_id, {_COUNTS} FROM cols GROUP BY 1)) s JOIN (SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS file_id,
  CAST(max(p_size) AS DOUBLE) AS expected_rate FROM part GROUP BY 1) e USING (file_id) WHERE auto_mapped_rate < expected_rate"""))
def rate_regression(spark, folder):
    """Files mapped at a lower rate than expected of them."""
    expected = S.table(spark, folder, "part").groupBy(
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint").alias("file_id")).agg(
        F.max("p_size").cast("double").alias("expected_rate"))
    rates = summaries.mapping_summary(S.mapped_columns(spark, folder)).select(
        "file_id", F.col("auto_mapped_rate").cast("double").alias("auto_mapped_rate"))
    return quality.rate_regressions(rates, expected, "file_id")


@query(S.with_tables("runs", """SELECT a.file_id, a.rate10 / 10.0 AS rate_1, b.rate10 / 10.0 AS rate_2, (b.rate10 - a.rate10) / 10.0 AS growth
  FROM runs a JOIN runs b USING (file_id) WHERE a.round_no = 1 AND b.round_no = 2"""))
def round_compare(spark, folder):
    return summaries.round_growth(S.runs(spark, folder), "file_id").withColumns(S.dbl("rate_1", "rate_2", "growth"))


@query(S.with_tables("runs", """SELECT file_id, round_no, total_columns, dictionary_version, rate10 / 10.0 AS auto_mapped_rate FROM runs
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY round_no DESC) = 1"""))
def latest_round(spark, folder):
    return summaries.latest_round(S.runs(spark, folder)).select(
        "file_id", "round_no", F.col("total_columns").cast("bigint").alias("total_columns"), "dictionary_version",
        F.col("auto_mapped_rate").cast("double").alias("auto_mapped_rate"))


@query(S.with_tables("runs", """SELECT file_id, CAST(count(*) AS BIGINT) AS rounds,
  (arg_max(rate10, round_no) - arg_min(rate10, round_no)) / 10.0 AS delta FROM runs GROUP BY 1"""))
def round_delta(spark, folder):
    return summaries.round_delta(S.runs(spark, folder)).withColumns(S.dbl("delta"))


@query(S.with_tables("runs", """SELECT file_id, round_no, rate10 / 10.0 AS auto_mapped_rate,
  (rate10 - lag(rate10) OVER (PARTITION BY file_id ORDER BY round_no)) / 10.0 AS growth FROM runs"""))
def round_history(spark, folder):
    return summaries.round_history(S.runs(spark, folder)).select("file_id", "round_no", "auto_mapped_rate", "growth").withColumns(
        S.dbl("auto_mapped_rate", "growth"))


@query(S.with_tables("runs files", """SELECT file_id, CAST(coalesce(max(round_no), 0) + 1 AS INTEGER) AS round_no
  FROM files LEFT JOIN runs USING (file_id) GROUP BY 1"""))
def next_round(spark, folder):
    return summaries.next_round(S.runs(spark, folder), S.files(spark, folder))


@query(S.with_tables("m runs files", """SELECT owner_user_id, arg_max(dictionary_version, (ran_at, file_id)) AS dictionary_version,
  strftime(max(ran_at), '%Y-%m-%d %H') AS ran_at
  FROM (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * round_no AS ran_at FROM runs) JOIN files USING (file_id) GROUP BY 1"""))
def latest_version(spark, folder):
    """Dictionary version of the newest ingestion per owner."""
    from hydromelt.operators.analysis import latest_version as newest
    ran_at = F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)) + F.make_interval(hours=F.col("round_no").cast("int"))
    return newest(S.runs(spark, folder).withColumn("ran_at", ran_at), S.files(spark, folder)).withColumn(
        "ran_at", F.date_format("ran_at", "yyyy-MM-dd HH"))


@query(S.with_tables("runs", """SELECT file_id, round_no, dictionary_version FROM runs
  ORDER BY round_no DESC, file_id LIMIT 20 OFFSET 20"""))
def history_page(spark, folder):
    """Second page of the run history, newest rounds first."""
    return paging.PageIndex.build(S.runs(spark, folder).select("file_id", "round_no", "dictionary_version"),
                                  [F.col("round_no").desc(), F.col("file_id")], _place(spark, "pages")).page(number=2, size=20)


# --- files --------------------------------------------------------------------------------

@query(S.with_tables("files", "SELECT file_id, original_filename, size_bytes FROM files WHERE owner_user_id = 7 AND status = 'reviewing'"))
def files_by_status(spark, folder):
    return summaries.files_with_status(S.files(spark, folder), 7, "reviewing").select("file_id", "original_filename", "size_bytes")


@query(S.with_tables("m runs files items", """SELECT f.file_id, f.status, CAST(r.total_columns AS BIGINT) AS column_count, r.dictionary_version,
  r.rate10 / 10.0 AS auto_mapped_rate, coalesce(p.n, 0) AS pending_reviews, measured_from, measured_to,
  CASE WHEN r.total_columns IS NULL THEN f.status WHEN coalesce(p.n, 0) > 0 THEN 'reviewing' ELSE 'completed' END AS review_state
  FROM files f LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY round_no DESC) = 1) r USING (file_id)
  LEFT JOIN (SELECT file_id, CAST(count(*) AS BIGINT) AS n FROM items WHERE verdict IS NULL GROUP BY 1) p USING (file_id)
  LEFT JOIN (SELECT file_id, min(measured_on) AS measured_from, max(measured_on) AS measured_to FROM m GROUP BY 1) d USING (file_id)"""))
def file_overview(spark, folder):
    shown = summaries.file_overview(S.files(spark, folder), S.runs(spark, folder), S.review_items(spark, folder),
                                    S.measurements(spark, folder))
    return shown.select("file_id", "status", F.col("column_count").cast("bigint").alias("column_count"),
                        "dictionary_version", F.col("auto_mapped_rate").cast("double").alias("auto_mapped_rate"),
                        "pending_reviews", "measured_from", "measured_to", "review_state")


@query(S.with_tables("m runs files items", """SELECT owner_user_id, table_name, CAST(sum(n) AS BIGINT) AS n FROM files JOIN (
  SELECT file_id, 'files' AS table_name, 1 AS n FROM files UNION ALL SELECT file_id, 'stored_bytes', size_bytes FROM files
  UNION ALL SELECT file_id, 'mapping_runs', 1 FROM runs UNION ALL SELECT file_id, 'review_items', 1 FROM items
  UNION ALL SELECT file_id, 'measurements', 1 FROM m) USING (file_id) GROUP BY 1, 2"""))
def owner_inventory(spark, folder):
    return summaries.owner_inventory(S.files(spark, folder), {
        "mapping_runs": S.runs(spark, folder), "review_items": S.review_items(spark, folder),
        "measurements": S.measurements(spark, folder)}).select("owner_user_id", "table_name", "n")


@query(S.with_tables("m runs files items", """SELECT 'files' AS table_name, CAST(count(*) AS BIGINT) AS n FROM files WHERE owner_user_id <> 5
  UNION ALL SELECT 'mapping_runs', count(*) FROM runs WHERE file_id NOT IN (SELECT file_id FROM files WHERE owner_user_id = 5)
  UNION ALL SELECT 'review_items', count(*) FROM items WHERE file_id NOT IN (SELECT file_id FROM files WHERE owner_user_id = 5)
  UNION ALL SELECT 'measurements', count(*) FROM m WHERE file_id NOT IN (SELECT file_id FROM files WHERE owner_user_id = 5)"""))
def purge_owner(spark, folder):
    """Rows left in every table after one owner's files are purged."""
    children = {"mapping_runs": S.runs(spark, folder), "review_items": S.review_items(spark, folder),
                "measurements": S.measurements(spark, folder)}
    kept = tables.purge_files(children, S.files(spark, folder), 5)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in kept.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- table changes --------------------------------------------------------------------------

@query(S.with_tables("m", """SELECT file_id, item_code, CAST(count(*) AS BIGINT) AS n, CAST(sum(value_num) AS DOUBLE) AS total FROM (
  SELECT file_id, item_code, value_num FROM m WHERE file_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 2)
  UNION ALL SELECT l_suppkey, 'WQ-001', CAST(l_linenumber AS DECIMAL(18,6)) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  WHERE s_nationkey = 2) GROUP BY 1, 2"""))
def replace_by_file(spark, folder):
    """Stored measurements with the files of one load replaced whole."""
    fresh = S.table(spark, folder, "lineitem").join(
        S.table(spark, folder, "supplier").where("s_nationkey = 2"), F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.col("l_suppkey").alias("file_id"), F.lit("WQ-001").alias("item_code"),
        F.col("l_linenumber").cast(values.DECIMAL).alias("value_num"))
    current = S.measurements(spark, folder).select("file_id", "item_code", "value_num")
    return tables.replace_by_file(current, fresh).groupBy("file_id", "item_code").agg(
        F.count("*").alias("n"), F.sum("value_num").cast("double").alias("total"))


@query("""SELECT key, coalesce(b, a) AS value, first_seen FROM (SELECT coalesce(t.k, u.k) AS key, t.v AS a, u.v AS b,
  coalesce(t.d, u.d) AS first_seen FROM
  (SELECT nullif(o_custkey, 0) AS k, max(o_totalprice) AS v, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) t
  FULL JOIN (SELECT nullif(o_custkey, 0) AS k, arg_max(o_totalprice, o_orderkey) AS v,
    arg_min(CAST(o_orderdate AS DATE), o_orderkey) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) u
  ON t.k IS NOT DISTINCT FROM u.k)""")
def upsert(spark, folder):
    """Per-customer values overwritten by later changes; null keys equal each other."""
    orders = S.table(spark, folder, "orders").select(
        F.nullif(F.col("o_custkey"), F.lit(0).cast("bigint")).alias("key"), F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").cast("date").alias("first_seen"), "o_orderkey", "o_orderstatus")
    current = orders.where("o_orderstatus = 'O'").groupBy("key").agg(
        F.max("value").alias("value"), F.min("first_seen").alias("first_seen"))
    return tables.upsert(current, orders.where("o_orderstatus = 'F'"), ["key"], ["value"], order="o_orderkey")


@query(S.with_tables("m", """SELECT m.file_id, source_column, m.mapping_run_id, CAST(count(*) AS BIGINT) AS n, c.i AS source_column_index
  FROM m LEFT JOIN (SELECT s_suppkey * 10 AS mapping_run_id, '수량' AS raw, 4 AS i FROM supplier
  UNION ALL SELECT s_suppkey * 10, '금액', 5 FROM supplier) c ON c.mapping_run_id = m.mapping_run_id AND c.raw = source_column GROUP BY ALL"""))
def backfill_index(spark, folder):
    """Column positions filled in from the mapping of the same run; a repeated name takes its first."""
    run = (F.col("s_suppkey") * 10).alias("mapping_run_id")
    columns = S.table(spark, folder, "supplier").select(run, F.explode(F.array(*[
        F.struct(F.lit(raw).alias("raw"), F.lit(i).alias("column_index"))
        for raw, i in (("수량", 4), ("금액", 5), ("금액", 9))])).alias("c")).select("mapping_run_id", "c.*")
    filled = tables.backfill_index(S.measurements(spark, folder), columns)
    return filled.groupBy("file_id", "source_column", "mapping_run_id", "source_column_index").agg(F.count("*").alias("n"))


@query(S.with_tables("m", """SELECT file_id, mapping_run_id, CAST(count(*) AS BIGINT) AS n FROM m
  WHERE mapping_run_id = (SELECT max(mapping_run_id) FROM m x WHERE x.file_id = m.file_id) GROUP BY 1, 2"""))
def latest_round_only(spark, folder):
    """Measurements of each file's newest loaded round."""
    rows = S.measurements(spark, folder)
    runs = S.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("file_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("round_no")).withColumn(
        "mapping_run_id", F.col("file_id") * 10 + F.col("round_no"))
    return tables.latest_round_rows(rows, runs).groupBy("file_id", "mapping_run_id").agg(F.count("*").alias("n"))


def _place(spark, name: str) -> str:
    return f"{session.scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _files_of(written: DataFrame) -> DataFrame:
    """The audit of a load: the files it has records of, as written."""
    return written.select("file_id").distinct()


@query(S.with_tables("m", """SELECT file_id, item_code, CAST(count(*) AS BIGINT) AS n FROM m
  WHERE file_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 2) GROUP BY 1, 2"""))
def reload_emptied_file(spark, folder):
    """Stored measurements after a second load in which some files have no value left."""
    store = _place(spark, "measurements")
    rows = S.measurements(spark, folder).withColumn("loaded", F.lit(True))
    emptied = S.table(spark, folder, "supplier").where("s_nationkey = 2").select(F.col("s_suppkey").alias("file_id"))
    sinks.append_load(spark, rows, _files_of, store, 1)
    sinks.append_load(spark, rows.where("false"), lambda _: emptied, store, 2)
    return ingest.stored_measurements(spark, store).groupBy("file_id", "item_code").agg(F.count("*").alias("n"))


@query(S.with_tables("m", """SELECT file_id, item_code, CAST(count(*) AS BIGINT) AS n, 2 AS parts FROM m
  WHERE file_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 2) GROUP BY 1, 2"""))
def compact_store(spark, folder):
    """Stored measurements after loads that replaced and emptied files were compacted, one part per table, and old ones deleted."""
    store = _place(spark, "measurements")
    rows = S.measurements(spark, folder)
    emptied = S.table(spark, folder, "supplier").where("s_nationkey = 2").select(F.col("s_suppkey").alias("file_id"))
    for batch_id, records, audit in ((1, rows.unionByName(rows), _files_of), (2, rows, _files_of), (3, rows.where("false"), lambda _: emptied)):
        sinks.append_load(spark, records, audit, store, batch_id)
    sinks.compact_loads(spark, store)
    sinks.append_load(spark, rows, _files_of, store, 1)  # a late replay of a load that the compaction took in
    held = snapshots.Store(spark, store)
    held.expire(keep=1, older_than=0)
    return ingest.stored_measurements(spark, store).groupBy("file_id", "item_code").agg(F.count("*").alias("n")).withColumn(
        "parts", F.lit(len(held.manifest()["parts"])))


@query(S.with_tables("limit_rows", """SELECT standard_set, CAST(count(*) AS BIGINT) AS n FROM limit_rows
  WHERE standard_set IS DISTINCT FROM 'SMALL' GROUP BY 1"""))
def replace_emptied_set(spark, folder):
    """Stored limits after a set was replaced by nothing."""
    from hydromelt.operators.standards import typed_limits
    limits, store = session.stage(typed_limits(S.limit_rows(spark, folder)), "limits"), _place(spark, "limits")
    for (name,) in limits.select("standard_set").distinct().collect():  # a few sets of limits
        sinks.replace_standard_set(limits, store, name)
    sinks.replace_standard_set(limits.where("false"), store, "SMALL")
    return sinks.stored_limits(spark, store).groupBy("standard_set").agg(F.count("*").alias("n"))


# --- the whole chain ---------------------------------------------------------------------------

@query("""SELECT strftime(o_orderdate, '%Y-%m') AS bucket, 'WQ-002' AS item_code,
  CAST(max(o_totalprice) AS DOUBLE) AS value, CAST(count(*) AS BIGINT) AS n, '2' AS dictionary_version, CAST(o_custkey % 3 AS BIGINT) AS runs
  FROM orders WHERE o_custkey % 3 < 2 GROUP BY 1, o_custkey % 3""")
def chained_jobs(spark, folder):
    """Columns mapped twice, a person's decision, ingestion of the newest run, and the series of what was stored.

    Files are customers by the rest of their key on division by three. File 0 was decided by a person, file 1 by the second
    mapping; file 2 has no measured column in its newest run.
    """
    from hydromelt.operators import analysis
    orders = S.table(spark, folder, "orders")
    file_id = (F.col("o_custkey") % 3).cast("long")
    data = orders.select(file_id.alias("file_id"), F.col("o_orderkey").alias("source_row"), F.array(
        F.date_format("o_orderdate", "yyyy-MM-dd"), S.money("o_totalprice")).alias("cells"))
    files = data.select("file_id").distinct()
    runs = files.select("file_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("round_no")).withColumn(
        "mapping_run_id", F.col("file_id") * 10 + F.col("round_no"))
    known = F.when((F.col("file_id") == 1) == (F.col("round_no") == 2), "WQ-002").when(F.col("file_id") == 0, F.lit(None))
    priced = F.when(F.col("file_id") == 2, F.when(F.col("round_no") == 1, "WQ-002")).otherwise(known)
    text = lambda c: F.lit(c).cast("string")
    columns = runs.select("mapping_run_id", "file_id", F.explode(F.array(
        F.struct(F.lit(0).alias("column_index"), text("측정일자").alias("raw"), text("MD-006").alias("code"),
                 text(C.DICT_METADATA).alias("dict_type"), text("exact").alias("status")),
        F.struct(F.lit(1).alias("column_index"), text("금액").alias("raw"), priced.alias("code"),
                 F.when(priced.isNotNull(), C.DICT_MEASUREMENT).alias("dict_type"),
                 F.when(priced.isNotNull(), "exact").otherwise("unmapped").alias("status")))).alias("c")).select(
        "mapping_run_id", "file_id", "c.*").withColumns({"site": text(None), "via": text(None)})
    reviews = files.where("file_id = 0").select("file_id", F.lit(1).alias("column_index"), F.lit("WQ-002").alias("code"), F.lit(
        C.DICT_MEASUREMENT).alias("dict_type"))
    store = _place(spark, "measurements")
    chosen, overrides = ingest.newest_mapping(runs, columns, reviews)
    for version, at in (("1", datetime(2024, 1, 1, tzinfo=timezone.utc)), ("2", datetime(2024, 1, 2, tzinfo=timezone.utc))):
        ingest.ingest(chosen, data, store, date(2030, 1, 1), version, overrides, ran_at=at)
    stored = ingest.stored_measurements(spark, store)
    version = analysis.latest_version(ingest.stored_runs(spark, store), files.withColumn("owner_user_id", F.lit(7)))
    request = analysis.AnalysisRequest(metric="max")
    parts = [analysis.series(tables.latest_round_rows(stored.where(F.col("file_id") == k), runs), request).withColumn(
        "runs", F.lit(k).cast("bigint")) for k in range(3)]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("owner_user_id", F.lit(7))
    return found.join(version, "owner_user_id").select("bucket", "item_code", F.col("value").cast("double").alias("value"), "n",
                                                       "dictionary_version", "runs")


# --- duplicate reports ------------------------------------------------------------------------

@query(S.with_tables("m", """SELECT file_id, CAST(count(*) AS BIGINT) AS measurement_count,
  CAST(count(DISTINCT mapping_run_id) AS BIGINT) AS mapping_run_count FROM m GROUP BY 1 HAVING count(DISTINCT mapping_run_id) > 1"""))
def dq_mixed_rounds(spark, folder):
    return quality.mixed_rounds(S.measurements(spark, folder))


@query(S.with_tables("m", """SELECT file_id, source_row, source_column_index, CAST(count(*) AS BIGINT) AS duplicate_count
  FROM m GROUP BY 1, 2, 3 HAVING count(*) > 1"""))
def dq_duplicates(spark, folder):
    return quality.duplicate_measurements(S.measurements(spark, folder))


@query(S.with_tables("items", """SELECT file_id, column_index, raw, CAST(count(*) AS BIGINT) AS review_count FROM items
  GROUP BY 1, 2, 3 HAVING count(*) > 1"""))
def dq_duplicate_reviews(spark, folder):
    return quality.duplicate_reviews(S.review_items(spark, folder))


@query(S.with_tables("runs", """SELECT file_id, CAST(count(*) AS BIGINT) AS ingestion_run_count FROM runs GROUP BY 1 HAVING count(*) > 1"""))
def dq_duplicate_ingestions(spark, folder):
    return quality.duplicate_ingestions(S.runs(spark, folder))


@query(S.with_tables("limit_rows", "SELECT source, CAST(count(*) AS BIGINT) AS row_count FROM limit_rows GROUP BY 1"))
def dq_limit_sources(spark, folder):
    from hydromelt.operators.standards import typed_limits
    return quality.limit_sources(typed_limits(S.limit_rows(spark, folder)))


@query(S.with_tables("limit_rows", """SELECT item_code, scale, CAST(count(*) AS BIGINT) AS region_count FROM limit_rows
  WHERE item_code IN ('WQ-001', 'WQ-025', 'WQ-045') GROUP BY 1, 2"""))
def dq_limit_matrix(spark, folder):
    from hydromelt.operators.standards import typed_limits
    return quality.limit_matrix(typed_limits(S.limit_rows(spark, folder)), ["WQ-001", "WQ-025", "WQ-045"])
