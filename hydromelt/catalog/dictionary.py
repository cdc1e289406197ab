"""Queries over the dictionary tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.catalog import standins as S
from hydromelt.catalog.registry import Topic
from hydromelt.functions import names
from hydromelt.operators import lexicon, quality, review, tables, terms as term_ops

query = Topic()


# --- flat dictionaries and lexicon ---------------------------------------------------

def _flat(spark, folder, kind):
    """Flat terms: one per part size, its part names as pipe-joined synonyms."""
    wanted, prefix = (F.col("p_size") <= 30, "WQ-") if kind == "measurement" else (F.col("p_size") > 30, "MD-")
    part = S.table(spark, folder, "part").where(wanted).groupBy("p_size").agg(
        F.min("p_name").alias("low"), F.array_join(F.array_sort(F.collect_set(F.concat("p_name", F.lit(" "), "p_type"))),
                                                   " | |").alias("joined"))
    size = F.col("p_size")
    return part.select(
        size.cast("bigint").alias("row_no"), F.concat(F.lit(prefix), F.lpad(size.cast("string"), 3, "0")).alias("code"),
        F.concat(F.lit(" "), "low", F.lit(" ")).alias("name_ko"), F.lit("NaN").alias("name_en"),
        F.when(size >= 10, F.concat(F.lit("T"), size.cast("string"))).alias("abbr"),
        F.when(size < 45, F.col("joined")).otherwise("nan").alias("synonyms"),
        F.when(size < 20, "Y").otherwise("N").alias("verified"))


_FLAT_SQL = """SELECT p_size AS row_no, CASE WHEN p_size <= 30 THEN 'WQ-' ELSE 'MD-' END || lpad(CAST(p_size AS VARCHAR), 3, '0') AS code,
  min(p_name) AS low, list_sort(list(DISTINCT p_name || ' ' || p_type)) AS names FROM part GROUP BY p_size"""
_SPELL_SQL = f"""SELECT row_no, code, 'name_ko' AS field, low AS variant, 0 AS pos FROM ({_FLAT_SQL})
  UNION ALL SELECT row_no, code, 'abbr', 'T' || row_no, 2 FROM ({_FLAT_SQL}) WHERE row_no >= 10
  UNION ALL SELECT row_no, code, 'synonyms', names[i], 1 + 2 * CAST(i AS INTEGER) FROM (
    SELECT *, unnest(generate_series(1, len(names))) AS i FROM ({_FLAT_SQL}) WHERE row_no < 45)"""
_KEYS_SQL = f"SELECT *, {S.squared_body('variant')} AS variant_norm, CASE WHEN code LIKE 'WQ-%' THEN 0 ELSE 1 END AS d FROM spelled"


@query(S.with_tables("", "SELECT code, field, variant FROM spelled", spelled=_SPELL_SQL))
def lexicon_build(spark, folder):
    """Every spelling of both flat dictionaries."""
    both = lexicon.spellings(_flat(spark, folder, "measurement"), C.DICT_MEASUREMENT).unionByName(
        lexicon.spellings(_flat(spark, folder, "metadata"), C.DICT_METADATA))
    return both.select("code", "field", "variant")


def _keys(spark, folder):
    return lexicon.all_keys(_flat(spark, folder, "measurement"), _flat(spark, folder, "metadata"))


@query(S.with_tables("", """SELECT variant_norm, CAST(count(DISTINCT code) AS BIGINT) AS owners,
  array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM keys WHERE variant_norm <> '' GROUP BY 1 HAVING count(DISTINCT code) > 1""",
                     spelled=_SPELL_SQL, keys=_KEYS_SQL))
def lexicon_conflicts(spark, folder):
    return lexicon.conflicts(_keys(spark, folder)).withColumn("codes", F.array_join("codes", ","))


_UNIQUE_SQL = """SELECT * FROM keys WHERE variant_norm <> ''
  QUALIFY row_number() OVER (PARTITION BY variant_norm ORDER BY d, row_no, pos) = 1"""


@query(S.with_tables("", """SELECT code, arg_min(variant, pos) AS name, CASE d WHEN 0 THEN '측정항목' ELSE '메타' END AS dict_type
  FROM entries WHERE field = 'name_ko' GROUP BY code, d""", spelled=_SPELL_SQL, keys=_KEYS_SQL, entries=_UNIQUE_SQL))
def term_names(spark, folder):
    return lexicon.term_names(lexicon.unique_entries(_keys(spark, folder)))


@query(S.with_tables("", f"SELECT code, low AS name FROM ({_FLAT_SQL}) WHERE code LIKE 'WQ-%' AND (lower(low) LIKE '%blue%' OR lower(code) LIKE '%blue%')"))
def term_search(spark, folder):
    terms = _flat(spark, folder, "measurement").unionByName(_flat(spark, folder, "metadata")).select(
        "code", F.trim("name_ko").alias("name"), F.when(F.col("code").startswith("WQ-"), C.DICT_MEASUREMENT).otherwise(
            C.DICT_METADATA).alias("dict_type"))
    return lexicon.search_terms(terms, " Blue ", C.DICT_MEASUREMENT).select("code", "name")


@query(S.with_tables("", """SELECT CAST(count(*) FILTER (row_no <= 30) AS BIGINT) AS measurement_terms,
  CAST(count(*) FILTER (row_no > 30) AS BIGINT) AS metadata_terms,
  CAST(sum(CASE WHEN row_no < 45 THEN 2 * len(names) - 1 ELSE 1 END) AS BIGINT) AS synonyms,
  CAST(count(*) FILTER (row_no < 20) AS BIGINT) AS verified_terms FROM flat""", flat=_FLAT_SQL))
def dict_version(spark, folder):
    """Counts a dictionary version is stamped with; every pipe part counts."""
    return lexicon.version_counts(_flat(spark, folder, "measurement"), _flat(spark, folder, "metadata"))


# --- synonyms ----------------------------------------------------------------------------

@query(S.with_tables("syn src", """SELECT row_no, code, surface, source_id FROM syn JOIN src USING (source_id)
  WHERE review_status <> 'rejected' AND reliability <> 'inferred'"""))
def synonym_filter(spark, folder):
    kept = lexicon.usable_synonyms(S.synonyms(spark, folder), S.sources(spark, folder), exclude_inferred=True)
    return kept.select("row_no", lexicon.code_of().alias("code"), "surface", "source_id")


@query(S.with_tables("syn", """SELECT c.code, synonym_count, source_count, surfaces FROM (SELECT code, CAST(count(*) AS BIGINT) AS synonym_count,
  CAST(count(DISTINCT source_id) AS BIGINT) AS source_count FROM live GROUP BY 1) c JOIN (
  SELECT code, string_agg(surface, '|' ORDER BY first_at) AS surfaces FROM (SELECT code, surface, min(row_no) AS first_at FROM live GROUP BY 1, 2)
  GROUP BY 1) s ON s.code = c.code""", live="SELECT * FROM syn WHERE review_status <> 'rejected'"))
def synonym_collect(spark, folder):
    found = lexicon.collect_synonyms(S.synonyms(spark, folder), S.sources(spark, folder))
    return found.withColumn("surfaces", F.array_join("surfaces", "|"))


def _collected(spark, folder):
    return lexicon.collect_synonyms(S.synonyms(spark, folder), S.sources(spark, folder))


@query(S.with_tables("syn mterms", """SELECT m.code, std_name AS name_ko, CASE WHEN abbr = '-' THEN '' ELSE abbr END AS abbr,
  CASE review_status WHEN 'verified' THEN 'Y' ELSE 'N' END AS verified, coalesce(n, 0) AS synonym_count,
  coalesce(s, 0) AS source_count, legal_basis FROM mterms m LEFT JOIN (SELECT code, CAST(count(*) AS BIGINT) AS n,
  CAST(count(DISTINCT source_id) AS BIGINT) AS s FROM syn WHERE review_status <> 'rejected' GROUP BY 1) USING (code)"""))
def export_flat(spark, folder):
    """Flat rows of the measurement dictionary; its kept synonyms are query greedy_dedupe."""
    flat = lexicon.flat_terms(S.terms(spark, folder, "measurement"), _collected(spark, folder), "measurement")
    return flat.select("code", "name_ko", "abbr", "verified", "synonym_count", "source_count", "legal_basis")


@query(S.with_tables("syn mterms", """SELECT m.code, coalesce(string_agg(surface, '|' ORDER BY first_at) FILTER (keep), '') AS synonyms,
  CAST(count(*) FILTER (NOT keep) AS BIGINT) AS redundant FROM mterms m LEFT JOIN marked USING (code) GROUP BY m.code""",
                     base=f"""SELECT code, {S.squared_body('std_name')} AS b FROM mterms UNION SELECT code, {S.squared_body('name_en')} FROM mterms
  UNION SELECT code, {S.squared_body('abbr')} FROM mterms WHERE abbr <> '-'""",
                     keyed=f"""SELECT *, {S.squared_body('surface')} AS b FROM (SELECT code, surface, min(row_no) AS first_at FROM syn
  WHERE review_status <> 'rejected' GROUP BY 1, 2)""",
                     marked="""SELECT code, surface, first_at, k.b = '' OR (base.b IS NULL AND row_number() OVER (
  PARTITION BY code, k.b ORDER BY first_at) = 1) AS keep FROM keyed k LEFT JOIN base USING (code, b)"""))
def greedy_dedupe(spark, folder):
    """Synonyms kept per term once spellings with an already known key are dropped."""
    base = S.terms(spark, folder, "measurement").withColumnRenamed("std_name", "name_ko").join(
        _collected(spark, folder), "code", "left")
    return lexicon.drop_redundant(base).select("code", "synonyms", F.col("redundant").cast("bigint").alias("redundant"))


@query(S.with_tables("syn mterms dterms", """SELECT t.code, term_kind, std_name, synonyms, coalesce(n, 0) AS synonym_count,
  coalesce(s, 0) AS source_count, last_collected_on FROM (SELECT code, std_name, 'measurement' AS term_kind FROM mterms
  UNION ALL SELECT code, std_name, 'metadata' FROM dterms) t LEFT JOIN (SELECT code, string_agg(DISTINCT surface, '|' ORDER BY surface) AS synonyms,
  CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source_id) AS BIGINT) AS s, max(collected_on) AS last_collected_on
  FROM syn WHERE review_status <> 'rejected' GROUP BY 1) USING (code)"""))
def dictionary_flat(spark, folder):
    view = lexicon.dictionary_view(S.terms(spark, folder, "measurement"), S.terms(spark, folder, "metadata"),
                                   S.synonyms(spark, folder))
    return view.select("code", "term_kind", "std_name", "synonyms", "synonym_count", "source_count", "last_collected_on")


@query(S.with_tables("syn", """SELECT lower(regexp_replace(surface, '[^0-9A-Za-z가-힣]', '', 'g')) AS surface_norm,
  array_to_string(list_sort(list(DISTINCT code)), ',') AS codes, array_to_string(list_sort(list(DISTINCT surface)), ',') AS surfaces,
  array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources FROM syn WHERE review_status <> 'rejected'
  GROUP BY 1 HAVING count(DISTINCT code) > 1"""))
def synonym_conflicts(spark, folder):
    return lexicon.synonym_conflicts(S.synonyms(spark, folder)).withColumns({
        c: F.array_join(c, ",") for c in ("codes", "surfaces", "sources")})


@query(S.with_tables("syn src", """SELECT source_id, source_name, reliability,
  CAST(count(*) FILTER (term_kind = 'measurement') AS BIGINT) AS measurement_synonyms,
  CAST(count(*) FILTER (term_kind = 'metadata') AS BIGINT) AS metadata_synonyms, min(collected_on) AS first_collected,
  max(collected_on) AS last_collected FROM src LEFT JOIN syn USING (source_id) GROUP BY 1, 2, 3"""))
def source_coverage(spark, folder):
    return lexicon.source_coverage(S.sources(spark, folder), S.synonyms(spark, folder))


def _registered(spark, folder):
    """Codes one source has registered."""
    return S.table(spark, folder, "part").where("p_brand = 'Brand#7'").select(F.concat(
        F.when(F.col("p_size") <= 30, "WQ-").otherwise("MD-"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("code"))


@query(S.with_tables("syn", """SELECT row_no, code, surface FROM syn WHERE code NOT IN (
  SELECT code FROM syn WHERE source_id = 'Brand#7')"""))
def orphans(spark, folder):
    return lexicon.orphans(S.synonyms(spark, folder), _registered(spark, folder)).select("row_no", "code", "surface")


@query(S.with_tables("syn mterms dterms", """
  SELECT 'spelling_conflict' AS rule, norm AS subject, CAST(count(DISTINCT code) AS VARCHAR) AS detail FROM live GROUP BY norm
    HAVING count(DISTINCT code) > 1
  UNION ALL SELECT 'repeated_spelling_per_source', norm, source_id || '/' || code FROM live GROUP BY norm, source_id, code HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_standard_name', norm, CAST(count(DISTINCT code) AS VARCHAR) FROM (
    SELECT code, lower(replace(std_name, ' ', '')) AS norm FROM mterms UNION ALL SELECT code, lower(replace(std_name, ' ', '')) FROM dterms)
    GROUP BY norm HAVING count(DISTINCT code) > 1
  UNION ALL SELECT 'expected_statutory_terms', '57', CAST(count(*) AS VARCHAR) FROM mterms WHERE legal_status = 'statutory' HAVING count(*) <> 57""",
                     live="SELECT *, lower(replace(surface, ' ', '')) AS norm FROM syn WHERE review_status <> 'rejected'"))
def dq_dictionary(spark, folder):
    return quality.dictionary_rules(
        S.terms(spark, folder, "measurement"), S.terms(spark, folder, "metadata"), S.synonyms(spark, folder),
        {"statutory": C.EXPECTED_STATUTORY_TERMS})


@query("""SELECT 'closed_list:legal_status' AS rule, CAST(p_partkey AS VARCHAR) AS subject, lower(p_type) AS detail FROM part
    WHERE p_type NOT IN ('ECONOMY', 'SMALL')
  UNION ALL SELECT 'pattern:term_code', CAST(p_partkey AS VARCHAR), 'WQ-0' || p_size FROM part WHERE p_size < 10
  UNION ALL SELECT 'exactly_one_parent', p_name, CASE WHEN p_size < 10 THEN '0' ELSE '2' END FROM part
    WHERE p_size < 10 OR p_size > 45""")
def dq_enums(spark, folder):
    part = S.table(spark, folder, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", "statutory").when(F.col("p_type") == "SMALL", "superseded").otherwise(
        F.lower("p_type"))
    coded = part.select(F.col("p_partkey").alias("id"), kind.alias("legal_status"),
                        F.concat(F.lit("WQ-0"), F.col("p_size").cast("string")).alias("term_code"))
    listed = quality.column_rules(coded, "id", {"legal_status": C.LEGAL_STATUSES}, {"term_code": r"^WQ-[0-9]{3}$"})
    parents = part.select(F.col("p_name").alias("surface"),
                          F.when(F.col("p_size") >= 10, "WQ-010").otherwise("").alias("measurement_code"),
                          F.when(F.col("p_size") > 45, "MD-010").alias("metadata_code"))
    return listed.unionByName(quality.one_parent(parents))


# --- growth -------------------------------------------------------------------------------

@query(S.with_tables("syn", """SELECT term_kind, code, surface, collected_on, note FROM (
  SELECT *, CASE WHEN code LIKE 'WQ-%' THEN 'measurement' ELSE 'metadata' END AS term_kind FROM lines
  WHERE NOT EXISTS (SELECT 1 FROM syn s WHERE s.code = lines.code AND lower(replace(s.surface, ' ', '')) = lines.key)
  QUALIFY row_number() OVER (PARTITION BY code, key ORDER BY row_no) = 1)""",
                     lines="""SELECT c_custkey AS row_no, CASE WHEN c_nationkey < 13 THEN 'WQ-0' ELSE 'MD-0' END || (10 + c_nationkey) AS code,
  c_mktsegment || CASE WHEN c_acctbal < 5000 THEN ' a' ELSE '-b' END AS surface,
  lower(c_mktsegment || CASE WHEN c_acctbal < 5000 THEN 'a' ELSE 'b' END) AS key, '2026-08-08' AS collected_on,
  '리뷰 대기열 승인 (판정자: ' || CASE WHEN c_acctbal < 0 THEN '미기재' ELSE c_name END || ')' AS note FROM customer"""))
def log_import(spark, folder):
    """Review-log lines turned into new synonym rows."""
    log = S.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("row_no"),
        F.concat(F.when(F.col("c_nationkey") < 13, "WQ-0").otherwise("MD-0"), (F.col("c_nationkey") + 10).cast("string")).alias("code"),
        F.concat("c_mktsegment", F.when(F.col("c_acctbal") < 5000, " a").otherwise("-b")).alias("synonym"),
        F.lit("2026-08-08T10:00:00").alias("collected_at"), F.lit("f.csv").alias("source"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("reviewer"))
    added = review.log_synonyms(log, S.synonyms(spark, folder))
    code = F.coalesce(F.nullif("measurement_code", F.lit("")), "metadata_code")
    return added.select("term_kind", code.alias("code"), "surface", "collected_on", "note")


def _queue(spark, folder):
    """Unresolved names: one per nation that has a supplier."""
    return S.table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("seen_count")).select(
        F.col("s_nationkey").alias("id"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("surface"),
        F.lit(None).cast("string").alias("source_id"), F.lit(date(2024, 1, 5)).alias("first_seen_on"),
        F.lit(date(2024, 1, 5)).alias("last_seen_on"), "seen_count",
        F.when(F.col("s_nationkey") < 5, "ignored").otherwise("pending").alias("status"),
        F.lit(None).cast("string").alias("resolved_by"))


_QUEUE_SQL = """SELECT s_nationkey AS id, 'Nation ' || s_nationkey AS surface, CAST(NULL AS VARCHAR) AS source_id,
  DATE '2024-01-05' AS first_seen_on, count(*) AS seen_count, CASE WHEN s_nationkey < 5 THEN 'ignored' ELSE 'pending' END AS status
  FROM supplier GROUP BY s_nationkey"""


@query(S.with_tables("", """SELECT lower(regexp_replace(surface, '[^0-9A-Za-z]', '', 'g')) AS surface_norm, source_id,
  arg_min(surface, (fresh, first_seen_on, surface)) AS surface, min(first_seen_on) AS first_seen_on, max(last_seen_on) AS last_seen_on,
  CAST(sum(seen_count) AS BIGINT) AS seen_count, coalesce(max(status), 'pending') AS status FROM (
    SELECT surface, source_id, first_seen_on, first_seen_on AS last_seen_on, seen_count, status, 0 AS fresh FROM queue
    UNION ALL SELECT 'nation-' || c_nationkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END,
      DATE '2024-01-01' + c_nationkey, DATE '2024-01-01' + c_nationkey, 1, NULL, 1 FROM customer) GROUP BY 1, 2""",
                     queue=_QUEUE_SQL))
def unresolved_merge(spark, folder):
    """The unresolved-name queue after a batch of new sightings."""
    sightings = S.table(spark, folder, "customer").select(
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("surface"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("source_id"),
        F.date_add(F.lit(date(2024, 1, 1)), F.col("c_nationkey")).alias("seen_on"))
    return tables.merge_sightings(_queue(spark, folder), sightings)


@query(S.with_tables("", """SELECT id, CASE WHEN n_nationkey IS NOT NULL THEN 'promoted' ELSE status END AS status,
  n_name AS resolved_by, CASE WHEN n_regionkey < 3 THEN 'WQ-00' || n_regionkey END AS measurement_code,
  CASE WHEN n_regionkey = 3 THEN 'MD-003' END AS metadata_code, CASE WHEN n_nationkey IS NOT NULL THEN 'MANUAL' END AS source_id
  FROM queue LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) ON n_nationkey = id""", queue=_QUEUE_SQL))
def promote(spark, folder):
    """Decided queue rows become synonyms and are closed."""
    decisions = S.table(spark, folder, "nation").where("n_regionkey < 4").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("reviewer"),
        F.concat(F.when(F.col("n_regionkey") < 3, "WQ-00").otherwise("MD-00"), F.col("n_regionkey").cast("string")).alias("code"))
    synonyms, queue = tables.promote_sightings(_queue(spark, folder), decisions)
    return queue.select("id", "surface", "status", "resolved_by").join(
        synonyms.select("surface", "measurement_code", "metadata_code", "source_id"), "surface", "left").drop("surface")


# --- verification against the national lists ------------------------------------------------

def _standard(spark, folder):
    return S.table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_no"), F.col("p_name").alias("term_name"),
        F.concat(F.lit(" "), "p_type", F.lit(" , "), "p_brand").alias("synonyms"))


def _targets(spark, folder):
    part = S.table(spark, folder, "part")
    text = F.explode(F.array(
        F.col("p_name"), F.col("p_brand"), F.replace(F.col("p_name"), F.lit(" "), F.lit("")),
        F.concat_ws(" ", "p_name", "p_type"), F.substring_index("p_name", " ", -1)))
    every = part.select(text.alias("std_name")).unionByName(
        S.table(spark, folder, "customer").select(F.col("c_mktsegment").alias("std_name"))).distinct()
    return every.select(F.col("std_name").alias("code"), "std_name")


def _vocabulary(spark, folder):
    return term_ops.word_list(S.table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_no"), F.explode(F.split("p_name", " ")).alias("word")).withColumn(
        "abbr", F.upper(F.substring("word", 1, 2))))


_VERIFY_CTES = dict(
    targets="""SELECT DISTINCT unnest([p_name, p_brand, replace(p_name, ' ', ''), p_name || ' ' || p_type, split_part(p_name, ' ', 2)]) AS term
  FROM part UNION SELECT c_mktsegment FROM customer""",
    spelled="""SELECT spelling, arg_min(p_name, (p_partkey, pos)) AS official FROM (SELECT p_partkey, p_name, p_type AS spelling, 0 AS pos FROM part
  UNION ALL SELECT p_partkey, p_name, p_brand, 1 FROM part) GROUP BY 1""",
    words="SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part",
    composed="SELECT DISTINCT a.word || b.word AS term FROM words a, words b UNION SELECT word FROM words",
    near="""SELECT term, string_agg(official, ',' ORDER BY place) AS related FROM (SELECT term, official, row_number() OVER (
  PARTITION BY term ORDER BY length(official) DESC, official) AS place FROM targets, (SELECT DISTINCT p_name AS official FROM part)
  WHERE term <> official AND (contains(term, official) OR contains(official, term))) WHERE place <= 6 GROUP BY 1""")


@query(S.with_tables("", """SELECT t.term, CASE WHEN t.term IN (SELECT p_name FROM part) THEN 'listed' WHEN s.official IS NOT NULL THEN 'synonym'
  WHEN t.term IN (SELECT term FROM composed) THEN 'composed' ELSE 'missing' END AS verdict,
  CASE WHEN t.term NOT IN (SELECT p_name FROM part) THEN s.official END AS official, coalesce(related, '') AS related
  FROM targets t LEFT JOIN spelled s ON spelling = t.term LEFT JOIN near ON near.term = t.term""", **_VERIFY_CTES))
def term_verify(spark, folder):
    checked = term_ops.verify_terms(_targets(spark, folder), _standard(spark, folder), _vocabulary(spark, folder), related=6)
    return checked.select("term", "verdict", "official", F.array_join("related", ",").alias("related"))


@query(S.with_tables("", f"""SELECT term, CAST(place AS INTEGER) AS place, official, round_even(ratio, 1) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY ratio DESC, row_no) AS place FROM (
    SELECT term, official, row_no, {S.ratio_sql('term', 'official')} AS ratio FROM targets, (
      SELECT p_name AS official, min(p_partkey) AS row_no FROM part GROUP BY 1))) WHERE place <= 3""", targets=_VERIFY_CTES["targets"]))
def term_verify_fuzzy(spark, folder):
    """The three most similar official names per target, as advice."""
    targets = _targets(spark, folder).select(F.col("std_name").alias("term"))
    official = _standard(spark, folder).groupBy("term_name").agg(F.min("row_no").alias("row_no"))
    return term_ops.similar_names(targets, official, 3)
