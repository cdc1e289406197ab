"""Dictionary operators: lexicon, conflicts, flat projections, synonym collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import names, values
from hydromelt.operators.numbering import first_per
from hydromelt.session import stage


class DictionaryConflict(ValueError):
    """One spelling stands for more than one standard code."""


def spellings(terms: DataFrame, dict_type: str) -> DataFrame:
    """One row per spelling of a flat dictionary, in reading order."""
    fields = [F.struct(F.lit(f).alias("field"), values.strip(F.col(f)).alias("variant"))
              for f in ("name_ko", "name_en", "abbr")]
    synonyms = F.transform(F.split("synonyms", r"\|"),
                           lambda s: F.struct(F.lit("synonyms").alias("field"),
                                              values.strip(s).alias("variant")))
    listed = (~F.lower(values.strip(F.col("synonyms"))).isin("", "nan"))
    every = F.concat(F.array(*fields), F.when(listed, synonyms).otherwise(F.array().cast(
        "array<struct<field:string,variant:string>>")))
    return (terms.na.fill("")
            .withColumn("code", values.strip(F.col("code"))).where(F.col("code") != "")
            .select(F.lit(dict_type).alias("dict_type"), "row_no", "code",
                    F.posexplode(every).alias("pos", "entry"))
            .select("dict_type", "row_no", "code", "pos", "entry.field", "entry.variant")
            .where((F.col("variant") != "")
                   & ((F.lower("variant") != "nan") | (F.col("field") == "synonyms"))))


def index_keys(spelled: DataFrame) -> DataFrame:
    """Lookup keys of spellings: the body, then each bracketed abbreviation."""
    forms = spelled.select("variant").distinct().withColumn("form", names.normalize_name("variant"))
    keys = F.concat(F.array("form.body"), F.col("form.paren_tokens"))
    part = spelled.join(forms, "variant").select(
        "*", F.posexplode(keys).alias("token", "variant_norm")).where(F.col("variant_norm") != "")
    order = F.concat_ws(
        "/", F.when(F.col("dict_type") == C.DICT_MEASUREMENT, "0").otherwise("1"),
        F.lpad(F.col("row_no").cast("string"), 19, "0"), F.lpad(F.col("pos").cast("string"), 6, "0"),
        F.lpad(F.col("token").cast("string"), 6, "0"))
    return part.select(
        order.alias("seq"), "dict_type", "code",
        F.when(F.col("token") > 0, F.concat("field", F.lit("(paren)"))).otherwise(
            F.col("field")).alias("field"), "variant", "variant_norm")


def all_keys(measurement: DataFrame, metadata: DataFrame) -> DataFrame:
    return index_keys(spellings(measurement, C.DICT_MEASUREMENT).unionByName(
        spellings(metadata, C.DICT_METADATA)))


def conflicts(keys: DataFrame) -> DataFrame:
    """Spellings that lead to more than one (dictionary, code)."""
    owner = F.struct("dict_type", "code")
    return (keys.groupBy("variant_norm").agg(F.count_distinct(owner).alias("owners"),
                                             F.array_sort(F.collect_set("code")).alias("codes"))
            .where("owners > 1"))


def unique_entries(keys: DataFrame) -> DataFrame:
    """The first entry per key."""
    return first_per(keys, ["variant_norm"], [F.col("seq")])


def build_lexicon(measurement: DataFrame, metadata: DataFrame) -> DataFrame:
    """Lexicon of both dictionaries; a spelling with two codes is an error.

    Keys are written once: the check and the lexicon read them back.
    """
    keys = stage(all_keys(measurement, metadata), "keys")
    clash = conflicts(keys).orderBy("variant_norm").take(1)
    if clash:
        raise DictionaryConflict(f"'{clash[0]['variant_norm']}' stands for {clash[0]['codes']}")
    return unique_entries(keys)


def term_names(lexicon: DataFrame) -> DataFrame:
    """Standard name per code: its first Korean name."""
    return (lexicon.where(F.col("field") == "name_ko").groupBy("code")
            .agg(F.min_by("variant", "seq").alias("name"), F.min_by("dict_type", "seq").alias("dict_type")))


def search_terms(terms: DataFrame, word: str = "", dict_type: str | None = None) -> DataFrame:
    found = terms.where(values.contains_word(word, F.col("code"), F.col("name")))
    return found.where(F.col("dict_type") == dict_type) if (dict_type or "").strip() else found


# --- normalised dictionary tables -------------------------------------------

def code_of() -> Column:
    return F.coalesce(F.nullif(F.col("measurement_code"), F.lit("")),
                      F.nullif(F.col("metadata_code"), F.lit("")))


def usable_synonyms(synonyms: DataFrame, sources: DataFrame, exclude_inferred: bool) -> DataFrame:
    """Synonyms that may enter the flat dictionary."""
    kept = synonyms.where((F.col("review_status") != "rejected") & (values.strip(F.col("surface")) != ""))
    if exclude_inferred:
        inferred = sources.where(F.col("reliability") == "inferred").select("source_id").distinct()
        kept = kept.join(inferred, "source_id", "left_anti")
    return kept


def collect_synonyms(synonyms: DataFrame, sources: DataFrame, exclude_inferred: bool = False,
                     order: str = "row_no") -> DataFrame:
    """Per code: distinct spellings in first-seen order, row and source counts.

    Spellings are made distinct before they are gathered; a code's distinct
    spellings are what its dictionary row stores.
    """
    part = usable_synonyms(synonyms, sources, exclude_inferred).select(
        code_of().alias("code"), values.strip(F.col("surface")).alias("surface"), "source_id",
        F.col(order).alias("_ord"))
    counts = part.groupBy("code").agg(F.count("*").alias("synonym_count"),
                                      F.count_distinct("source_id").alias("source_count"))
    firsts = part.groupBy("code", "surface").agg(F.min("_ord").alias("_ord"))
    lists = firsts.groupBy("code").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_ord", "surface"))), lambda s: s["surface"]).alias("surfaces"))
    return counts.join(lists, "code")


def spelling_rows(terms: DataFrame) -> DataFrame:
    """code, base, at, text: each term's names and synonyms as rows, in order of ``at``; names come first.

    Needs ``code``, ``name_ko``, ``name_en``, ``abbr`` and ordered ``surfaces``.
    """
    blank = lambda v: F.coalesce(v, F.lit("")).isin("", "-")
    named = F.filter(F.array("name_ko", "name_en", "abbr"), lambda v: ~blank(v))
    listed = F.concat(F.transform(named, lambda v: F.struct(F.lit(True).alias("base"), v.alias("text"))),
                      F.transform(F.coalesce("surfaces", F.array().cast("array<string>")),
                                  lambda v: F.struct(F.lit(False).alias("base"), v.alias("text"))))
    return terms.select("code", F.posexplode(listed).alias("at", "s")).select("code", "s.base", "at", "s.text").where("text IS NOT NULL")


def mark_redundant(rows: DataFrame) -> DataFrame:
    """Adds ``redundant``: whether a synonym's body is already a key of an earlier spelling of its code that stays.

    ``rows`` as of :func:`spelling_rows`. The keys of a spelling are its body and its bracketed parts. A body that an earlier
    spelling has is always a key by then, whether that one stays or not. So only a body's first spelling hangs on others,
    through their bracketed parts, and only on such as may go themselves: these few are settled in rounds, each
    settling all that hang on settled ones alone. No spelling is gathered by code.
    """
    forms = rows.select("text").distinct().withColumn("form", names.normalize_name("text"))
    each = stage(rows.join(forms, "text").select("code", "base", "at", "text", "form.body", F.filter(
        "form.paren_tokens", lambda k: k != "").alias("tokens")), "spellings")
    # The names of a term stay in any case; a spelling without a body does too, as nothing can name it.
    first = each.where("body <> ''").groupBy("code", "body").agg(F.min("at").alias("first"))
    marked = each.join(first, ["code", "body"], "left").withColumn("sure", F.col("base") | (F.col("body") == "")).withColumn(
        "open", ~F.col("sure") & (F.col("at") == F.col("first")))
    keys = marked.where("sure OR open").select("code", F.explode("tokens").alias("key"), F.col("at").alias("by"), "sure")
    given = keys.where("sure").groupBy("code", "key").agg(F.min("by").alias("given"))
    settled = stage(marked.join(given.withColumnRenamed("key", "body"), ["code", "body"], "left").select(
        "code", "at", "text", "body", "base", "open", F.when(F.col("open"), F.coalesce(F.col("given") < F.col("at"), F.lit(False))).otherwise(
            ~F.col("sure")).alias("redundant")), "settled")
    asked = settled.where("open AND NOT redundant").select("code", F.col("body").alias("key"), "at")
    edges = stage(keys.where("NOT sure").join(asked, ["code", "key"]).where("by < at").select("code", "at", "by").join(
        asked.select("code", F.col("at").alias("by")), ["code", "by"]).distinct(), "edges")
    return settled.join(_gone(edges), ["code", "at"], "left").select(
        "code", "base", "at", "text", (F.col("redundant") | F.coalesce("gone", F.lit(False))).alias("redundant"))


def _gone(edges: DataFrame) -> DataFrame:
    """code, at, gone of the spellings that go, given who would make whom go (``by`` before ``at``), if ``by`` itself stays."""
    gone = edges.select("code", "at", F.lit(True).alias("gone")).where("false")
    while not edges.isEmpty():
        open_ = edges.select("code", F.col("at").alias("by"), F.lit(True).alias("open")).distinct()
        state = edges.join(open_, ["code", "by"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
        told = stage(state.groupBy("code", "at").agg(F.bool_or(~F.col("open")).alias("gone")), "told")
        goes = told.where("gone").select("code", "at")
        gone = gone.unionByName(goes.withColumn("gone", F.lit(True)))
        # Who goes makes nobody go, and is asked no more; one that nobody is left for stays, and is no longer open.
        left = edges.join(goes, ["code", "at"], "left_anti").join(goes.withColumnRenamed("at", "by"), ["code", "by"], "left_anti")
        edges = stage(left, "edges")
    return gone


def drop_redundant(terms: DataFrame) -> DataFrame:
    """Keep only synonyms whose body is not yet a key of an earlier spelling.

    Needs ``code``, ``name_ko``, ``name_en``, ``abbr`` and ordered ``surfaces``; adds ``synonyms`` (kept, joined) and
    ``redundant`` (dropped count). The kept ones are joined as a dictionary row stores them.
    """
    marked = mark_redundant(spelling_rows(terms)).where("NOT base")
    kept = F.array_sort(F.collect_list(F.when(~F.col("redundant"), F.struct("at", "text"))))
    folded = marked.groupBy("code").agg(F.array_join(F.transform(kept, lambda s: s["text"]), "|").alias("synonyms"),
                                        F.count_if("redundant").cast("int").alias("redundant"))
    return terms.drop("surfaces").join(folded, "code", "left").na.fill("", ["synonyms"]).na.fill(0, ["redundant"])


def flat_terms(terms: DataFrame, collected: DataFrame, kind: str) -> DataFrame:
    """Flat dictionary rows of one kind from term rows and collected synonyms."""
    base = (terms.where(F.col("review_status") != "rejected")
            .withColumnRenamed("std_name", "name_ko").join(collected, "code", "left"))
    joined = drop_redundant(base)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) if c in joined.columns else F.lit("")
    shared = [F.col("code"), F.col("name_ko"), blank("name_en").alias("name_en"),
              F.when(F.col("abbr") == "-", "").otherwise(blank("abbr")).alias("abbr"), F.col("synonyms"),
              blank("unit").alias("unit")]
    tail = [F.when(F.col("review_status") == "verified", "Y").otherwise("N").alias("verified"),
            blank("note").alias("note"),
            F.coalesce("synonym_count", F.lit(0)).alias("synonym_count"),
            F.coalesce("source_count", F.lit(0)).alias("source_count")]
    if kind == "measurement":
        own = [blank(c).alias(c) for c in ("category", "legal_basis", "legal_status", "is_toxic_substance",
                                           "toxic_substance_basis", "legal_article", "legal_effective_from")]
    else:
        own = [blank("facet").alias("category"), blank("standard_basis").alias("reference")] + [
            blank(c).alias(c) for c in ("value_type", "std_domain", "canonical_format", "normalization_note")]
    order = [F.col("row_no")] if "row_no" in joined.columns else []
    return joined.select(*shared, *own, *tail, *order)


def dictionary_view(measurement: DataFrame, metadata: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Both dictionaries with their synonyms joined by pipes, one row per code."""
    live = synonyms.where(F.col("review_status") != "rejected")
    code = code_of()
    counts = live.groupBy(code.alias("code")).agg(
        F.count("*").alias("synonym_count"), F.count_distinct("source_id").alias("source_count"),
        F.max("collected_on").alias("last_collected_on"))
    texts = (live.select(code.alias("code"), "surface").distinct().groupBy("code")
             .agg(F.array_join(F.array_sort(F.collect_list("surface")), "|").alias("synonyms")))
    heads = measurement.select(
        "code", F.lit("measurement").alias("term_kind"), "std_name", "name_en", "abbr", "unit", "category",
        "legal_basis", "legal_status", "review_status").unionByName(metadata.select(
            "code", F.lit("metadata").alias("term_kind"), "std_name", "name_en", "abbr",
            F.lit(None).cast("string").alias("unit"), F.col("facet").alias("category"),
            F.col("standard_basis").alias("legal_basis"), F.lit(None).cast("string").alias("legal_status"),
            "review_status"))
    return heads.join(counts.join(texts, "code"), "code", "left").na.fill(
        0, ["synonym_count", "source_count"])


def synonym_conflicts(synonyms: DataFrame) -> DataFrame:
    """Spellings attached to several codes, with every code, surface and source."""
    live = synonyms.where(F.col("review_status") != "rejected").select(
        names.wq_normalize(F.col("surface")).alias("surface_norm"), code_of().alias("code"), "surface", "source_id")
    torn = live.groupBy("surface_norm").agg(F.count_distinct("code").alias("codes")).where("codes > 1")
    part = live.join(torn.select("surface_norm"), "surface_norm", "left_semi")
    return part.groupBy("surface_norm").agg(
        F.array_sort(F.collect_set("code")).alias("codes"),
        F.array_sort(F.collect_set("surface")).alias("surfaces"),
        F.array_sort(F.collect_set("source_id")).alias("sources"))


def source_coverage(sources: DataFrame, synonyms: DataFrame) -> DataFrame:
    found = synonyms.groupBy("source_id").agg(
        F.count_if(F.col("term_kind") == "measurement").alias("measurement_synonyms"),
        F.count_if(F.col("term_kind") == "metadata").alias("metadata_synonyms"),
        F.min("collected_on").alias("first_collected"), F.max("collected_on").alias("last_collected"))
    return (sources.select("source_id", "source_name", "reliability").join(found, "source_id", "left")
            .na.fill(0, ["measurement_synonyms", "metadata_synonyms"]))


def version_counts(measurement: DataFrame, metadata: DataFrame) -> DataFrame:
    """Term, synonym and verified counts of two flat dictionaries."""
    both = measurement.select(F.lit(True).alias("m"), "synonyms", "verified").unionByName(
        metadata.select(F.lit(False).alias("m"), "synonyms", "verified"))
    parts = F.when(F.coalesce("synonyms", F.lit("")) != "", F.size(F.split("synonyms", r"\|"))).otherwise(0)
    return both.agg(F.count_if("m").alias("measurement_terms"), F.count_if(~F.col("m")).alias("metadata_terms"),
                    F.coalesce(F.sum(parts), F.lit(0)).alias("synonyms"),
                    F.count_if(values.strip(F.col("verified")) == "Y").alias("verified_terms"))


def flag_listed(terms: DataFrame, listed: DataFrame, rank: str = "position") -> DataFrame:
    """Toxic flag by list membership; otherwise false only for statutory terms.

    ``listed`` holds code, position and label of the official list.
    """
    joined = terms.join(listed.select("code", F.col(rank).alias("_at"), F.col("label").alias("_label")),
                        "code", "left")
    statutory = F.col("legal_status") == "statutory"
    opening, middle, closing = C.TOXIC_BASIS
    return joined.withColumn("is_toxic_substance", F.when(F.col("_at").isNotNull(), F.lit(True)).when(
        statutory, F.lit(False))).withColumn("toxic_substance_basis", F.when(
            F.col("_at").isNotNull(), F.concat(F.lit(opening), F.col("_at").cast("string"), F.lit(middle),
                                               F.col("_label"), F.lit(closing))).when(
            statutory, F.lit(C.NOT_TOXIC_BASIS)).otherwise("")).drop("_at", "_label")


def orphans(synonyms: DataFrame, terms: DataFrame) -> DataFrame:
    """Synonyms that point at no existing code."""
    return synonyms.withColumn("code", code_of()).join(terms.select("code").distinct(), "code", "left_anti")
