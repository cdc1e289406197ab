"""Review queue: open items, verdicts, carry-over, export and dictionary growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C, schemas
from hydromelt.functions import names, values
from hydromelt.operators.numbering import first_per
from hydromelt.session import stage


class ReviewRequestError(ValueError):
    """A review listing or verdict is not acceptable."""


def listing(items: DataFrame, status: str = "pending", file_id=None) -> DataFrame:
    """Pending or all review items, optionally of one file."""
    if status.lower() not in ("pending", "all"):
        raise ReviewRequestError(f"status must be pending or all, not {status!r}")
    found = items.where("verdict is null") if status.lower() == "pending" else items
    return found if file_id is None else found.where(F.col("file_id") == file_id)


def review_queue(columns: DataFrame) -> DataFrame:
    """Columns a person must decide; unmapped ones suggest nothing."""
    asks = F.col("status") == "needs_review"
    return columns.where(F.col("status").isin(*C.HUMAN_STATUSES)).select(
        F.col("raw").alias("원본명"), F.col("filename").alias("출처파일"),
        F.when(asks, F.col("candidate_code")).otherwise("").alias("후보 표준코드"),
        F.when(asks, F.col("score").cast("string")).otherwise("").alias("점수"),
        F.lit("").alias("사람판정"), F.lit("").alias("판정자"))


def latest_items(items: DataFrame) -> DataFrame:
    """Newest review item per file column and name."""
    return first_per(items, ["file_id", "column_index", "raw"], [F.col("created_at").desc(), F.col("id").desc()])


def decided_first(items: DataFrame) -> DataFrame:
    """One item per file, name and column: decided ones before open ones, newest first."""
    return first_per(items, ["file_id", "raw", "column_index"],
                     [F.col("verdict").isNotNull().desc(), F.col("id").desc()])


def carry_over(columns: DataFrame, items: DataFrame, terms: DataFrame) -> DataFrame:
    """New mapping columns with the codes earlier verdicts adopted.

    ``terms``: code, name, dict_type. ``had_review`` tells whether the column was
    in the queue before.
    """
    earlier = latest_items(items).select(
        "file_id", "column_index", "raw", F.lit(True).alias("had_review"),
        values.adopted_code(F.col("verdict"), F.col("candidate_code")).alias("_code"))
    names_of = terms.select(F.col("code").alias("_term"), F.col("name").alias("_name"),
                            F.col("dict_type").alias("_type"))
    joined = (columns.join(earlier, ["file_id", "column_index", "raw"], "left")
              .join(names_of, F.col("_code") == F.col("_term"), "left"))
    taken = F.col("_code").isNotNull()

    def pick(new: Column, old: str) -> Column:
        return F.when(taken, new).otherwise(F.col(old)).alias(old)

    changed = {
        "status": pick(F.lit("exact"), "status"), "via": pick(F.lit("review"), "via"),
        "code": pick(F.col("_code"), "code"),
        "candidate_code": pick(F.lit(None).cast("string"), "candidate_code"),
        "matched_variant": pick(F.col("_name"), "matched_variant"),
        "score": pick(F.lit(None), "score"),
        "dict_type": pick(F.coalesce("_type", values.dict_type_of(F.col("_code"))), "dict_type"),
        "output_column": pick(values.output_column(F.lit("exact"), F.col("_code"), F.col("site"), F.col("raw")),
                              "output_column")}
    return joined.select(*[changed.get(c, F.col(c)) for c in columns.columns],
                         F.coalesce("had_review", F.lit(False)).alias("had_review"))


def new_items(carried: DataFrame) -> DataFrame:
    """Columns that enter the queue now: undecided and never queued before."""
    return carried.where(F.col("status").isin(*C.HUMAN_STATUSES) & ~F.col("had_review"))


def with_summaries(items: DataFrame, summaries: DataFrame) -> DataFrame:
    """Queue items with what their columns hold, as the JSON text that is stored."""
    text = F.to_json(F.struct("row_count", "distinct_count", "samples", "all_unique"))
    held = summaries.select("file_id", "column_index", text.alias("value_summary"))
    return items.join(held, ["file_id", "column_index"], "left")


def stored_summary(text: Column) -> Column:
    """A stored summary read back; null where there is none or it can't be read."""
    return values.json_or(text, schemas.VALUE_SUMMARY, F.lit(None).cast(schemas.VALUE_SUMMARY))


def apply_verdicts(items: DataFrame, verdicts: DataFrame, terms: DataFrame) -> DataFrame:
    """Review items with a batch of verdicts (id, verdict, note, reviewer, decided_at) written.

    ``rejected_because`` names verdicts that cannot be taken: an accept without
    candidate, or a code no dictionary knows; those items stay as they were.
    """
    asked = verdicts.select("id", F.col("verdict").alias("_asked"), F.col("note").alias("_note"),
                            F.col("reviewer").alias("_by"), F.col("decided_at").alias("_at"))
    known = terms.select(F.col("code").alias("_known")).distinct()
    canon = values.canonical_verdict(F.col("_asked"), F.col("candidate_code"))
    accepts = F.lower(values.strip(F.col("_asked"))).isin(*C.DECISION_ACCEPT_WORDS)
    part = (items.join(asked, "id", "left").withColumn("_canon", canon)
            .join(known, F.col("_canon") == F.col("_known"), "left")
            .withColumn("rejected_because", F.when(F.col("_asked").isNull(), F.lit(None))
                        .when(values.strip(F.col("_asked")) == "", "verdict required")
                        .when(accepts & F.col("candidate_code").isNull(), "candidate missing")
                        .when((F.col("_canon") != C.VERDICT_NO_MATCH) & F.col("_known").isNull(), "code unknown")))
    taken = F.col("_asked").isNotNull() & F.col("rejected_because").isNull()
    by = F.coalesce(values.blank_to_null(F.col("_by")), F.lit(C.UNKNOWN_REVIEWER))
    changed = {"verdict": F.when(taken, F.col("_canon")).otherwise(F.col("verdict")).alias("verdict"),
               "verdict_note": F.when(taken, F.col("_note")).otherwise(F.col("verdict_note")).alias("verdict_note"),
               "reviewed_by": F.when(taken, by).otherwise(F.col("reviewed_by")).alias("reviewed_by"),
               "reviewed_at": F.when(taken, F.col("_at")).otherwise(F.col("reviewed_at")).alias("reviewed_at")}
    return part.select(*[changed.get(c, F.col(c)) for c in items.columns], "rejected_because")


def export_candidates(items: DataFrame, files: DataFrame, since: Column | None = None,
                      include_exported: bool = False) -> DataFrame:
    """Decided items to hand over, with their file names; refusals are left out."""
    found = items.where(F.col("verdict").isNotNull()
                        & ~F.col("verdict").isin(C.VERDICT_REJECT, C.VERDICT_NO_MATCH))
    if not include_exported:
        found = found.where("exported_at is null")
    if since is not None:
        found = found.where(F.col("reviewed_at") >= since)
    return found.join(files.select("file_id", "original_filename"), "file_id")


def queue_rows(exported: DataFrame) -> DataFrame:
    """Handed-over verdicts in review-queue form."""
    return exported.select(
        F.col("raw").alias("원본명"), F.col("original_filename").alias("출처파일"),
        F.coalesce("candidate_code", F.lit("")).alias("후보 표준코드"),
        F.coalesce(F.col("score").cast("string"), F.lit("")).alias("점수"),
        F.col("verdict").alias("사람판정"), F.coalesce("reviewed_by", F.lit("")).alias("판정자"))


def mark_exported(items: DataFrame, exported: DataFrame, at: Column) -> DataFrame:
    """Items with the hand-over time set on exported ones."""
    done = exported.select("id", F.lit(True).alias("_done"))
    return items.join(done, "id", "left").withColumn(
        "exported_at", F.when(F.col("_done"), at).otherwise(F.col("exported_at"))).drop("_done")


def repaired_status(files: DataFrame, runs: DataFrame, items: DataFrame) -> DataFrame:
    """Files stuck in reviewing although mapped and without open items become completed."""
    mapped = runs.select("file_id").distinct().withColumn("_mapped", F.lit(True))
    open_items = items.where("verdict is null").select("file_id").distinct().withColumn("_open", F.lit(True))
    fixable = (F.col("status") == "reviewing") & F.col("_mapped").isNotNull() & F.col("_open").isNull()
    return (files.join(mapped, "file_id", "left").join(open_items, "file_id", "left")
            .withColumn("status", F.when(fixable, "completed").otherwise(F.col("status"))).drop("_mapped", "_open"))


# --- dictionary growth -------------------------------------------------------

def accepted_spellings(queue: DataFrame, terms: DataFrame) -> DataFrame:
    """New spellings a filled queue adds to the dictionary.

    queue: the six queue columns plus ``row_no``; terms: flat terms of both
    dictionaries with ``dict_file``. A spelling whose key its term already has,
    or an earlier queue line adds, is skipped; unknown codes are skipped.
    """
    asked = queue.select(
        "row_no", values.strip(F.col("원본명")).alias("synonym"),
        values.queue_code(F.coalesce("사람판정", F.lit("")), F.coalesce("후보 표준코드", F.lit(""))).alias("code"),
        values.strip(F.coalesce("출처파일", F.lit(""))).alias("source"),
        values.strip(F.coalesce("판정자", F.lit(""))).alias("reviewer")).where("code is not null")
    heads = terms.groupBy("code").agg(F.min("dict_file").alias("dict_file"))
    known = asked.join(heads, "code")
    have = terms.select("code", F.explode(F.concat(
        F.array("name_ko", "name_en", "abbr"), F.split(F.coalesce("synonyms", F.lit("")), r"\|"))).alias("text")).where(
        F.coalesce(values.strip(F.col("text")), F.lit("")) != "")
    forms = known.select(F.col("synonym").alias("text")).unionByName(have.select("text")).distinct().withColumn(
        "body", names.normalize_name("text")["body"])
    taken = have.join(forms, "text").select("code", "body").distinct()
    fresh = known.join(forms, F.col("synonym") == F.col("text")).join(taken, ["code", "body"], "left_anti")
    return first_per(fresh, ["code", "body"], [F.col("row_no")]).select(
        "row_no", "dict_file", "code", "synonym", "source", "reviewer")


def skipped_verdicts(queue: DataFrame, terms: DataFrame) -> DataFrame:
    """Queue lines that ask for something no dictionary can take, with the reason."""
    word = F.lower(values.strip(F.coalesce("사람판정", F.lit(""))))
    code = values.queue_code(F.coalesce("사람판정", F.lit("")), F.coalesce("후보 표준코드", F.lit("")))
    asked = queue.where((word != "") & ~word.isin(*C.QUEUE_REJECT_WORDS)).withColumn("code", code)
    known = terms.select("code", F.lit(True).alias("_known")).distinct()
    return (asked.join(known, "code", "left").where("_known is null")
            .withColumn("reason", F.when(F.col("code").isNull(), "candidate missing").otherwise("code unknown"))
            .drop("_known"))


def extend_terms(terms: DataFrame, accepted: DataFrame) -> DataFrame:
    """Flat terms with accepted spellings appended to their synonyms in queue order."""
    extra = accepted.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("row_no", "synonym"))), lambda s: s["synonym"]), "|").alias("_extra"))
    own = values.blank_to_null(F.col("synonyms"))
    return terms.join(extra, "code", "left").withColumn("synonyms", F.when(
        F.col("_extra").isNull(), F.coalesce("synonyms", F.lit(""))).otherwise(
        F.concat_ws("|", own, F.col("_extra")))).select(*terms.columns)


def review_log(accepted: DataFrame, collected_at: Column) -> DataFrame:
    return accepted.select("dict_file", "code", "synonym", "source",
                           collected_at.cast("string").alias("collected_at"), "reviewer")


def log_synonyms(log: DataFrame, synonyms: DataFrame, key=None) -> DataFrame:
    """Review-log lines to new synonym rows; known (code, spelling key) pairs are left out.

    ``log`` carries ``row_no``; the first line of a batch wins. ``key`` turns a
    text column into its key (the name normaliser by default).
    """
    key = key or (lambda c: names.normalize_name(c)["body"])
    lines = log.select("row_no", values.strip(F.col("code")).alias("code"),
                       values.strip(F.col("synonym")).alias("surface"), "collected_at", "source", "reviewer").where(
        (F.col("code") != "") & (F.col("surface") != ""))
    have = synonyms.select(F.coalesce(F.nullif("measurement_code", F.lit("")), "metadata_code").alias("code"), "surface").distinct()
    # Every spelling is turned into its key once, however many rows have it.
    keys = stage(lines.select("surface").unionByName(have.select("surface")).distinct().withColumn("_key", key(F.col("surface"))), "keys")
    lines, have = lines.join(keys, "surface"), have.join(keys, "surface").select("code", "_key").distinct()
    fresh = first_per(lines.join(have, ["code", "_key"], "left_anti"), ["code", "_key"], [F.col("row_no")])
    of = lambda prefix: F.when(F.col("code").startswith(prefix), F.col("code")).otherwise("")
    return fresh.select(
        values.term_kind_of(F.col("code")).alias("term_kind"), of(C.MEASUREMENT_PREFIX).alias("measurement_code"),
        of(C.METADATA_PREFIX).alias("metadata_code"), "surface", F.lit(C.REVIEW_SOURCE_ID).alias("source_id"),
        F.left(F.coalesce("collected_at", F.lit("")), F.lit(10)).alias("collected_on"),
        F.lit("").alias("evidence_url"),
        F.concat(F.lit(C.EVIDENCE_PREFIX), F.coalesce("source", F.lit(""))).alias("evidence_snippet"),
        F.lit("column_name").alias("synonym_type"), F.lit("verified").alias("review_status"),
        F.concat(F.lit(C.IMPORT_NOTE[0]), F.coalesce(F.nullif("reviewer", F.lit("")), F.lit(
            C.UNSTATED_REVIEWER)), F.lit(C.IMPORT_NOTE[1])).alias("note"))


def review_sheet(queue: DataFrame, summaries: DataFrame) -> DataFrame:
    """Queue lines beside what their column actually holds.

    summaries: filename, raw and the value summary columns.
    """
    joined = queue.join(summaries.select(F.col("filename").alias("출처파일"), F.col("raw").alias("원본명"),
                                         "row_count", "distinct_count", "samples", "all_unique"),
                        ["출처파일", "원본명"], "left")
    more = F.when(F.col("distinct_count") > F.size("samples"), " …").otherwise("")
    return joined.withColumn("values", F.concat(F.array_join("samples", ", "), more))
