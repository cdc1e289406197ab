"""Jobs that grow, export and verify the dictionary."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.operators import lexicon, review
from hydromelt.session import stage
from hydromelt.sources import dictionaries, sinks


def both_dictionaries(measurement: DataFrame, metadata: DataFrame) -> DataFrame:
    """Flat terms of both dictionaries with the file they come from."""
    shared = ["row_no", "code", "name_ko", "name_en", "abbr", "synonyms"]
    return measurement.select(*shared, F.lit(C.DICT_FILES["measurement"]).alias("dict_file")).unionByName(
        metadata.select(*shared, F.lit(C.DICT_FILES["metadata"]).alias("dict_file")))


def apply_review(spark: SparkSession, queue_path: str, dictionary_dir: str, output_dir: str,
                 at: datetime) -> DataFrame:
    """Write dictionaries grown by a filled review queue, and the log of what was added. Running it again adds no line twice."""
    measurement, metadata = (dictionaries.read_flat_terms(spark, p)
                             for p in dictionaries.dictionary_paths(dictionary_dir))
    queue = dictionaries.read_table(spark, queue_path)
    accepted = stage(review.accepted_spellings(queue, both_dictionaries(measurement, metadata)), "accepted")
    for kind, terms in (("measurement", measurement), ("metadata", metadata)):
        own = accepted.where(F.col("dict_file") == C.DICT_FILES[kind])
        grown = review.extend_terms(terms, own)
        sinks.write_csv(grown.orderBy("row_no").coalesce(1).drop("row_no"), f"{output_dir}/{C.DICT_FILES[kind]}")
    log = review.review_log(accepted, F.lit(at.isoformat(timespec="seconds")))
    sinks.append_log(log, f"{output_dir}/review_log.csv", queue_key(queue))
    return log


def queue_key(queue: DataFrame) -> str:
    """A key of a queue's lines, in whatever order they are read."""
    line = F.xxhash64(*[F.col(f"`{c}`") for c in queue.columns]).cast("decimal(20,0)")
    found = queue.agg(F.count("*").alias("n"), F.sum(line).alias("lines")).first()
    return f"{found['n']:x}-{int(found['lines'] or 0) % (1 << 64):016x}"


def import_review_log(log: DataFrame, synonyms: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grown synonyms, sources including the review source)."""
    added = review.log_synonyms(log, synonyms)
    shared = [c for c in synonyms.columns if c in added.columns]
    grown = synonyms.unionByName(added.select(*shared), allowMissingColumns=True)
    own = sources.sparkSession.createDataFrame([C.REVIEW_SOURCE]).select(*[
        c for c in sources.columns if c in C.REVIEW_SOURCE])
    missing = own.join(sources.select("source_id"), "source_id", "left_anti")
    return grown, sources.unionByName(missing, allowMissingColumns=True)


def export_flat(measurement: DataFrame, metadata: DataFrame, synonyms: DataFrame, sources: DataFrame,
                exclude_inferred: bool = False) -> tuple[DataFrame, DataFrame]:
    """Flat dictionaries of both kinds; a spelling with two codes is an error."""
    collected = lexicon.collect_synonyms(synonyms, sources, exclude_inferred)
    flat = (lexicon.flat_terms(measurement, collected, "measurement"),
            lexicon.flat_terms(metadata, collected, "metadata"))
    lexicon.build_lexicon(*flat)
    return flat


def version_stamp(measurement: DataFrame, metadata: DataFrame, content_hash: str, day: date,
                  exclude_inferred: bool = False, note: str = "") -> dict:
    """The version document of a dictionary state."""
    counts = lexicon.version_counts(measurement, metadata).first().asDict()
    stamp = {"version": dictionaries.version_name(day), "content_hash": content_hash,
             "generated_at": day.isoformat(), "counts": counts, "excluded_inferred": exclude_inferred}
    return {**stamp, "note": note} if note else stamp


def load_version(spark: SparkSession, path: str) -> dict:
    """A stored version document; absent counts are zero."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise FileNotFoundError(path)
    stored = json.loads(text["value"])
    counts = {k: stored.get("counts", {}).get(k, 0)
              for k in ("measurement_terms", "metadata_terms", "synonyms", "verified_terms")}
    return {**stored, "counts": counts, "excluded_inferred": stored.get("excluded_inferred", False)}


def hand_over(items: DataFrame, files: DataFrame, path: str, at: datetime, since=None,
              include_exported: bool = False, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Export decided items as a review queue; returns (queue lines, items after the export)."""
    chosen = review.export_candidates(items, files, None if since is None else F.lit(since), include_exported)
    lines = chosen.orderBy("reviewed_at", "id")
    if dry_run:
        return review.queue_rows(lines), items
    sinks.write_csv(review.queue_rows(lines), path)
    return review.queue_rows(lines), review.mark_exported(items, chosen, F.lit(at))
