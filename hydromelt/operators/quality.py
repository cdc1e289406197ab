"""Data-quality rules. Each rule returns (rule, subject, detail) rows of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import names
from hydromelt.operators.lexicon import code_of, orphans


def _report(rule: str, found: DataFrame, subject: Column, detail: Column) -> DataFrame:
    return found.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"),
                        detail.cast("string").alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated(df: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) > 1)


def mixed_rounds(measurements: DataFrame) -> DataFrame:
    """Files whose measurements stem from several mapping runs."""
    return measurements.groupBy("file_id").agg(
        F.count("*").alias("measurement_count"),
        F.count_distinct("mapping_run_id").alias("mapping_run_count")).where("mapping_run_count > 1")


def duplicate_measurements(measurements: DataFrame) -> DataFrame:
    return repeated(measurements, ["file_id", "source_row", "source_column_index"], "duplicate_count")


def duplicate_ingestions(ingestion_runs: DataFrame) -> DataFrame:
    return repeated(ingestion_runs, ["file_id"], "ingestion_run_count")


def duplicate_reviews(items: DataFrame) -> DataFrame:
    return repeated(items, ["file_id", "column_index", "raw"], "review_count")


def limit_sources(limits: DataFrame) -> DataFrame:
    return limits.groupBy("source").agg(F.count("*").alias("row_count"))


def limit_matrix(limits: DataFrame, item_codes: list[str]) -> DataFrame:
    """Regions per item and scale, to see whether the general limits are complete."""
    return limits.where(F.col("item_code").isin(item_codes)).groupBy("item_code", "scale").agg(
        F.count("*").alias("region_count"))


def dictionary_rules(measurement: DataFrame, metadata: DataFrame, synonyms: DataFrame,
                     expected: dict[str, int] | None = None) -> DataFrame:
    """Integrity of the dictionary tables."""
    terms = measurement.select("code", "std_name").unionByName(metadata.select("code", "std_name"))
    syn = synonyms.withColumn("code", code_of())
    live = syn.where(F.col("review_status") != "rejected").withColumn(
        "norm", names.wq_normalize(F.col("surface")))
    same_name = terms.groupBy(names.wq_normalize(F.col("std_name")).alias("norm")).agg(
        F.count_distinct("code").alias("n")).where("n > 1")
    torn = live.groupBy("norm").agg(F.count_distinct("code").alias("n")).where("n > 1")
    unspelled = measurement.where(F.col("review_status") != "rejected").join(
        syn.select("code").distinct(), "code", "left_anti")
    repeats = live.groupBy("norm", "source_id", "code").agg(F.count("*").alias("n")).where("n > 1")
    unsourced = syn.where((F.coalesce("source_id", F.lit("")) == "")
                          | (F.coalesce(F.col("collected_on").cast("string"), F.lit("")) == ""))
    parts = [
        _report("orphan_synonym", orphans(synonyms, terms), F.col("surface"), F.col("code")),
        _report("duplicate_standard_name", same_name, F.col("norm"), F.col("n")),
        _report("spelling_conflict", torn, F.col("norm"), F.col("n")),
        _report("missing_source_or_date", unsourced, F.col("surface"), F.col("code")),
        _report("term_without_synonym", unspelled, F.col("code"), F.col("std_name")),
        _report("repeated_spelling_per_source", repeats, F.col("norm"), F.concat_ws("/", "source_id", "code")),
    ]
    for rule, (column, value) in {"toxic": ("is_toxic_substance", "true"),
                                  "statutory": ("legal_status", "statutory")}.items():
        if expected and rule in expected and column in measurement.columns:
            total = measurement.agg(F.count_if(F.lower(F.col(column).cast("string")) == value).alias("n"))
            parts.append(_report(f"expected_{rule}_terms", total.where(F.col("n") != expected[rule]),
                                 F.lit(str(expected[rule])), F.col("n")))
    return _union(parts)


def column_rules(df: DataFrame, key: str, closed: dict[str, tuple[str, ...]],
                 patterns: dict[str, str] | None = None, nullable: tuple[str, ...] = ()) -> DataFrame:
    """Values outside closed lists or patterns, from one pass over the table."""
    checks = []
    for column, allowed in closed.items():
        bad = ~F.col(column).isin(*allowed)
        checks.append((f"closed_list:{column}", column, bad if column in nullable else F.coalesce(bad, F.lit(True))))
    for column, pattern in (patterns or {}).items():
        checks.append((f"pattern:{column}", column, ~F.coalesce(F.col(column).rlike(pattern), F.lit(False))))
    found = F.array_compact(F.array(*[F.when(bad, F.struct(
        F.lit(rule).alias("rule"), F.col(column).cast("string").alias("detail"))) for rule, column, bad in checks]))
    return df.select(F.col(key).cast("string").alias("subject"), F.explode(found).alias("v")).select(
        "v.rule", "subject", "v.detail")


def one_parent(synonyms: DataFrame, key: str = "surface") -> DataFrame:
    """Synonyms that name no code, or a code of both dictionaries."""
    parents = sum((F.when(F.coalesce(F.nullif(c, F.lit("")), F.lit("")) != "", 1).otherwise(0)
                   for c in ("measurement_code", "metadata_code")), F.lit(0))
    return _report("exactly_one_parent", synonyms.where(parents != 1), F.col(key), parents)


def term_enums(measurement: DataFrame) -> DataFrame:
    return column_rules(measurement, "code", {"legal_status": C.LEGAL_STATUSES, "review_status": C.REVIEW_STATUSES},
                        {"code": r"^WQ-[0-9]{3}$"})


def metadata_enums(metadata: DataFrame) -> DataFrame:
    return column_rules(metadata, "code", {"value_type": C.VALUE_TYPES, "facet": C.FACETS,
                                           "review_status": C.REVIEW_STATUSES}, {"code": r"^MD-[0-9]{3}$"})


def rate_regressions(summaries: DataFrame, expected: DataFrame, key: str = "filename") -> DataFrame:
    """Files mapped at a lower rate than expected of them."""
    return summaries.join(expected, key).where(F.col("auto_mapped_rate") < F.col("expected_rate"))


def remaining_rows(inventory: DataFrame, owner: int) -> DataFrame:
    """What is left of an owner after a purge; empty when the purge is whole."""
    return inventory.where((F.col("owner_user_id") == owner) & (F.col("n") > 0))


def flag_counts(measurements: DataFrame) -> DataFrame:
    """Flagged values per item and flag.

    Counted in one pass; filtering on the flag first would make Spark parse
    every cell once more for the filter.
    """
    flags = ("non_numeric", "future_date", "negative")
    counted = measurements.groupBy("item_code").agg(*[
        F.count_if(F.col("quality_flag") == flag).alias(flag) for flag in flags])
    return counted.select("item_code", F.explode(F.array(*[
        F.struct(F.lit(flag).alias("quality_flag"), F.col(flag).alias("n")) for flag in flags])).alias("f")).select(
        "item_code", "f.*").where("n > 0")
