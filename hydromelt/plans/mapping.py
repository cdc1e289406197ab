"""Directory mapping, mapping rounds, organisation mapping and growth reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt.operators import headers, lexicon, matching, melt, review, summaries
from hydromelt.session import stage
from hydromelt.sources import dictionaries, files, sinks


@dataclass
class MappedFolder:
    """Tables of one mapping job."""

    cells: DataFrame
    data: DataFrame
    columns: DataFrame
    summaries: DataFrame
    lexicon: DataFrame


def load_lexicon(spark: SparkSession, dictionary_dir: str) -> DataFrame:
    measurement, metadata = dictionaries.dictionary_paths(dictionary_dir)
    return lexicon.build_lexicon(dictionaries.read_flat_terms(spark, measurement),
                                 dictionaries.read_flat_terms(spark, metadata))


def file_facts(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Name, stem, encoding, header row and raggedness per file."""
    facts = cells.where("row_idx >= 0").groupBy("file_id").agg(
        F.max("encoding").alias("encoding_detected"), F.bool_or("ragged").alias("ragged"))
    name = F.regexp_extract("file_id", r"([^/]+)$", 1)
    return facts.join(header_rows.select("file_id", "header_row"), "file_id").withColumn(
        "filename", name).withColumn("stem", F.regexp_replace("filename", r"\.[^.]*$", ""))


def map_grid(cells: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns with their mapping, data rows) of a cell grid."""
    tops = headers.header_rows(cells.where("row_idx >= 0"))
    columns = headers.file_columns(cells, tops)
    # Staged: name matching runs Python once per distinct name.
    names = stage(matching.map_names(columns, entries), "names")
    mapped = matching.map_columns(columns, names).join(file_facts(cells, tops), "file_id")
    return headers.unique_output_names(mapped), headers.data_rows(cells, tops)


def map_folder(spark: SparkSession, folder: str, dictionary_dir: str) -> MappedFolder:
    """Read and map every data file of a folder.

    The parsed cells are written once: headers, names, previews and the melt all
    read that table, and prune to the rows they need.
    """
    entries = stage(load_lexicon(spark, dictionary_dir), "lexicon")
    cells = stage(files.read_folder(spark, folder), "cells")
    columns, data = map_grid(cells, entries)
    columns = stage(columns, "columns")
    return MappedFolder(cells, data, columns, summaries.mapping_summary(columns), entries)


def value_summaries(mapped: MappedFolder, samples: int = 12) -> DataFrame:
    """Value summaries of the undecided columns."""
    return melt.value_summaries(melt.undecided_cells(mapped.data, mapped.columns), ["file_id", "column_index"], samples=samples)


def run(spark: SparkSession, folder: str, dictionary_dir: str, output: str) -> MappedFolder:
    """Map a folder and write the mapped files, the report and the review queue."""
    mapped = map_folder(spark, folder, dictionary_dir)
    sinks.write_mapped_files(mapped.data, mapped.columns, f"{output}/mapped")
    sinks.write_report(sinks.file_reports(mapped.columns, mapped.summaries), f"{output}/report")
    overall(mapped.columns).write.mode("overwrite").json(f"{output}/report_summary")
    sinks.write_csv(review.review_queue(mapped.columns), f"{output}/review_queue")
    return mapped


def overall(columns: DataFrame) -> DataFrame:
    """Totals over all files."""
    files_seen = columns.agg(F.count_distinct("file_id").alias("files"))
    totals = summaries.mapping_rollup(columns).where("is_total = 1").drop("file_id", "is_total")
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(files_seen).join(one(totals), "_one").drop("_one")


def mapping_round(columns: DataFrame, items: DataFrame, terms: DataFrame, runs: DataFrame,
                  files_table: DataFrame, held: DataFrame | None = None) -> dict[str, DataFrame]:
    """A new mapping round over all files: verdicts carried over, counts, new queue items.

    Status becomes reviewing while any item is open, else completed. With ``held``, the value summaries of undecided
    columns, new items carry theirs.
    """
    carried = review.carry_over(columns, items, terms)
    rounds = summaries.next_round(runs, files_table)
    counted = summaries.mapping_summary(carried).join(rounds, "file_id")
    fresh = review.new_items(carried)
    if held is not None:
        fresh = review.with_summaries(fresh, held)
    open_before = items.where("verdict is null").groupBy("file_id").agg(F.count("*").alias("before"))
    open_now = fresh.groupBy("file_id").agg(F.count("*").alias("now"))
    status = counted.select("file_id").join(open_before, "file_id", "left").join(open_now, "file_id", "left").select(
        "file_id", F.when(F.coalesce("before", F.lit(0)) + F.coalesce("now", F.lit(0)) > 0, "reviewing")
        .otherwise("completed").alias("status"))
    return {"columns": carried, "runs": counted, "new_items": fresh, "status": status}


def map_for_organisation(columns: DataFrame, entries: DataFrame, org_terms: DataFrame) -> DataFrame:
    """Map (organization_id, column_index, raw) columns, own aliases first."""
    shared = matching.map_columns(columns, matching.map_names(columns, entries))
    return matching.organisation_override(shared, org_terms)


def growth(spark: SparkSession, folder: str, before: str, after: str) -> DataFrame:
    """Auto-mapping rate per file under two dictionary states."""
    cells = stage(files.read_folder(spark, folder), "cells")
    rounds = []
    for number, place in ((1, before), (2, after)):
        columns, _ = map_grid(cells, load_lexicon(spark, place))
        rounds.append(summaries.mapping_summary(columns, ("filename",)).withColumn("round_no", F.lit(number)))
    return summaries.round_growth(rounds[0].unionByName(rounds[1]))
