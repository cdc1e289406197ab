"""Dictionary, limit and standard-term files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt import schemas
from hydromelt.functions import values
from hydromelt.operators.standards import typed_limits
from hydromelt.session import stage
from hydromelt.sources import files as source_files


class HeaderNotFound(ValueError):
    """A needed column is missing."""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of texts in file order, blanks for nulls, any known encoding.

    The file is parsed once, a large one split over tasks.
    """
    cells = stage(source_files.read_folder(spark, path), "table")
    head = cells.where("row_idx <= 0").orderBy("row_idx").take(1)
    if not head or head[0]["cells"] is None:
        raise ValueError(f"{path}: no known encoding fits")
    return cells.where("row_idx > 0").select((F.col("row_idx") - 1).alias("row_no"), *[
        F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(name)
        for i, name in enumerate(head[0]["cells"]) if name])


def read_flat_terms(spark: SparkSession, path: str) -> DataFrame:
    """Flat dictionary rows; a file without a ``code`` column is refused."""
    table = read_table(spark, path)
    if "code" not in table.columns:
        raise HeaderNotFound(f"{path}: no 'code' column")
    for name in ("name_ko", "name_en", "abbr", "synonyms"):
        if name not in table.columns:
            table = table.withColumn(name, F.lit(""))
    return table.where(values.strip(F.col("code")) != "")


def read_limits(spark: SparkSession, path: str) -> DataFrame:
    """Legal limits by column position; a header line is skipped."""
    raw = spark.read.schema(schemas.LIMITS_CSV).option("header", True).option("enforceSchema", True).csv(path)
    return typed_limits(raw)


def pick_column(columns: list[str], must: str, avoid: tuple[str, ...] = (C.ENGLISH_HEADER_MARK,)) -> str:
    """The first column whose name holds ``must`` and nothing to avoid."""
    for name in columns:
        if must in name and not any(word in name for word in avoid):
            return name
    raise HeaderNotFound(f"no column with {must!r} in {columns}")


def _any_column(columns: list[str], *parts: str) -> str | None:
    return next((c for c in columns if any(p in c for p in parts)), None)


def _optional(table: DataFrame, *parts: str) -> Column:
    found = _any_column(table.columns, *parts)
    return F.col(f"`{found}`") if found else F.lit("")


def read_standard_terms(spark: SparkSession, path: str) -> DataFrame:
    """National standard terms: row_no, term_name, description, synonyms."""
    table, heads = read_table(spark, path), C.TERM_HEADERS
    return table.select(
        "row_no", F.col(f"`{pick_column(table.columns, heads['term_name'])}`").alias("term_name"),
        *[_optional(table, heads[c]).alias(c) for c in ("description", "synonyms")])


def read_standard_words(spark: SparkSession, path: str) -> DataFrame:
    """National standard words: row_no, word, abbr, revision, description."""
    table, heads = read_table(spark, path), C.WORD_HEADERS
    return table.select(
        "row_no", F.col(f"`{pick_column(table.columns, heads['word'])}`").alias("word"),
        *[_optional(table, heads[c]).alias(c) for c in ("abbr", "revision")],
        _optional(table, *C.WORD_DESCRIPTION_HEADERS).alias("description"))


def dictionary_hash(spark: SparkSession, measurement_path: str, metadata_path: str) -> str:
    """First 16 hex digits of the SHA-256 over both files' bytes, measurement first."""
    part = lambda p: spark.read.format("binaryFile").load(p).select("content", F.lit(1).alias("_one"))
    both = part(measurement_path).withColumnRenamed("content", "a").join(
        part(metadata_path).withColumnRenamed("content", "b"), "_one")
    return both.select(F.left(F.sha2(F.concat("a", "b"), 256), F.lit(16)).alias("h")).first()["h"]


def version_name(day: date) -> str:
    return f"dict-{day.isoformat()}"


def is_stale(spark: SparkSession, stored_hash: str, measurement_path: str, metadata_path: str) -> bool:
    """Whether the dictionary files changed since a version was stamped."""
    return dictionary_hash(spark, measurement_path, metadata_path) != stored_hash


def dictionary_paths(folder: str) -> tuple[str, str]:
    return tuple(f"{folder.rstrip('/')}/{name}" for name in C.DICT_FILES.values())
