"""Ranking helpers that hold up when one group is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydromelt import config as C


def first_per(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row per key.

    Spark limits each map task to one row per key before the shuffle, so a hot
    key reaches its window task already reduced.
    """
    return top_per(df, keys, order, 1, "_rank").drop("_rank")


def top_per(df: DataFrame, keys: list, order: list[Column], k: int, name: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def running_number(df: DataFrame, keys: list[str], position: str, name: str,
                   chunk: int = C.NUMBERING_CHUNK) -> DataFrame:
    """Number rows 1, 2, … per key in order of an integer position.

    Positions are numbered in chunks and shifted by the rows of earlier chunks,
    so no task ever sorts more than one chunk of a group.
    """
    part = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    sizes = part.groupBy(*keys, "_chunk").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         F.col("_chunk").alias("_kc"),
                         F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(position))
    same = F.col("_chunk") == F.col("_kc")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    return (part.withColumn("_local", local).join(shift, same)
            .withColumn(name, F.col("_local") + F.col("_shift"))
            .drop("_chunk", "_kc", "_shift", "_local", *[f"_k{i}" for i in range(len(keys))]))
