"""Paged results."""

from __future__ import annotations

import bisect
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Where Spark's increasing ids hold a partition's number.
_PARTITION = 33


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page in a total order; page and size are at least 1, and any larger size is honoured."""
    number, size = max(1, number), max(1, size)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, int]:
    """A page and the number of rows over all pages."""
    return page(df, order, number, size), df.count()


class PageIndex:
    """A result stored in its order, so that any page costs as much as the first.

    Rows are dealt and sorted by range; each range is a folder, and the number of rows before it is known. A page reads the
    one or two ranges it lies in.
    """

    def __init__(self, spark: SparkSession, path: str):
        schema = spark.read.text(f"{path}/schema", wholetext=True).first()["value"]
        self.path, self.rows = path, spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/rows")
        ranges = spark.read.parquet(f"{path}/ranges").orderBy("range").collect()  # as many as ranges
        self.ranges = [r["range"] for r in ranges]
        self.ends = [0]
        for r in ranges:
            self.ends.append(self.ends[-1] + r["n"])
        self.firsts = [r["first"] for r in ranges]

    @classmethod
    def build(cls, df: DataFrame, order: list[Column], path: str) -> PageIndex:
        """Sorts and stores a result under ``path``; ``order`` must be total."""
        spot = F.monotonically_increasing_id()
        dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_spot", spot)
        dealt = dealt.withColumn("range", F.shiftright("_spot", _PARTITION))
        dealt.write.partitionBy("range").parquet(f"{path}/rows")
        spark = df.sparkSession
        spark.createDataFrame([(dealt.schema.json(),)], "value string").write.text(f"{path}/schema")
        spark.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy("range").agg(
            F.count(F.lit(1)).alias("n"), F.min("_spot").alias("first")).write.parquet(f"{path}/ranges")
        return cls(spark, path)

    @property
    def total(self) -> int:
        return self.ends[-1]

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        """One page in order; page and size are at least 1."""
        number, size = max(1, number), max(1, size)
        begin = min((number - 1) * size, self.total)
        end = min(begin + size, self.total)
        low, high = bisect.bisect_right(self.ends, begin) - 1, bisect.bisect_left(self.ends, end)
        spots = [(self.ranges[k], self.firsts[k] + max(0, begin - self.ends[k]), self.firsts[k] + min(end, self.ends[k + 1]) - self.ends[k])
                 for k in range(low, high)]
        inside = F.lit(False)
        for which, first, last in spots:
            inside = inside | ((F.col("range") == which) & (F.col("_spot") >= first) & (F.col("_spot") < last))
        rows = self.rows.where(F.col("range").isin([which for which, _, _ in spots])).where(inside)
        return rows.orderBy("_spot").drop("_spot", "range")
