"""Whitening of embeddings along their leading principal components.

Vectors become whole numbers, so that counts and sums over them are exact. The covariance of the distinct vectors is summed
by Spark, its leading eigenvectors come from contour integration (``feast``), and each row is projected onto them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import session
from hydromelt.llm import feast
from hydromelt.llm.common import table

#: Steps of one unit, and components returned.
STEPS = 256
COMPONENTS = 4
#: Share of the whole variance under which a component counts as having none.
FLAT = 1e-12
#: Numbers handled at once in a task.
CELLS = 1 << 21
_LOW = 0xFFFFFFFF


def whole_numbers(vector: str, steps: int = STEPS) -> Column:
    """The vector's entries as whole steps, rounded down; beyond a long's range the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * steps))


def usable(vector: str) -> Column:
    """Whether a vector has entries, and only finite ones."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches whose lists have one length, with the lists as a matrix."""
    for batch in batches:
        if batch.num_rows:
            width = len(batch.column(column)[0])
            for start in range(0, batch.num_rows, max(1, CELLS // width)):
                part = batch.slice(start, max(1, CELLS // width))
                yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors, and the sum of each entry, exactly: halves of the numbers are summed apart."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for part, x in matrices(batches, "x"):
            n, high, low = n + part.num_rows, high + (x >> 32).sum(axis=0), low + (x & _LOW).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)],
            ["entry", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(partial, "entry int, n long, high long, low long")
    rows = parts.groupBy("entry").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]).orderBy(
        "entry").collect()  # one per entry of a vector
    return int(rows[0]["n"] or 0) if rows else 0, [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the fitted vectors, divisor n, centred before multiplying. Each task sums its own vectors' products."""
    centre = np.array([s / n for s in sums])
    width = len(centre)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in matrices(batches, "x"):
            away = x - centre
            total += away.T @ away
        for row in range(width):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width, row, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(total[row])],
                ["i", "j", "product"])

    parts = fit.select("x").mapInArrow(partial, "i int, j int, product double")
    found = parts.groupBy("i", "j").agg(F.sum("product").alias("product")).toPandas()  # width x width
    matrix = np.zeros((width, width))
    matrix[found["i"], found["j"]] = found["product"] / n
    return (matrix + matrix.T) / 2


@dataclass(frozen=True)
class Whitening:
    """What is fitted: count and sums of the distinct vectors, eigenvalues, eigenvectors as columns, and whole variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    variance: float

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Rows with the list ``x`` get ``whitened``, an array of one number per component, and ``deviation``."""
        centre = np.array([s / self.n for s in self.sums])
        turn = self.vectors / np.sqrt(self.values)
        sums, n = self.sums, self.n
        exact_sums_ = np.array(sums, object)
        most = max(map(abs, sums), default=0)
        small = np.array(sums, np.int64) if most < 1 << 62 else None

        def deviations(x: np.ndarray) -> list[int | None]:
            away = float(np.abs(x).max(initial=0)) * n + most
            if small is not None and away < 1 << 62 and away * away * x.shape[1] < 1 << 62:
                return ((n * x - small) ** 2).sum(axis=1).tolist()
            exact = ((n * x.astype(object) - exact_sums_) ** 2).sum(axis=1).tolist()
            return [d if d < 1 << 63 else None for d in exact]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in matrices(batches, "x"):
                found = (x - centre) @ turn
                whitened = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1], found.ravel())
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), whitened, pa.array(deviations(x), pa.int64())],
                                                 [*keep, "whitened", "deviation"])

        kinds = [f"`{name}` {df.schema[name].dataType.simpleString()}" for name in keep]
        return df.select(*keep, "x").mapInArrow(run, ", ".join([*kinds, "whitened array<double>", "deviation long"]))


def usable_rows(df: DataFrame, id_col: str, vector_col: str, steps: int = STEPS) -> DataFrame:
    """``id`` and ``x`` of the rows that take part: those usable and of the most common length (the longer of two)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable("vector"))
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = width["width"] if width else 0
    return rows.where(F.size("vector") == width).select("id", whole_numbers("vector", steps).alias("x"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of some rows' distinct ``x`` vectors, and the stored table of these."""
    distinct = session.stage(rows.select("x").distinct(), "whitening-fit")
    first = distinct.first()
    width = len(first["x"]) if first else 0
    n, sums = exact_sums(distinct, width)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0), distinct
    matrix = covariance(distinct, n, sums)
    variance = float(np.trace(matrix))
    values, vectors = feast.leading(rows.sparkSession, matrix, components)
    varied = values > FLAT * variance
    return Whitening(n, sums, values[varied], vectors[:, varied], variance), distinct


def identity_error(fitted: Whitening, distinct: DataFrame) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the fitted vectors."""
    size = len(fitted.values)
    if not size:
        return 0.0
    rows = session.stage(fitted.apply(distinct, []).select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(size)]), "whitened-fit")
    means = rows.agg(*[F.avg(c).alias(c) for c in rows.columns]).first()
    away = [F.col(c) - F.lit(means[c]) for c in rows.columns]
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    found = rows.agg(*[F.avg(away[i] * away[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows drop out whose vector is null, empty, holds null or non-finite entries, or hasn't the most common length. Each of the
    rest comes back, repeated rows and null ids too; they are fitted once per distinct vector. Components are numbered from
    1 by falling variance; those without variance (all vectors equal, say) are left out. Of components with
    equal variance any orthonormal choice holds, the same for all rows. ``deviation`` is null where it exceeds a long.
    Other columns are ignored, and an empty table gives no rows.
    """
    rows = usable_rows(df, id_col, vector_col)
    fitted, distinct = fit(rows, components)
    schema = f"vec_id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, " \
             "explained double, identity_error double"
    if not len(fitted.values):
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(fitted, distinct)
    share = F.array(*[F.lit(float(v) / fitted.variance) for v in fitted.values])
    return fitted.apply(rows, ["id"]).select(
        F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along their four leading components."""
    return whiten(table(spark, sf_dir, "embeddings"))
