"""Toxicity scores from a character n-gram linear classifier with naive Bayes scaled features.

A feature is the presence of a hashed character n-gram of the lower-cased text, scaled by its log-count ratio between toxic
and other training documents. Logistic regression over the telling features gives the weights; scoring reads every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt.llm.common import slices, table

SIZES = (3, 5, 7)
BUCKET_BITS = 21
#: Most labelled rows the classifier is fitted on, chosen by a hash of the id.
FIT_ROWS = 24_000
#: Most features, by strength of evidence, and the fewest training documents that must hold one.
FEATURES = 30_000
LEAST_DOCUMENTS = 4
#: Pseudo-count of the log-count ratios, ridge of the regression, its steps, and the score from which a text counts as toxic.
SMOOTH = 1.0
RIDGE = 3e-4
STEPS = 300
THRESHOLD = 0.7
#: Features that one step of the fit looks at together.
PART = 1 << 20
#: Tasks that the training rows are dealt over.
FIT_TASKS = 16


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each between line ends, and where each text begins."""
    joined = [f"\n{text.lower()}\n" for text in texts]
    starts = np.cumsum([0, *map(len, joined)])
    return np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def buckets(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Size, and the bucket of the n-gram of that size at each place it fits."""
    multiplier, spread = np.uint32(0x01000193), np.uint32(0x9E3779B1)
    hashed = np.full(len(codes), 0x811C9DC5, np.uint32)
    for n in range(1, max(SIZES) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            return
        hashed = (hashed[:size] ^ codes[n - 1:]) * multiplier
        if n in SIZES:
            mixed = (hashed ^ np.uint32(n)) * spread
            yield n, (mixed ^ (mixed >> np.uint32(15))) * multiplier >> np.uint32(32 - BUCKET_BITS)


def present(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram that ``wanted`` marks, once per text."""
    codes, starts = letters(texts)
    found = []
    for n, held in buckets(codes):
        at = np.flatnonzero(wanted[held])
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at + n <= starts[text + 1]
        found.append((text[inside] << BUCKET_BITS) | held[at[inside]].astype(np.int64))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


@dataclass(frozen=True)
class Model:
    """Weight of each telling bucket, the ratio it is scaled by already inside, and the intercept."""

    bucket: np.ndarray
    weight: np.ndarray
    intercept: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        weights = np.zeros(1 << BUCKET_BITS, np.float64)
        weights[self.bucket] = self.weight
        wanted = np.zeros(1 << BUCKET_BITS, bool)
        wanted[self.bucket] = True
        return wanted, weights

    def score(self, texts: list[str], tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        wanted, weights = tables or self.table()
        text, held = present(texts, wanted)
        total = np.bincount(text, weights=weights[held], minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def regress(offsets: np.ndarray, columns: np.ndarray, ratio: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression over present features scaled by ``ratio``: accelerated descent with a step per feature.

    Row ``i`` has the features ``columns[offsets[i]:offsets[i + 1]]``. Rows are taken in parts, so that nothing but
    ``columns`` itself is as large as the sample.
    """
    n = len(labels)
    cuts = np.unique(np.r_[np.searchsorted(offsets, np.arange(0, offsets[-1], PART), side="left"), n])
    cuts = cuts if cuts[0] == 0 else np.r_[0, cuts]
    parts = [(a, b, columns[offsets[a]:offsets[b]], np.diff(offsets[a:b + 1])) for a, b in zip(cuts, cuts[1:], strict=False)]
    weights, intercept = np.zeros(len(ratio)), math.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6))
    first, second, first_b, second_b = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        scaled, gradient, gradient_b = ratio * weights, np.zeros(len(ratio)), 0.0
        for a, b, held, sizes in parts:
            rows = np.repeat(np.arange(b - a), sizes)
            margin = np.bincount(rows, weights=scaled[held], minlength=b - a) + intercept
            error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels[a:b]) / n
            gradient += np.bincount(held, weights=error[rows], minlength=len(ratio))
            gradient_b += error.sum()
        gradient = gradient * ratio + RIDGE * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient ** 2
        first_b, second_b = 0.9 * first_b + 0.1 * gradient_b, 0.99 * second_b + 0.01 * gradient_b ** 2
        rate, fix, fix2 = 0.05 * (1 - step / (STEPS + 1)) ** 0.5, 1 - 0.9 ** step, 1 - 0.99 ** step
        weights -= rate * first / fix / (np.sqrt(second / fix2) + 1e-10)
        intercept -= rate * first_b / fix / (math.sqrt(second_b / fix2) + 1e-10)
    return weights, float(intercept)


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 on division by 3. Null ids aren't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """text and toxic of at most ``most`` labelled rows that aren't held out: those with the smallest hashes of their ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id").repartition(
        FIT_TASKS, "doc_id").select("doc_id", "text", "toxic")


def feature_counts(rows: DataFrame) -> DataFrame:
    """bucket, toxic, other: training documents of either kind that hold an n-gram of the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        everything = np.ones(1 << BUCKET_BITS, bool)
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                labels = np.array(part.column("toxic").to_pylist(), np.int64)
                text, held = present(part.column("text").to_pylist(), everything)
                for kind in (0, 1):
                    counts[kind] += np.bincount(held[labels[text] == kind], minlength=1 << BUCKET_BITS).astype(np.int32)
        at = np.flatnonzero(counts.any(axis=0))
        for part in np.array_split(at, max(1, len(at) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(counts[k][part]) for k in (1, 0))],
                                             ["bucket", "toxic", "other"])

    return rows.mapInArrow(run, "bucket int, toxic int, other int").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model | None:
    """The classifier, or None if the training rows aren't of both kinds.

    docs has doc_id and text, labels doc_id and toxic (0 or 1); null labels, ids and texts are left out, repeated labels of an id
    count as toxic if one is. The driver holds the telling features and, of at most ``most`` rows, which of these they have.
    """
    rows = training_rows(docs, labels, most).persist()
    totals = dict(rows.groupBy("toxic").count().collect())
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        rows.unpersist()
        return None
    ratio = F.log(((F.col("toxic") + SMOOTH) / (toxic + 2 * SMOOTH)) / ((F.col("other") + SMOOTH) / (other + 2 * SMOOTH)))
    telling = feature_counts(rows).where(F.col("toxic") + F.col("other") >= LEAST_DOCUMENTS).withColumn("ratio", ratio).orderBy(
        F.desc(F.abs("ratio") * F.sqrt(F.col("toxic") / toxic + F.col("other") / other)), "bucket").limit(FEATURES).orderBy("bucket")
    found = telling.select("bucket", "ratio").collect()
    bucket = np.array([r[0] for r in found], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BUCKET_BITS, bool)
        wanted[bucket] = True
        for batch in batches:
            for part in slices(batch, "text"):
                text, held = present(part.column("text").to_pylist(), wanted)
                lists = np.split(np.searchsorted(bucket, held).astype(np.int32), np.searchsorted(text, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(lists, pa.list_(pa.int32()))],
                                                 ["doc_id", "toxic", "features"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sample = rows.mapInArrow(run, f"doc_id {kind}, toxic int, features array<int>").orderBy("doc_id").toArrow()
    rows.unpersist()
    chunks = sample.column("features").chunks
    offsets = np.cumsum(np.concatenate([[0], *[np.diff(c.offsets.to_numpy()) for c in chunks]]))
    columns, scale = np.concatenate([c.flatten().to_numpy() for c in chunks]), np.array([r[1] for r in found])
    labelled = sample.column("toxic").to_numpy().astype(float)
    del sample, chunks
    weights, intercept = regress(offsets, columns, scale, labelled)
    return Model(bucket, weights * scale, intercept)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row in: doc_id, score, predicted. Null texts count as empty; without a model all scores are 0.

    Very long texts are scored whole. Null ids, repeated rows and rows that share an id pass through, other columns are ignored, an
    empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model and model.table()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                scores = model.score(texts, tables) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts score below ``threshold``; without a model all of them.

    Null texts count as empty, very long ones are scored whole. Repeated rows and rows that share an id are judged each by its own
    text, null ids make no difference, and an empty table gives no rows.
    """
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.table()
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [text or "" for text in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(model.score(texts, tables) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_naive_bayes_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
