"""Quality filtering by weak supervision.

Rules look at a document's statistics and vote good, bad or nothing. Expectation-maximisation over the counts of vote
patterns estimates how often good documents exist and how each rule votes on good and on bad ones; a document
is kept by its posterior probability of being good, not by passing every rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import session
from hydromelt.llm.common import slices, table, utf8

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct_words",
         "n_sentence_ends", "top_word")
GOOD, BAD, ABSTAIN = 1, 0, -1
#: Least words, and largest share of repeated words in per cent, of a document that is judged by the rules at all.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: A document is kept from this posterior on.
THRESHOLD = 0.5
ITERATIONS = 1000
#: Pseudo-counts of a bad, a good and no vote on bad documents, and on good ones.
PRIOR = np.array([[4.0, 1.0, 5.0], [1.0, 4.0, 5.0]])


@dataclass(frozen=True)
class Rule:
    """Votes bad from one bound of a ratio on, good up to another if it has one, and nothing else."""

    name: str
    ratio: str
    bad_from: float
    good_to: float | None = None

    def vote(self) -> Column:
        value = F.expr(self.ratio)
        vote = F.when(value >= self.bad_from, BAD)
        return (vote if self.good_to is None else vote.when(value <= self.good_to, GOOD)).otherwise(ABSTAIN)


#: Ratios of the statistics; a negative sign turns "at least" into "at most". Some rules only know what is bad.
RULES = (
    Rule("symbols", "n_symbols / n_words", 0.1, 0.02),
    Rule("sentences", "- n_sentence_ends / n_words", -0.03, -0.05),
    Rule("upper_case", "n_upper_words / n_words", 0.02),
    Rule("repeated_words", "n_repeat_words / n_words", 0.1, 0.02),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 0.2),
    Rule("vocabulary", "- n_distinct_words / n_words", -0.5, -0.6),
    Rule("top_word", "top_word / n_words", 0.15, 0.1),
    Rule("long_words", "word_chars / n_words", 6.5),
    Rule("short_words", "- word_chars / n_words", -4.3),
)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that the text holds at least twice."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 21:  # three ids fit one number exactly
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique(np.stack([ids[:-1], ids[1:]]), axis=1, return_inverse=True)[1].ravel()
        windows = pairs[:-1] * (int(ids.max()) + 1) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows) + 2, bool)
    hits = np.concatenate([order[1:][same], order[:-1][same]])
    for shift in range(3):
        again[hits + shift] = True
    return int(again.sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """A text's statistics, in the order of ``STATS``."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    text = raw.decode()
    return (len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(raw.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))),
            len(lines) - len(set(lines)), repeated_words(ids, len(number)), len(lines), sum(map(bytes.isupper, words)),
            len(number), raw.count(b". ") + raw.count(b".\n") + raw.endswith(b"."),
            int(np.bincount(ids).max()) if len(ids) else 0)


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``STATS`` per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                found = np.array([measure(raw) for raw in part.column("raw").to_pylist()], np.int64).reshape(-1, len(STATS))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c) for c in found.T]], ["doc_id", *STATS])

    rows = df.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw"))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{s} long" for s in STATS]]))


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per vote pattern, each rule's chances of a vote in either class, and the share of good documents.

    The chances, as (class, rule, vote) with bad, good and no vote in the last place, are estimated class by class: a rule that only
    knows what is bad tells by how much oftener it says so of bad documents, and by its silence. Starts from the majority
    of votes; ``PRIOR`` counts as that many documents of each class, which keeps good the class that good votes go to.
    """
    votes = np.where(patterns == ABSTAIN, 2, patterns)
    said = (votes[:, :, None] == np.arange(3)).astype(float)
    posterior = ((patterns == GOOD).sum(axis=1) + 1) / ((patterns != ABSTAIN).sum(axis=1) + 2)
    chances, share = np.zeros((2, patterns.shape[1], 3)), 0.5
    for _ in range(ITERATIONS):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        new = np.einsum("cp,prv->crv", weight, said) + PRIOR[:, None, :]
        new /= new.sum(axis=2, keepdims=True)
        done = np.abs(new - chances).max() < 1e-12
        chances = new
        evidence = np.log(share) - np.log(1 - share) + np.einsum("prv,rv->p", said, np.log(chances[1]) - np.log(chances[0]))
        posterior = 1 / (1 + np.exp(-np.clip(evidence, -500, 500)))
        if done:
            break
    return posterior, chances, float(share)


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row in: doc_id, the statistics, base_failed, posterior, kept.

    A very long text counts whole and is measured alone. Documents under ``LEAST_WORDS`` words or over ``MOST_REPEATED`` per cent repeated words fail at the base and are
    not voted on; null and empty texts are among them. Null ids and repeated rows pass through, other columns are ignored,
    an empty table gives no rows. The driver sees vote patterns with their counts: at most 3 ** rules rows.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    votes = [f"vote_{r.name}" for r in rules]
    rows = session.stage(statistics(df, id_col, text_col).withColumn("base_failed", failed), "statistics")
    voted = rows.withColumns({v: F.when(~F.col("base_failed"), r.vote()) for v, r in zip(votes, rules, strict=True)})
    found = voted.where("NOT base_failed").groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).orderBy(*votes).collect()
    if not found:
        return rows.withColumn("posterior", F.lit(0.0)).withColumn("kept", F.lit(False))
    patterns = np.array([[r[v] for v in votes] for r in found])
    posterior, _, _ = estimate(patterns, np.array([r["n"] for r in found], float))
    known = df.sparkSession.createDataFrame(
        [(*map(int, p), float(q)) for p, q in zip(patterns, posterior, strict=True)],
        ", ".join([*[f"{v} int" for v in votes], "posterior double"]))
    return voted.join(F.broadcast(known), votes, "left").withColumn("posterior", F.coalesce("posterior", F.lit(0.0))).withColumn(
        "kept", F.col("posterior") >= threshold).drop(*votes)


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
