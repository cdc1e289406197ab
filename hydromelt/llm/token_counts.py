"""Token counts by rank-synchronous merging.

Pre-tokens are held as one flat array of symbols with offsets. Each round looks up all adjacent pairs, applies every
sequence's lowest-ranked pair wherever it stands, and drops finished sequences; the symbols that survive are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt.llm.common import slices, table
from hydromelt.llm.wordbpe import NEVER, WordBPE, load

#: Distinct pre-tokens whose counts a task keeps, and the longest such.
KEPT_WORDS = 300_000
KEPT_LENGTH = 64


def merge_all(bpe: WordBPE, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of each non-empty word: how many, and all of them in order of the words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    symbols = bpe.first[flat]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = bpe.last[flat[ends - 1]]
    done = np.zeros(len(words), np.int64)
    results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    which = np.arange(len(words))
    while len(which):
        starts = np.cumsum(lengths) - lengths
        ranks = np.full(len(symbols), NEVER, np.int32)
        made = np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            ranks[:-1], made[:-1] = bpe.lookup(symbols[:-1], symbols[1:])
        ranks[starts + lengths - 1] = NEVER  # no pair reaches into the next word
        lowest = np.minimum.reduceat(ranks, starts)
        over = lowest == NEVER
        if over.any():
            of_over = np.repeat(over, lengths)
            done[which[over]] = lengths[over]
            results.append((which[over], lengths[over], symbols[of_over]))
            ranks, made, symbols = ranks[~of_over], made[~of_over], symbols[~of_over]
            which, lengths, lowest = which[~over], lengths[~over], lowest[~over]
            if not len(which):
                break
            starts = np.cumsum(lengths) - lengths
        chosen = ranks == np.repeat(lowest, lengths)
        at = np.flatnonzero(chosen)
        if bpe.ordered:
            # Of places next to each other, as in "aaa", every second one counts from the left.
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            first = np.searchsorted(run, run)
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        else:
            at = at[np.unique(np.searchsorted(starts, at, side="right"), return_index=True)[1]]
        symbols[at] = made[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        lengths = np.add.reduceat(keep.astype(np.int64), starts)
        symbols = symbols[keep]
    order, sizes, parts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*results)) if results else (
        np.zeros(0, np.int64),) * 3
    begin = np.cumsum(sizes) - sizes
    place = np.empty(len(words), np.int64)
    place[order] = begin
    starts = np.cumsum(done) - done
    index = np.repeat(place - starts, done) + np.arange(int(done.sum()))
    return done, parts[index]


class Counter:
    """Token counts of texts, with a bounded memory of pre-tokens already counted."""

    def __init__(self, bpe: WordBPE):
        self.bpe, self.known = bpe, dict.fromkeys(bpe.special, 1)

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.bpe.pre_tokens(text) for text in texts]
        words = set().union(*cut)
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known = dict.fromkeys(self.bpe.special, 1)
            new = list(words.difference(self.known))
        if new:  # merged together as one ragged array
            self.known.update(zip(new, merge_all(self.bpe, [w.encode() for w in new])[0].tolist(), strict=True))
        counts = [sum(map(self.known.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > KEPT_LENGTH:
                del self.known[word]
        return counts


def count_tokens(df: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row in: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no tokens. Special strings in a text count as their one token. Null ids and repeated rows
    pass through, very long texts are counted whole, other columns are ignored, and an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(load(vocabulary))  # its memory ends with the task
        for batch in batches:
            for part in slices(batch, "text"):
                counts = held.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())],
                                                 ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)


def op2_rank_synchronous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))
