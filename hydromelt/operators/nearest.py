"""Most similar texts by indel ratio, found through an index instead of comparing all with all.

A text is a bag of grams, equal ones numbered. Two texts of a and b letters whose ratio is at least r keep r(a+b)/2 letters
in common, so they share that many single letters, and (1.5r - 1)(a+b) + 1 of their letter pairs, counting a mark at both
ends: every letter left out can part no more than two kept ones. Grams are ordered from rare to common over the index, so the
first gram that two texts share says how many more they can share at most. Pairs that may share enough are scored;
all others are out. The ratio asked for falls: what finds its matches at a high one is done, and the rest are asked once
more at the best they have found so far, by letter pairs if that is high enough and else by letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hydromelt.functions import similarity
from hydromelt.operators.numbering import top_per
from hydromelt.session import stage

#: The ratio asked for first, and that above which letter pairs tell texts apart.
FLOOR = 0.85
_PAIRED = 2 / 3 + 1e-6
_SLACK = 1e-9
#: Entries, and letters of these, that are sent to the tasks instead of being indexed; a checked bound, not an estimate.
FEW, FEW_LETTERS = 1_000, 50_000


def numbered_grams(text: Column, size: int) -> Column:
    """The text's grams, each with the number of equal ones before it; pairs include a mark before and after the text."""
    padded = text if size == 1 else F.concat(F.lit("\x02"), text, F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - (size - 1)), lambda i: F.substring(padded, i, F.lit(size)))
    return F.transform(grams, lambda gram, i: F.concat(gram, F.size(F.filter(
        F.slice(grams, F.lit(1), i), lambda other: other == gram)).cast("string")))


def shared_at_least(ratio: Column, a: Column, b: Column, size: int) -> Column:
    """How many numbered grams two texts of ``a`` and ``b`` letters share if their ratio is at least ``ratio``; one at least."""
    needed = (a + b) * ratio / 2 if size == 1 else (a + b) * (ratio * 1.5 - 1) + 1
    return F.greatest(F.lit(1), F.ceil(needed - _SLACK))


def _exploded(texts: DataFrame, name: str, size: int) -> DataFrame:
    grams = numbered_grams(F.col(name), size)
    return texts.select(name, F.length(name).alias(f"{name}_size"), F.explode(grams).alias("gram"))


def _placed(grams: DataFrame, name: str, frequency: DataFrame) -> DataFrame:
    """gram, text, text_size, text_left: grams left from this one on, rare grams first."""
    ordered = top_per(grams.join(frequency, "gram", "left").withColumn("seen", F.coalesce("seen", F.lit(0))),
                      [name], [F.col("seen").desc(), F.col("gram").desc()], 1 << 30, f"{name}_left")
    return ordered.drop("seen")


class GramIndex:
    """Texts by their grams. It is stored if ``keep``, to be asked more than once."""

    def __init__(self, texts: DataFrame, size: int, keep: bool = False):
        self.size = size
        grams = _exploded(texts, "text", size)
        self.frequency = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("seen"))
        rows = _placed(grams, "text", self.frequency)
        self.rows = stage(rows, "gram-index") if keep else rows

    def probes(self, asked: DataFrame) -> DataFrame:
        return _placed(_exploded(asked, "asked", self.size), "asked", self.frequency)

    def candidates(self, probes: DataFrame, ratio: Column) -> DataFrame:
        """Distinct (asked, text) that may reach the ratio; it may differ from one asked text to another."""
        def enough(size: Column, left: Column) -> Column:
            return left >= shared_at_least(ratio, size, size * ratio / (2 - ratio), self.size)

        mine = probes.where(enough(F.col("asked_size"), F.col("asked_left")))
        both = shared_at_least(ratio, F.col("asked_size"), F.col("text_size"), self.size)
        short, long = F.least("asked_size", "text_size"), F.greatest("asked_size", "text_size")
        fits = (F.least("asked_left", "text_left") >= both) & (short >= long * ratio / (2 - ratio) - _SLACK)
        return mine.join(self.rows, "gram").where(fits).select("asked", "text").distinct()


def score(pairs: DataFrame) -> DataFrame:
    """Adds the indel ratio of ``asked`` and ``text``, 0 to 100."""
    return pairs.withColumn("ratio", similarity.ratio_of(F.col("asked"), F.col("text")))


def nearest(asked: DataFrame, entries: DataFrame, limit: int = 1, floor: float = FLOOR) -> DataFrame:
    """The ``limit`` entries most similar to each distinct ``asked`` text: asked, place, text, seq, ratio.

    ``entries``: text and seq; of equal ratios the smaller seq comes first. Whatever the ratio, the best are found: nothing is
    cut off. Null and empty asked texts have no rows; an entry without a letter in common has ratio 0.
    """
    # More than ``limit`` entries of one text can't all be among the best.
    entries = top_per(entries.select("text", "seq"), ["text"], [F.col("seq")], limit, "nth").drop("nth")
    asked = asked.select("asked").where("asked <> ''").distinct()
    if (held := few(entries)) is not None:
        return _among_few(asked, held, limit, entries)
    texts = entries.select("text").where("text <> ''").distinct()

    def best_of(pairs: DataFrame) -> DataFrame:
        return stage(top_per(score(pairs).join(entries, "text"), ["asked"], [F.col("ratio").desc(), F.col("seq")], limit, "place"
                             ).select("asked", "place", "text", "seq", "ratio"), "nearest")

    index = GramIndex(texts, 2, keep=True)
    probes = stage(index.probes(asked), "gram-probes")
    first = best_of(index.candidates(probes, F.lit(floor)))
    reached = first.where(F.col("place") == limit).select("asked", (F.col("ratio") / 100).alias("floor"))
    left = stage(asked.join(reached, "asked", "left").select("asked", F.coalesce("floor", F.lit(0.0)).alias("floor")).where(
        F.col("floor") < floor - _SLACK), "left")
    if left.isEmpty():
        return first
    near, far = (left.where((F.col("floor") > _PAIRED) == paired) for paired in (True, False))
    letters = GramIndex(texts, 1)
    rest = best_of(index.candidates(probes.join(near, "asked"), F.col("floor")).unionByName(
        letters.candidates(letters.probes(far.select("asked")).join(far, "asked"), F.col("floor"))))
    return first.join(left, "asked", "left_anti").unionByName(rest).unionByName(_without_letters(left, rest, entries, limit))


def few(entries: DataFrame) -> list[Row] | None:
    """All entries if they are proven to be few and short; reads no more than ``FEW`` + 1 of them, and no more letters of each."""
    held = entries.select("seq", F.substring(F.coalesce("text", F.lit("")), 1, FEW_LETTERS + 1).alias("text")).limit(FEW + 1).collect()
    if len(held) > FEW or sum(len(r["text"]) for r in held) > FEW_LETTERS:
        return None
    return sorted(held, key=lambda r: r["seq"])


def _among_few(asked: DataFrame, held: list[Row], limit: int, entries: DataFrame) -> DataFrame:
    """``nearest`` among entries so few that each task compares its texts with all of them."""
    texts = np.array([r["text"] for r in held], object)
    seqs, sizes = [r["seq"] for r in held], np.array([len(r["text"]) for r in held])
    at_once = max(1, similarity.PAIRS_AT_ONCE // max(1, len(held)))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame) if held else 0, at_once):
                some = frame["asked"].iloc[start:start + at_once].reset_index(drop=True)
                common = similarity.common_in_order(pd.Series(np.repeat(some.to_numpy(object), len(texts))), pd.Series(np.tile(texts, len(some))))
                total = some.str.len().to_numpy()[:, None] + sizes
                ratio = (1.0 - (total - 2 * common.reshape(total.shape)) / total) * 100.0
                best = np.argsort(-ratio, axis=1, kind="stable")[:, :limit]
                each = best.shape[1]
                yield pd.DataFrame({
                    "asked": np.repeat(some.to_numpy(object), each), "place": np.tile(np.arange(1, each + 1), len(some)),
                    "text": texts[best].ravel(), "seq": [seqs[i] for i in best.ravel()],
                    "ratio": np.take_along_axis(ratio, best, axis=1).ravel()})

    kind = entries.schema["seq"].dataType.simpleString()
    return asked.mapInPandas(compare, f"asked string, place int, text string, seq {kind}, ratio double")


def _without_letters(left: DataFrame, best: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """Fills up texts with fewer than ``limit`` entries by the first others, which share no letter with them."""
    first = entries.orderBy("seq").limit(2 * limit)  # at most limit of them are taken
    short = left.join(best.groupBy("asked").agg(F.count(F.lit(1)).alias("held"), F.collect_set("seq").alias("taken")), "asked", "left")
    short = short.select("asked", F.coalesce("held", F.lit(0)).alias("held"), "taken").where(F.col("held") < limit)
    rows = first.agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("rest"))
    others = short.join(F.broadcast(rows), F.lit(True)).select("asked", "held", F.posexplode(F.filter(
        "rest", lambda e: ~F.coalesce(F.array_contains("taken", e["seq"]), F.lit(False)))).alias("nth", "e"))
    return others.select("asked", (F.col("held") + F.col("nth") + 1).cast("int").alias("place"), "e.text", "e.seq",
                         F.lit(0.0).alias("ratio")).where(F.col("place") <= limit)
