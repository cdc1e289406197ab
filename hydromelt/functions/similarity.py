"""String similarity: common subsequences of whole batches (Arrow UDF) and trigram overlap (native)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for bit, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << bit)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity on a 0-100 scale."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    return (1.0 - (total - 2 * common_subsequence(a, b)) / total) * 100.0


def _matrix(texts: pd.Series, filler: int) -> np.ndarray:
    """One row of code points per text, filled up at the end."""
    sizes = texts.str.len().to_numpy(np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    rows = np.full((len(texts), int(sizes.max(initial=0))), filler, np.uint32)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = points
    return rows


def common_subsequences(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs, one step per letter of the right texts for all pairs at once.

    A pair's state is an array of 64-bit words, one bit per letter of the left text.
    """
    a, b = _matrix(left, 0x110000), _matrix(right, 0x110001)  # no letters, and not alike
    words = -(-a.shape[1] // 64)
    state = np.full((len(a), words), np.iinfo(np.uint64).max, np.uint64)
    packed = np.zeros((len(a), words * 8), np.uint8)
    for letter in b.T:
        bits = np.packbits(a == letter[:, None], axis=1, bitorder="little")
        packed[:, :bits.shape[1]] = bits
        equal = packed.view(np.uint64)
        carry = np.zeros(len(a), bool)
        for word in range(words):
            row = state[:, word]
            hit = row & equal[:, word]
            part = row + hit
            total = part + carry
            carry = (part < row) | (total < part)
            state[:, word] = total | (row ^ hit)
    return (64 * words - np.bitwise_count(state).sum(axis=1, dtype=np.int64)) if words else np.zeros(len(a), np.int64)


#: Pairs of one step, taken in order of length, so that they need little filling up.
PAIRS_AT_ONCE = 4096


def common_in_order(left: pd.Series, right: pd.Series) -> np.ndarray:
    """``common_subsequences`` of pairs of any lengths."""
    swap = left.str.len() > right.str.len()
    left, right = left.where(~swap, right), right.where(~swap, left)
    order = np.lexsort((left.str.len(), right.str.len()))
    found = np.zeros(len(order), np.int32)
    for start in range(0, len(order), PAIRS_AT_ONCE):
        some = order[start:start + PAIRS_AT_ONCE]
        found[some] = common_subsequences(left.iloc[some], right.iloc[some])
    return found


@F.pandas_udf(T.IntegerType())
def common_letters(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of each pair; null texts have none."""
    return pd.Series(common_in_order(left.fillna(""), right.fillna("")))


def ratio_of(left: Column, right: Column) -> Column:
    """Indel similarity on a 0-100 scale; two empty texts are alike."""
    total = F.length(left) + F.length(right)
    return F.when(total == 0, 100.0).otherwise((F.lit(1.0) - (total - 2 * common_letters(left, right)) / total) * 100.0)


def indel_ratio(left: str, right: str) -> Column:
    """``ratio_of`` two columns to one decimal."""
    return F.bround(ratio_of(F.col(left), F.col(right)), 1)


def trigrams(key: Column) -> Column:
    """Distinct trigrams of one word padded with two blanks before and one after."""
    padded = F.concat(F.lit("  "), key, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(key) + 1),
                        lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(key) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Overlap of two trigram sets, 0..1."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))
