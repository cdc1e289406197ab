"""Hashes of words and word runs, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a task keeps.
KEPT_WORDS = 150_000
#: Odd multipliers of the 64-bit finaliser and of the polynomial over a run's words.
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of words, with a bounded memory."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def learn(self, *texts: list[bytes]) -> None:
        """Makes ``hashes`` ready for some texts' words; forgets others if there are too many."""
        words = set().union(*texts)
        if len(self.known) + len(words) > KEPT_WORDS:
            self.known = {}
        digest = xxhash.xxh3_64_intdigest
        self.known.update([(w, digest(w)) for w in words.difference(self.known)])

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


class Runs:
    """Polynomial hashes of any runs of a sequence: equal runs have equal hashes wherever they stand."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(Runs._powers) < n + 1:
            size = max(4096, 2 * (n + 1))
            Runs._powers = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE, np.uint64)])
            Runs._inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * Runs._powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * Runs._inverse[starts] + (ends - starts).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Hashes of all runs of ``size``."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * Runs._inverse[:n] + np.uint64(size))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
