"""Decomposition of a term into standard words."""

from __future__ import annotations


def decompose(term: str, vocabulary: set[str], longest: int) -> list[str] | None:
    """Cover ``term`` with vocabulary words, preferring long words from the left.

    Works from the end of the term so that every suffix is solved once.
    """
    cover: list[list[str] | None] = [None] * len(term) + [[]]
    for start in range(len(term) - 1, -1, -1):
        for size in range(min(longest, len(term) - start), 0, -1):
            tail = cover[start + size]
            word = term[start:start + size]
            if tail is not None and word in vocabulary:
                cover[start] = [word] + tail
                break
    return cover[0]
