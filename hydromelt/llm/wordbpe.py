"""What both tokenizer operators read from a word-level BPE file, and how they cut texts into pre-tokens.

A symbol is keyed by its bytes; ``END`` closes the last symbol of a pre-token. 0xFF never occurs in UTF-8.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

END = b"\xff"
#: What starts as no merge at all.
NEVER = np.iinfo(np.int32).max
#: Letters up to here are the same in all versions of the Unicode tables, and NFC leaves them alone; texts with
#: others, or with capitals whose small letters are others, go through the tokenizer library's own normaliser and tables.
SETTLED = 0x24F
_SETTLED = re.compile("[" + "".join(re.escape(chr(c)) for c in range(SETTLED + 1) if max(chr(c).lower()) <= chr(SETTLED)) + "]*\\Z")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _spelled_out(pattern: str) -> str:
    """A pattern with its Unicode classes written as the settled letters they hold."""
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        held = regex.compile(name)
        pattern = pattern.replace(name, "".join(re.escape(chr(c)) for c in range(SETTLED + 1) if held.match(chr(c))))
    return pattern


class WordBPE:
    """Vocabulary, merges and pre-token pattern of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = re.compile(_spelled_out(pattern))
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.path = path
        vocab, letters = model["vocab"], byte_letters()
        self.letters = letters
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.text_of: list[str] = [""] * size
        for text, number in (vocab | self.special).items():
            self.text_of[number] = text

        def key(text: str) -> bytes | None:
            body = text.removesuffix(self.suffix)
            if any(c not in letters for c in body):
                return None
            return bytes(letters[c] for c in body) + (END if body != text else b"")

        self.id_of = {k: number for text, number in vocab.items() if text not in self.special and (k := key(text))}
        self.longest = max(map(len, self.id_of))
        self.first = np.zeros(256, np.int32)  # a byte's symbol
        self.last = np.zeros(256, np.int32)  # a closing byte's symbol
        for letter, byte in letters.items():
            self.first[byte], self.last[byte] = vocab[letter], vocab[letter + self.suffix]
        # The merges, sorted by pair for lookup: pair, rank and product. Made of: a symbol's own merge.
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.born = np.full(size, -1, np.int64)
        pairs = []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            made = vocab[a + b]
            pairs.append((self.pair(vocab[a], vocab[b]), rank, made))
            self.left[made], self.right[made], self.born[made] = vocab[a], vocab[b], rank
        self.rank_of = {pair: (rank, made) for pair, rank, made in pairs}
        pairs.sort()
        self.keys, ranks, made = (np.array(x) for x in zip(*pairs, strict=True))
        self.ranks, self.made = ranks.astype(np.int32), made.astype(np.int32)
        # Merging all places of the lowest pair at once is exact if every merge comes after those of its parts
        # and no symbol has two merges.
        parts = np.maximum(self.born[self.keys >> 32], self.born[self.keys & 0xFFFFFFFF])
        self.ordered = bool((parts < self.ranks).all()) and len(set(self.made.tolist())) == len(self.made)

    @cached_property
    def library(self) -> Tokenizer:
        """The tokenizer library's own object, made when a text needs it."""
        return Tokenizer.from_file(self.path)

    @staticmethod
    def pair(a, b):
        return (a << 32) | b

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NEVER`` if there is none) and product of each pair."""
        wanted = self.pair(a.astype(np.int64), b.astype(np.int64))
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[at] == wanted
        return np.where(found, self.ranks[at], NEVER), self.made[at]

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text. Special strings stand for themselves; no other pre-token looks like one."""
        if "<|" not in text and _SETTLED.match(text):
            return self.pattern.findall(text.lower())
        found: list[str] = []
        for part in self.cut_special.split(text):
            if part in self.special:
                found.append(part)
            elif _SETTLED.match(part):
                found += self.pattern.findall(part.lower())
            else:
                part = self.library.normalizer.normalize_str(part)
                found += [bytes(map(self.letters.__getitem__, word)).decode()
                          for word, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return found


@lru_cache(maxsize=2)
def load(vocabulary: str) -> WordBPE:
    """The file's tables, once per worker. ``vocabulary``: an absolute path, or the name of an installed public file."""
    if not vocabulary.startswith("/"):
        import public_tokenizers
        vocabulary = public_tokenizers.path(vocabulary)
    return WordBPE(vocabulary)

