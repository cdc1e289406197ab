"""BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes a word's tokens. A proposal is the BPE result exactly if every adjacent pair is compatible:
no merge across their border comes before the merges that built the two tokens. All distinct pairs of a batch are tested
together; only words with an incompatible pair, or without a proposal, are merged exactly.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt.llm.common import slices, table
from hydromelt.llm.token_counts import merge_all
from hydromelt.llm.wordbpe import END, NEVER, WordBPE, load

#: Distinct pre-tokens, and distinct pairs, that a task keeps; the longest pre-token kept.
KEPT_WORDS = 150_000
KEPT_PAIRS = 200_000
KEPT_LENGTH = 64


def propose(bpe: WordBPE, word: bytes) -> list[int] | None:
    """Greedy longest match over the closed word; None if its end can't be matched."""
    rest, found, at = len(word) - 1, [], 0  # the closing mark belongs to the last byte
    ids, longest = bpe.id_of, bpe.longest
    while at <= rest - 1:
        for end in range(min(len(word), at + longest), at, -1):
            if end != rest and (number := ids.get(word[at:end])) is not None:
                found.append(number)
                at = end
                break
        else:
            return None
    return found


def compatible(bpe: WordBPE, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the tokens of each pair stay apart when their texts are encoded together.

    Walks both borders from whole tokens down: at each step the symbols that stand at the border last are looked up, and
    the one that was built later is split.
    """
    fine = np.ones(len(a), bool)
    x, y = a.copy(), b.copy()
    # When the border symbols are used up by a merge of their own token.
    x_used, y_used = np.full(len(a), NEVER, np.int64), np.full(len(a), NEVER, np.int64)
    live = np.arange(len(a))
    while len(live):
        rank = bpe.lookup(x[live], y[live])[0]
        # At equal rank the left place goes first: a merge within the left token wins, one within the right one loses.
        crosses = (rank < NEVER) & (rank < x_used[live]) & (rank <= y_used[live])
        fine[live[crosses]] = False
        live = live[~crosses]
        born_x, born_y = bpe.born[x[live]], bpe.born[y[live]]
        more = (born_x >= 0) | (born_y >= 0)
        live, born_x, born_y = live[more], born_x[more], born_y[more]
        split = born_x >= born_y
        left, right = live[split], live[~split]
        x_used[left], x[left] = born_x[split], bpe.right[x[left]]
        y_used[right], y[right] = born_y[~split], bpe.left[y[right]]
    return fine


class Encoder:
    """Encodes texts, with bounded memories of pre-tokens and pairs."""

    def __init__(self, bpe: WordBPE):
        self.bpe = bpe
        self.fine: dict[int, bool] = {}
        self.reset()

    def verify(self, proposals: list[list[int] | None]) -> None:
        """Tests the pairs of all proposals that aren't known yet."""
        pair = self.bpe.pair
        new = {pair(a, b) for p in proposals if p for a, b in zip(p, p[1:], strict=False)}.difference(self.fine)
        if len(self.fine) + len(new) > KEPT_PAIRS:
            self.fine = {}
            new = {pair(a, b) for p in proposals if p for a, b in zip(p, p[1:], strict=False)}
        pairs = np.fromiter(new, np.int64, len(new))
        ok = compatible(self.bpe, (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32))
        self.fine.update(zip(pairs.tolist(), ok.tolist(), strict=True))

    def words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of closed words."""
        proposals = [propose(self.bpe, word) for word in words]
        if self.bpe.ordered:
            self.verify(proposals)
        fine, pair = self.fine, self.bpe.pair
        failed = [i for i, p in enumerate(proposals) if not p or not self.bpe.ordered or not all(
            [fine[pair(a, b)] for a, b in zip(p, p[1:], strict=False)])]
        if failed:
            counts, symbols = merge_all(self.bpe, [words[i][:-1] for i in failed])
            for i, ids in zip(failed, np.split(symbols, np.cumsum(counts)[:-1]), strict=True):
                proposals[i] = ids.tolist()
        return proposals

    def reset(self) -> None:
        self.ids = {text: np.array([i], "<u4").tobytes() for text, i in self.bpe.special.items()}
        self.text = {text: text for text in self.bpe.special}

    def learn(self, words: list[str]) -> None:
        """Encodes new words, and decodes their ids again."""
        for word, ids in zip(words, self.words([w.encode() + END for w in words]), strict=True):
            self.ids[word] = struct.pack(f"<{len(ids)}I", *ids)
            self.text[word] = decode(self.bpe, ids)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Each text's ids, as little-endian unsigned 32-bit integers, and the text they decode to."""
        cut = [self.bpe.pre_tokens(text) for text in texts]
        words = set().union(*cut)
        if len(self.ids) + len(words.difference(self.ids)) > KEPT_WORDS:
            self.reset()
        new = list(words.difference(self.ids))
        self.learn(new)
        for words in cut:
            yield b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.text.__getitem__, words))
        for word in new:
            if len(word) > KEPT_LENGTH:
                del self.ids[word], self.text[word]


def decode(bpe: WordBPE, ids: list[int]) -> str:
    """The vocabulary has no decoder of its own: token texts joined by a blank."""
    return " ".join([bpe.text_of[i] for i in ids])


def code(df: DataFrame, vocabulary: str = "word_bpe_49k.json", outputs: tuple[str, ...] = ("ids", "decoded"),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row in: doc_id, n_tokens and what ``outputs`` names of ids, decoded, ids_sha256, decoded_sha256.

    ids are token ids as an array of int, decoded is the text they give. Null and empty texts have no tokens and decode
    to the empty text. Very long texts are coded whole, each alone. Null ids, repeated rows
    and rows that share an id pass through, other columns are ignored, an empty table gives no rows.
    """
    kinds = {"ids": (pa.list_(pa.int32()), "array<int>", lambda ids, text: np.frombuffer(ids, "<u4").astype(np.int32)),
             "decoded": (pa.string(), "string", lambda ids, text: text),
             "ids_sha256": (pa.string(), "string", lambda ids, text: hashlib.sha256(ids).hexdigest()),
             "decoded_sha256": (pa.string(), "string", lambda ids, text: hashlib.sha256(text.encode()).hexdigest())}
    wanted = [kinds[name] for name in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Encoder(load(vocabulary))  # its memory ends with the task
        for batch in batches:
            for part in slices(batch, "text"):
                rows = list(held.encode(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(ids) // 4 for ids, _ in rows], pa.int64()),
                     *[pa.array([make(*row) for row in rows], kind) for kind, _, make in wanted]],
                    ["doc_id", "n_tokens", *outputs])

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = ", ".join([f"doc_id {df.schema[id_col].dataType.simpleString()}", "n_tokens long",
                        *[f"{name} {kind}" for name, (_, kind, _) in zip(outputs, wanted, strict=True)]])
    return rows.mapInArrow(run, schema)


def op8_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded documents as digests."""
    return code(table(spark, sf_dir, "documents"), outputs=("ids_sha256", "decoded_sha256"))
