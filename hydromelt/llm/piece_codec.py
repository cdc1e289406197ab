"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers and what follows up to the next one. Where no piece of the vocabulary reaches
from a letter into a marker, no merge crosses from one chunk into the next, so each distinct chunk is segmented once and
its ids, and the text they decode to, are joined back by position.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from hydromelt.llm.common import slices, table

MARK = "▁"
#: Distinct chunks that a task's table keeps, and the longest one kept.
KEPT_CHUNKS = 150_000
KEPT_LENGTH = 64
_CHUNK = re.compile(" +[^ ]*")
#: Full-width and combining letters, blanks in a row and at the ends, a tab: what a normaliser would change.
_PROBE = " Ａé   ﬁ  x\ty　 "


@lru_cache(maxsize=2)
def load(model: str) -> SentencePieceProcessor:
    """The model, once per worker. ``model``: an absolute path, or the name of an installed public file."""
    if not model.startswith("/"):
        import public_tokenizers
        model = public_tokenizers.path(model)
    return SentencePieceProcessor(model_file=model)


def separable(model: SentencePieceProcessor) -> bool:
    """Whether chunks can be segmented on their own: no piece crosses into a marker, and texts are only marked, not changed."""
    pieces = map(model.id_to_piece, range(len(model)))
    return (model.piece_to_id(MARK) != model.unk_id() and not any(MARK in piece.lstrip(MARK) for piece in pieces)
            and model.normalize(_PROBE) == (MARK + _PROBE).replace(" ", MARK))


class ChunkTable:
    """Distinct chunks with their ids and decoded text, of bounded size."""

    def __init__(self, model: SentencePieceProcessor):
        self.model, self.whole = model, not separable(model)
        self.begin, self.end = (struct.pack("<I", i) for i in (model.bos_id(), model.eos_id()))
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}

    def cut(self, text: str) -> list[str]:
        """The chunks of a text, markers written as blanks; a text gets one marker more at its front."""
        return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, chunks: list[str]) -> None:
        """Segments new chunks, and decodes their ids again. The library puts the first marker itself, but for a lone one."""
        found = self.model.encode([chunk[1:] for chunk in chunks], num_threads=1)
        found = [ids if chunk != " " else [self.model.piece_to_id(MARK)] for chunk, ids in zip(chunks, found, strict=True)]
        for chunk, ids, text in zip(chunks, found, self.model.decode(found, num_threads=1), strict=True):
            self.ids[chunk] = struct.pack(f"<{len(ids)}I", *ids)
            self.text[chunk] = " " + text

    def code(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Each text's ids, with begin and end, as little-endian unsigned 32-bit integers, and the text they decode to."""
        if self.whole:
            for text in texts:
                ids = self.model.encode(text, add_bos=True, add_eos=True)
                yield struct.pack(f"<{len(ids)}I", *ids), self.model.decode(ids)
            return
        cut = [self.cut(text) for text in texts]
        chunks = set().union(*cut)
        if len(self.ids) + len(chunks.difference(self.ids)) > KEPT_CHUNKS:
            self.ids, self.text = {}, {}
        new = list(chunks.difference(self.ids))
        if new:
            self.learn(new)
        for places in cut:
            yield (b"".join([self.begin, *map(self.ids.__getitem__, places), self.end]),
                   "".join(map(self.text.__getitem__, places))[1:])
        for chunk in new:
            if len(chunk) > KEPT_LENGTH:
                del self.ids[chunk], self.text[chunk]


def code(df: DataFrame, model: str = "piece_bpe_32k.model", outputs: tuple[str, ...] = ("ids", "decoded"),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row in: doc_id, n_tokens and what ``outputs`` names of ids, decoded, ids_sha256, decoded_sha256.

    ids are token ids as an array of int, begin and end included; decoded is the text they give. Null and empty texts
    have the begin and end ids only and decode to the empty text. A very long text is handled alone, whole. Null ids and
    repeated rows pass through, each on its own; other columns are ignored, and an empty table gives no rows. A model
    whose pieces cross markers, or that rewrites texts, is applied to whole texts.
    """
    kinds = {"ids": (pa.list_(pa.int32()), "array<int>", lambda ids, text: np.frombuffer(ids, "<u4").astype(np.int32)),
             "decoded": (pa.string(), "string", lambda ids, text: text),
             "ids_sha256": (pa.string(), "string", lambda ids, text: hashlib.sha256(ids).hexdigest()),
             "decoded_sha256": (pa.string(), "string", lambda ids, text: hashlib.sha256(text.encode()).hexdigest())}
    wanted = [kinds[name] for name in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ChunkTable(load(model))  # ends with the task
        for batch in batches:
            for part in slices(batch, "text"):
                sizes: list[int] = []
                made: list[list] = [[] for _ in wanted]
                for ids, text in held.code(part.column("text").to_pylist()):
                    sizes.append(len(ids) // 4)
                    for values, (_, _, make) in zip(made, wanted, strict=True):
                        values.append(make(ids, text))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()),
                     *[pa.array(values, kind) for values, (kind, _, _) in zip(made, wanted, strict=True)]],
                    ["doc_id", "n_tokens", *outputs])

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = ", ".join([f"doc_id {df.schema[id_col].dataType.simpleString()}", "n_tokens long",
                        *[f"{name} {kind}" for name, (_, kind, _) in zip(outputs, wanted, strict=True)]])
    return rows.mapInArrow(run, schema)


def op13_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded documents as digests."""
    return code(table(spark, sf_dir, "documents"), outputs=("ids_sha256", "decoded_sha256"))
