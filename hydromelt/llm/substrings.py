"""Removal of long repeated word runs through a compacted de Bruijn graph.

Edges are the k-mers of k words, nodes the overlaps of k - 1 words. A document is a walk, cut where the smallest m-mer of
its k-mers changes: the edges of one piece follow each other without a choice, and equal k-mers always lie in pieces
with the same smallest m-mer. So pieces stand for their edges (compaction) as long as they repeat as a whole:

1. Equal pieces are joined into one path with its first source document.
2. Where different paths share the smallest m-mer the graph may branch: those paths are opened into single edges.
3. At their source coordinates the words of all repeated pieces and opened edges are read again; digests of the words
   themselves decide which repeat in a smaller document. Hashes only choose what is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import session
from hydromelt.llm.common import slices, table, utf8
from hydromelt.llm.hashing import Runs, Words, signed

#: Words of an edge, and of the m-mers that cut a walk into pieces.
EDGE = 50
SEED = 8


def pieces_of(hashes: np.ndarray, edge: int = EDGE, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Starts, edge counts, smallest m-mers and contents of a document's pieces."""
    runs = Runs(hashes)
    seeds = runs.every(seed)
    windows = sliding_window_view(seeds, edge - seed + 1)
    anchors = windows.argmin(axis=1) + np.arange(len(windows))
    starts = np.flatnonzero(np.diff(anchors, prepend=-1))
    counts = np.diff(starts, append=len(anchors))
    return starts, counts, seeds[anchors[starts]], runs.of(starts, starts + counts + edge - 1)


def cut_pieces(docs: DataFrame, edge: int = EDGE, seed: int = SEED) -> DataFrame:
    """doc, version, start, edges, seed, content: one row per piece of the walks of ``docs`` (doc, version, raw)."""
    names = ["doc", "version", "start", "edges", "seed", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for part in slices(batch, "raw"):
                rows, found = [], []
                texts = [raw.split() for raw in part.column("raw").to_pylist()]
                known.learn(*texts)
                for i, words in enumerate(texts):
                    if len(words) >= edge:
                        found.append(pieces_of(known.hashes(words), edge, seed))
                        rows.append(np.full(len(found[-1][0]), i))
                if found:
                    at = pa.array(np.concatenate(rows))
                    starts, counts, seeds, contents = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc").take(at), part.column("version").take(at), pa.array(starts.astype(np.int32)),
                         pa.array(counts.astype(np.int32)), pa.array(signed(seeds)), pa.array(signed(contents))], names)

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, version long, start int, edges int, seed long, content long")


def to_verify(pieces: DataFrame) -> DataFrame:
    """doc, version, start, edges, opened: the pieces that may repeat, to be read again whole or edge by edge."""
    paths = pieces.groupBy("seed", "content").agg(F.min("doc").alias("source"), F.max("doc").alias("last"))
    branching = paths.groupBy("seed").agg((F.min("content") != F.max("content")).alias("forks"),
                                          (F.min("source") != F.max("source")).alias("spread"))
    known = paths.join(branching.where("forks AND spread").select("seed", F.lit(True).alias("branches")), "seed", "left").where(
        "branches OR source < last").withColumn("branches", F.coalesce("branches", F.lit(False)))
    # Written aside, so that both sides of the join are shuffled for it alone and a frequent path's partition can be split.
    paths = session.stage(known, "paths")
    held = pieces.join(paths, ["seed", "content"])
    # Later documents lose a repeated path as a whole; only its first one can share single edges with other paths.
    opened = F.col("branches") & (F.col("doc") == F.col("source"))
    kinds = F.filter(F.array(F.when(F.col("source") < F.col("last"), F.lit(False)), F.when(opened, F.lit(True))), lambda k: k.isNotNull())
    wanted = session.stage(held.select("doc", "version", "start", "edges", F.explode(kinds).alias("opened")).distinct(), "wanted")
    session.release(paths)
    return wanted


def read_again(docs: DataFrame, wanted: DataFrame, edge: int = EDGE) -> DataFrame:
    """doc, version, start, edges, digest: digests of the words at the wanted coordinates."""
    places = wanted.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "edges", "opened")).alias("places"))
    names = ["doc", "version", "start", "edges", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                rows, starts, counts, digests = [], [], [], []
                for i, (raw, spots) in enumerate(zip(part.column("raw").to_pylist(), part.column("places").to_pylist(),
                                                     strict=True)):
                    words = raw.split()
                    for spot in spots:
                        start, edges = spot["start"], spot["edges"]
                        runs = [(s, 1) for s in range(start, start + edges)] if spot["opened"] else [(start, edges)]
                        for s, n in runs:
                            rows.append(i)
                            starts.append(s)
                            counts.append(n)
                            digests.append(hashlib.blake2b(b" ".join(words[s:s + n + edge - 1]), digest_size=16).digest())
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(at), part.column("version").take(at), pa.array(starts, pa.int32()),
                     pa.array(counts, pa.int32()), pa.array(digests, pa.binary())], names)

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.join(places, ["doc", "version"]).select("doc", "version", "raw", "places").mapInArrow(
        run, f"doc {kind}, version long, start int, edges int, digest binary")


def versions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, version, raw: texts as bytes. The version tells rows with the same id but different texts apart."""
    return df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), utf8(text_col).alias("raw")).withColumn("version", F.xxhash64("raw"))


def repeated_spans(df: DataFrame, edge: int = EDGE, seed: int = SEED, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc, version, spans: the runs (first word, end, source document) of words whose k-mers start in a smaller document."""
    docs = versions(df, id_col, text_col)
    pieces = session.stage(cut_pieces(docs, edge, seed), "pieces")
    wanted = to_verify(pieces)
    session.release(pieces)
    read = session.stage(read_again(docs, wanted, edge), "read-again")
    session.release(wanted)
    first = session.stage(read.groupBy("digest").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where(
        "source < last"), "repeated")
    hits = read.join(first, "digest").where("doc > source")
    span = F.struct("start", (F.col("start") + F.col("edges") + (edge - 1)).alias("end"), "source")
    # A document has no more spans than words.
    spans = session.stage(hits.groupBy("doc", "version").agg(F.collect_set(span).alias("spans")), "spans")
    session.release(read, first)
    return spans


def without(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    """The words that no span covers."""
    if not spans:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, [s["start"] for s in spans], 1)
    np.add.at(edges, [s["end"] for s in spans], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def with_spans(df: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, raw, spans: the rows of ``df`` as structs, with their texts as bytes and their spans."""
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), utf8(text_col).alias("raw")).withColumn(
        "version", F.xxhash64("raw"))
    return rows.join(spans, ["doc", "version"], "left").select("row", "raw", "spans")


def remove_repeats(df: DataFrame, edge: int = EDGE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
                   outputs: tuple[str, ...] = ("kept", "spans")) -> DataFrame:
    """One row per row in: doc_id, n_words, n_removed and what ``outputs`` names of kept, kept_sha256, spans.

    A word goes if a run of ``edge`` words around it starts in a document with a smaller id too, judged on the input.
    kept are the words left, joined by one space; spans the removed runs with their source documents. Null texts have no
    words. Rows with a null id are neither changed nor a source. Rows that share an id are one document's: none is a source
    for the other. Very long texts are read whole, each alone. Other columns are ignored; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    spans = repeated_spans(df, edge, seed, id_col, text_col)
    rows = with_spans(df.select(id_col, text_col), spans, id_col, text_col).select(
        F.col("row")[id_col].alias("doc_id"), "raw", "spans")
    made = [name for name in outputs if name != "spans"]
    makers = {"kept": bytes.decode, "kept_sha256": lambda kept: hashlib.sha256(kept).hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                texts = [raw.split() for raw in part.column("raw").to_pylist()]
                left = [without(w, s) for w, s in zip(texts, part.column("spans").to_pylist(), strict=True)]
                kept = [b" ".join(words) for words in left]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, texts), pa.int64()),
                     pa.array([len(a) - len(b) for a, b in zip(texts, left, strict=True)], pa.int64()),
                     *[pa.array(map(makers[name], kept), pa.string()) for name in made], part.column("spans")],
                    ["doc_id", "n_words", "n_removed", *made, "spans"])

    schema = ", ".join([f"doc_id {kind}, n_words long, n_removed long", *[f"{name} string" for name in made],
                        f"spans {rows.schema['spans'].dataType.simpleString()}"])
    return rows.mapInArrow(run, schema).select("doc_id", "n_words", "n_removed", *outputs)


def drop_repeats(df: DataFrame, edge: int = EDGE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns; texts that lose words become the words left, joined by one space, others stay as they are.

    Null and empty texts stay; so do rows with a null id. Repeated rows, and rows that share an id, are one document's: each comes
    back, and none is a source for the other. Very long texts are read whole, each alone. An empty table gives no rows.
    """
    spans = repeated_spans(df, edge, seed, id_col, text_col)
    rows = with_spans(df, spans, id_col, text_col)
    names, place = df.columns, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                columns = part.column("row").flatten()
                texts = [text if not found else b" ".join(without(text.encode().split(), found)).decode() for text, found in zip(
                    columns[place].to_pylist(), part.column("spans").to_pylist(), strict=True)]
                columns[place] = pa.array(texts, columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, df.schema)


def op5_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of 50 words that a smaller document holds too."""
    return remove_repeats(table(spark, sf_dir, "documents"), outputs=("kept_sha256",))


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
runs AS (
  SELECT doc_id, pos, array_to_string(w[pos:pos + 49], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM words)),
first AS (SELECT run, min(doc_id) AS source FROM runs GROUP BY run HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, pos + unnest(range(50)) AS pos
  FROM (SELECT doc_id, pos FROM runs JOIN first USING (run) WHERE doc_id > source)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words) AS each
  ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
