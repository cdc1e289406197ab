"""Near-duplicate groups by circulant MinHash.

One permutation shuffles the universe of shingles, a second one, shifted circularly once per coordinate, gives all
coordinates of a signature. Bands of coordinates put documents into buckets. In rounds, every member of a bucket is
compared with a centre of the bucket; what no centre has joined is compared by the rarest shingles that two sets over the
threshold must share. All links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import session
from hydromelt.llm.common import slices, table, utf8
from hydromelt.llm.graph import components
from hydromelt.llm.hashing import Runs, Words, mix, signed

SHINGLE = 5
#: Two documents are linked if 100 * shared >= PERCENT * united shingles.
PERCENT = 75
#: A pair right at the threshold shares none of the bands with a chance of (1 - 0.75 ** ROWS) ** BANDS = 2.6e-8.
ROWS, BANDS = 3, 32
#: Rounds of comparing with centres before the rest is compared by shared shingles.
ROUNDS = 1
#: Shingles whose coordinates are made at once, so that numpy's arrays stay in the processor's cache.
BLOCK = 1 << 14


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes; a shorter text is one shingle, an empty one none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(Runs(hashes).every(min(size, len(hashes))))


def circulant(shingles: np.ndarray, starts: np.ndarray, coordinates: int = ROWS * BANDS) -> np.ndarray:
    """Signatures, one row each, of sets that follow each other in ``shingles``: ``starts`` has where each begins, and the end.

    The universe has 2**32 places. The first permutation is the shingles' own hash; the second is a 32-bit bijection, read
    with a circular shift of one step per coordinate. Sets are taken block by block, whatever their sizes.
    """
    sets = np.flatnonzero(np.diff(starts))  # an empty set keeps the largest value
    found = np.full((coordinates, len(starts) - 1), np.iinfo(np.uint32).max, np.uint32)
    places, firsts = shingles.astype(np.uint32), starts[sets]  # modulo 2**32
    x, y = np.empty(BLOCK, np.uint32), np.empty(BLOCK, np.uint32)
    for at in range(0, len(places), BLOCK):
        block = places[at:at + BLOCK]
        a, b = np.searchsorted(firsts, [at, at + len(block)], side="left")
        a -= a == len(firsts) or firsts[a] > at  # the set that reaches into the block
        spots, of = np.maximum(firsts[a:b] - at, 0), sets[a:b]
        u, v = x[:len(block)], y[:len(block)]
        for k in range(coordinates):
            np.add(block, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), out=u)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
                np.right_shift(u, np.uint32(shift), out=v)
                np.bitwise_xor(u, v, out=u)
                if factor > 1:
                    np.multiply(u, np.uint32(factor), out=u)
            found[k, of] = np.minimum(found[k, of], np.minimum.reduceat(u, spots))
    return found.T


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per signature and band; equal coordinates in different bands give different keys."""
    bands = signatures.reshape(len(signatures), -1, rows).astype(np.uint64)
    keys = np.arange(1, bands.shape[1] + 1, dtype=np.uint64)
    for column in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, column])
    return keys


def lowered(raw: bytes) -> list[bytes]:
    """Words with A-Z in lower case."""
    return raw.lower().split()


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc, version, n_shingles, node, bands of ``docs`` (doc, version, raw). The node is a digest of the whole set."""
    names = ["doc", "version", "n_shingles", "node", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for part in slices(batch, "raw"):
                texts = [lowered(raw) for raw in part.column("raw").to_pylist()]
                known.learn(*texts)
                sets = [shingle_set(known.hashes(words), shingle) for words in texts]
                sizes = [len(found) for found in sets]
                nodes = [hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None for found in sets]
                keys = signed(band_keys(circulant(np.concatenate(sets), np.cumsum([0, *sizes]))))
                bands = [row if size else None for row, size in zip(keys, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("version"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))], names)

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, version long, n_shingles long, node binary, bands array<long>")


def linked(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """a, b of the pairs whose full sets are similar enough. ``texts``: node, raw."""
    held = pairs.join(texts.select(F.col("node").alias("a"), F.col("raw").alias("raw_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("raw").alias("raw_b")), "b").sortWithinPartitions("b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, centre, centre_set = Words(), None, None
        for batch in batches:
            for part in slices(batch, "raw_a"):
                keep = []
                for b, raw_a, raw_b in zip(*(part.column(n).to_pylist() for n in ("b", "raw_a", "raw_b")), strict=True):
                    words, others = lowered(raw_a), None
                    if b != centre:
                        others = lowered(raw_b)
                    known.learn(words, others or ())
                    if others is not None:
                        centre, centre_set = b, shingle_set(known.hashes(others), shingle)
                    mine = shingle_set(known.hashes(words), shingle)
                    shared = len(np.intersect1d(mine, centre_set, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(mine) + len(centre_set) - shared))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))

    return held.select("a", "b", "raw_a", "raw_b").mapInArrow(run, "a binary, b binary")


def may_link(size_a: str, size_b: str, percent: int = PERCENT) -> F.Column:
    """Sets that differ more in size cannot be similar enough."""
    return (100 * F.least(size_a, size_b)) >= percent * F.greatest(size_a, size_b)


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (node) with ``root``: their component, or themselves."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def open_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets (key, node, ...), with roots, whose members are not all in one component yet."""
    rows = with_roots(buckets, roots)
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rows.join(mixed, "key")


def prefix_pairs(rows: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """a, b: all pairs of ``rows`` (node, n_shingles, root) in different components that may be similar enough.

    Exact: with shingles ordered from the rarest, two sets over the threshold share one among the first
    size - ceil(percent * size / 100) + 1 of each, and behind the first shared one enough must be left in both. What many
    texts hold comes last and so is not joined on, and the rare shingles of a copy with many changes rule out its whole
    group. Shingles whose holders are all in one component are left out before the join.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for part in slices(batch, "raw"):
                texts = [lowered(raw) for raw in part.column("raw").to_pylist()]
                known.learn(*texts)
                sets = [signed(shingle_set(known.hashes(words), shingle)) for words in texts]
                at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(at), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))],
                    ["node", "shingle"])

    held = texts.join(rows.select("node"), "node").select("node", "raw").mapInArrow(run, "node binary, shingle long")
    counts = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    # A shingle of one text alone links nothing, but it takes its place in the order: only numbers are kept of those.
    ranked = held.join(counts.where("n > 1"), "shingle")
    shared = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("shared"))
    first = F.col("n_shingles") - F.ceil(F.lit(percent) * F.col("n_shingles") / 100) + 1
    alone = F.col("n_shingles") - F.size("shared")
    prefix = F.slice("shared", F.lit(1), F.greatest(first - alone, F.lit(0)).cast("int"))
    tokens = rows.join(shared, "node").select(
        "node", "n_shingles", "root", F.posexplode(prefix["shingle"]).alias("place", "shingle"), alone.alias("alone")).select(
        "shingle", "node", "root", F.col("n_shingles").alias("size"), (F.col("n_shingles") - F.col("alone") - F.col("place")).alias("left"))
    tokens = session.stage(tokens, "tokens")
    mixed = tokens.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    tokens = tokens.join(mixed, "shingle", "left_semi")
    left, right = (tokens.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "size", "left")]) for side in "ab")
    enough = F.least("left_a", "left_b") * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b"))
    return left.join(right, "shingle").where(
        (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & enough & may_link(
            "size_a", "size_b", percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicates(df: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row in: doc_id, version, n_shingles, component_id, kept. The version is a hash of the text.

    component_id is the smallest id that a document reaches over links, its own included; kept marks that document. Texts
    without words, null ones too, are linked with nothing; very long ones are compared by their whole sets. Rows with a null id are linked with nothing and kept. Equal
    sets share a node, so copies are never paired; repeated rows get a row each. Other columns are ignored; an empty
    table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("doc"), utf8(text_col).alias("raw")).withColumn("version", F.xxhash64("raw"))
    sketches = session.stage(sketch(docs, shingle), "sketches")
    usable = sketches.where("node IS NOT NULL AND doc IS NOT NULL")
    nodes = usable.groupBy("node").agg(F.min(F.struct("doc", "version")).alias("first"), F.first("n_shingles").alias("n_shingles"),
                                       F.first("bands").alias("bands"))
    rows = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = session.stage(rows.join(crowded, "key"), "shared")
    # Who meets many others in its buckets has few changes of its own and makes a good centre.
    central = shared.groupBy("node").agg(F.sum("members").alias("met"))
    buckets = session.stage(shared.drop("members").join(central, "node"), "buckets")

    chosen = buckets.select("node").distinct().join(nodes.select("node", "first.*"), "node")
    texts = session.stage(docs.join(chosen, ["doc", "version"]).select("node", "raw").dropDuplicates(["node"]), "texts")
    found = []
    empty = df.sparkSession.createDataFrame([], "node binary, root binary")
    roots = empty
    for turn in range(ROUNDS):
        # The first centres are the most central members, later ones any; members of a centre's own component need no comparison.
        pending = open_buckets(buckets, roots)
        centres = pending.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("n_shingles").alias("size_b"), F.col(
            "root").alias("root_b")), F.struct(F.lit(turn) * F.xxhash64("node", F.lit(turn)), -F.col("met"), "node")).alias("centre")).select(
            "key", "centre.*")
        pairs = pending.join(centres, "key").where((F.col("root") != F.col("root_b")) & may_link(
            "n_shingles", "size_b", percent)).select(F.col("node").alias("a"), "b").distinct()
        found.append(session.stage(linked(pairs, texts, percent, shingle), "confirmed"))
        roots = components(reduce(DataFrame.unionByName, found))
    rest = open_buckets(buckets, roots).select("node", "n_shingles", "root").distinct()
    found.append(session.stage(linked(prefix_pairs(session.stage(rest, "rest"), texts, percent, shingle), texts, percent, shingle),
                               "confirmed"))
    if found[-1].take(1):
        roots = components(reduce(DataFrame.unionByName, found))

    grouped = with_roots(nodes.select("node", F.col("first.doc").alias("doc")), roots)
    smallest = grouped.groupBy("root").agg(F.min("doc").alias("component_id"))
    ids = grouped.join(smallest, "root").select("node", "component_id")
    out = sketches.drop("bands").join(ids, "node", "left")
    own = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias("doc_id"), "version", "n_shingles", own.alias("component_id"),
                      F.coalesce(F.col("doc") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of near duplicates: that of the smallest id. Rows with a null id all stay;
    of rows with the same id and text one stays."""
    groups = near_duplicates(df, percent, shingle, id_col, text_col)
    stay = groups.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "version").distinct()
    one = df.where(F.col(id_col).isNotNull()).select(
        F.struct("*").alias("row"), F.col(id_col).alias("doc"), F.xxhash64(utf8(text_col)).alias("version")).join(
        stay, ["doc", "version"]).dropDuplicates(["doc", "version"]).select("row.*")
    return one.unionByName(df.where(F.col(id_col).isNull()))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("version")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS pos FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_shared
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
  WHERE 100 * n_shared >= 75 * (p.n + q.n - n_shared)),
reach AS (
  WITH RECURSIVE step(doc, seen) AS (
    SELECT doc_id, doc_id FROM words UNION SELECT a, seen FROM step JOIN links ON doc = b)
  SELECT doc, min(seen) AS component_id FROM step GROUP BY doc)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN reach ON doc = doc_id
"""
