"""Merkle manifest of a dataset: a tree of hashes per group and one over the groups' roots.

Levels are built with lag and lead windows. Rows of a tree stand in blocks of ``SPAN`` = 3 ** ``HEIGHT`` places; inside a
block, the nodes of level l stand at every 3 ** l-th row, so that siblings are found at fixed offsets, masked by a node's
slot among its siblings and by the length of their run, and first-child rows hold the parents' hashes. The blocks' tops
are the rows of the next round. No window sees more than one block, however large its group is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydromelt import session
from hydromelt.llm.common import table

#: Nodes under one parent, levels that one round of windows builds, and places of a block.
FANOUT = 3
HEIGHT = 6
SPAN = FANOUT ** HEIGHT
#: Place of a partition's number in Spark's increasing ids.
_PARTITION = 33


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the joined parts; null parts count as empty."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def leaf(*columns: Column) -> Column:
    """A row's hash: each value with its UTF-8 length before it, so that no two rows read alike; ``-`` for null."""
    def spelled(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return digest(*map(spelled, columns))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf hash and its siblings lead to."""
    return F.aggregate(path, start, lambda held, step: digest(step["left"], held, step["right"]))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def group_key(column: str) -> Column:
    """A group as text that is never null, in the order of groups: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


@dataclass(frozen=True)
class Placed:
    """Rows numbered inside their trees: tree, at (from 0), n (rows of the tree), digest and others; n of the largest tree."""

    rows: DataFrame
    tallest: int


def place(rows: DataFrame, order: list[Column]) -> Placed:
    """Numbers the rows of each ``tree`` by ``order``, rows alike in all of it in any order.

    Rows are dealt and sorted by range, so a large tree covers many partitions; a row's number is its place in its
    partition plus the rows of its tree in partitions before.
    """
    rows = session.stage(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-rows")
    order = [F.col("tree"), *order, F.col("tie")]
    # Sorted rows are written with consecutive ids, which say where each of them stands.
    dealt = session.stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "spot", F.monotonically_increasing_id()).withColumn("part", F.shiftright("spot", _PARTITION)).drop("tie"), "merkle-order")
    sizes = dealt.groupBy("tree", "part").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("held"))
    # As many rows as partitions and trees.
    earlier = Window.partitionBy("tree").orderBy("part")
    sizes = session.stage(sizes.select(
        "tree", "part", F.sum("held").over(Window.partitionBy("tree")).alias("n"),
        (F.sum("held").over(earlier.rowsBetween(Window.unboundedPreceding, 0)) - F.col("held") - F.col("first")).alias("shift")),
        "merkle-sizes")
    placed = dealt.join(sizes, ["tree", "part"]).withColumn("at", F.col("spot") + F.col("shift")).drop("spot", "part", "shift")
    return Placed(placed, sizes.agg(F.max("n")).first()[0] or 0)


def levels(rows: DataFrame, most: int) -> DataFrame:
    """For trees of up to ``most`` rows, adds each row's ``block``, the ``path`` of siblings up to its block's top, and ``top`` on the block's first row."""
    inside = Window.partitionBy("tree", "block").orderBy("at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.floor(F.col("at") / SPAN).alias("block"), F.col("digest").alias("top"), no_path().alias("path"))
    carried = [c for c in rows.columns if c not in ("top", "path")]
    nothing = F.lit("")
    for level in range(HEIGHT):
        step = FANOUT ** level
        if step >= most:  # all trees are one node by now
            break
        rows = rows.select(
            "*", F.lag("top", step).over(inside).alias("back1"), F.lag("top", 2 * step).over(inside).alias("back2"),
            F.lead("top", step).over(inside).alias("on1"), F.lead("top", 2 * step).over(inside).alias("on2"))
        number, nodes = F.floor(F.col("at") / step), F.ceil(F.col("n") / step)
        slot = number % FANOUT
        run = F.least(F.lit(FANOUT), nodes - number + slot)
        node = F.col("top").isNotNull()
        left = F.when(slot == 1, F.col("back1")).when(slot == 2, F.concat("back2", "back1")).otherwise(nothing)
        right = F.concat(F.when(slot + 1 < run, F.col("on1")).otherwise(nothing),
                         F.when(slot + 2 < run, F.col("on2")).otherwise(nothing))
        # Rows between two nodes take the siblings of the node before; a tree of one node left is done.
        siblings = F.last(F.when(node, F.struct(left.alias("left"), right.alias("right"))), True).over(so_far)
        path = F.when(nodes > 1, F.concat("path", F.array(siblings))).otherwise(F.col("path"))
        parent = F.when(nodes > 1, digest(F.col("top"), right)).otherwise(F.col("top"))
        rows = rows.select(*carried, path.alias("path"), F.when(node & (slot == 0), parent).alias("top"))
    return rows


def climb(placed: Placed) -> list[Placed]:
    """Each round; the last has one row per tree, whose digest is the tree's root."""
    rounds = [placed]
    while (most := rounds[-1].tallest) > 1:
        tops = levels(rounds[-1].rows, most).where(F.col("at") % SPAN == 0).select(
            "tree", F.col("block").alias("at"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("top").alias("digest"))
        rounds.append(Placed(session.stage(tops, "merkle-tops"), -(-most // SPAN)))
    return rounds


def descend(rounds: list[Placed], roots: DataFrame) -> DataFrame:
    """Rows of the first round with their whole ``path``, given each tree's row of ``roots``: tree, above and others."""
    others = [c for c in roots.columns if c not in ("tree", "above")]
    upper = roots.withColumn("block", F.lit(0).cast("long"))
    if len(rounds) == 1:  # trees of one row each
        return rounds[0].rows.join(roots.withColumnRenamed("above", "path"), "tree")
    for placed in reversed(rounds[:-1]):
        below = levels(placed.rows, placed.tallest).join(upper, ["tree", "block"]).withColumn("path", F.concat("path", "above")).drop("above")
        upper = below.select("tree", F.col("at").alias("block"), F.col("path").alias("above"), *others)
    return below


def prove(df: DataFrame, group_col: str = "source", order_col: str = "doc_id",
          columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row in: the columns of ``keep``, leaf, subroot, root, and path, an array of (left, right) siblings.

    A leaf hashes ``columns``; the leaves of a group stand in order of ``order_col``, null first, then by their hashes,
    so repeated rows are leaves of their own. Null is a group. A group's lone leaf is its subroot, and a lone subroot the
    root. Nulls, empty and very long texts hash like other values; other columns are ignored, and names in ``keep`` may
    be any but tree, at, n, digest, part, spot, tie and those returned. An empty table gives no rows.
    """
    keep = {order_col: F.col(order_col)} if keep is None else keep
    leaves = df.select(group_key(group_col).alias("tree"), F.col(order_col).alias("order"), leaf(*map(F.col, columns)).alias("digest"),
                       *[column.alias(name) for name, column in keep.items()])
    rounds = climb(place(leaves, [F.col("order").asc_nulls_first(), F.col("digest")]))
    groups = rounds[-1].rows.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    upper = climb(place(groups, [F.col("of")]))
    root = upper[-1].rows.select("digest").first()  # one row, or none
    found = descend(upper, upper[-1].rows.select("tree", no_path().alias("above")))
    roots = found.select(F.col("of").alias("tree"), F.col("path").alias("above"), F.col("digest").alias("subroot"))
    return descend(rounds, session.stage(roots, "merkle-roots")).select(
        *keep, F.col("digest").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path")


def op12_lag_lead_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and what a text that lost its line breaks leads to."""
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = leaf(*[F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns])
    proved = prove(docs, columns=columns, keep={"doc_id": F.col("doc_id"), "tampered": F.when(hit, cut)})
    return proved.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


#: crc32 of a number's digits, from its polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), " \
       "lambda letter: ascii(letter)::BIGINT)), lambda held, byte: xor(held >> 8, entries[(xor(held, byte) & 255) + 1])), " \
       "4294967295::BIGINT)"


def _spelled(text: str) -> str:
    def value(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"
    return "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"


OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda entry: list_reduce(
        list_prepend(entry::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda held, bit: xor(held >> 1, (held & 1) * 3988292384::BIGINT))) AS entries),
leaves AS MATERIALIZED (SELECT doc_id, source, {_spelled("text")} AS leaf,
        CASE WHEN {_CRC} % 2 = 0 THEN {_spelled("replace(text, chr(10), '')")} ELSE {_spelled("text")} END AS begun
    FROM documents, crc),
placed AS MATERIALIZED (SELECT *, coalesce('=' || source, '') AS tree, count(*) OVER (PARTITION BY source) AS n,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM leaves),
low AS (SELECT tree, 0 AS level, 1::BIGINT AS width, spot, n, leaf AS digest FROM placed
    UNION ALL SELECT tree, level + 1, width * 3, spot // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY spot)) FROM low WHERE n > 1
    GROUP BY tree, level, width, spot // 3, n),
subroots AS (SELECT tree, digest AS subroot, level AS height, count(*) OVER () AS n,
        row_number() OVER (ORDER BY tree) - 1 AS spot FROM low WHERE n = 1),
high AS (SELECT 0 AS level, 1::BIGINT AS width, spot, n, subroot AS digest FROM subroots
    UNION ALL SELECT level + 1, width * 3, spot // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY spot)) FROM high WHERE n > 1
    GROUP BY level, width, spot // 3, n),
steps AS (SELECT p.doc_id, p.leaf AS own, p.spot AS place, p.tree AS of, l.level,
        string_agg(l.digest, '' ORDER BY l.spot) FILTER (WHERE l.spot < p.spot // l.width) AS before,
        string_agg(l.digest, '' ORDER BY l.spot) FILTER (WHERE l.spot > p.spot // l.width) AS behind
    FROM placed p JOIN low l ON l.tree = p.tree AND l.n > 1 AND l.spot // 3 = (p.spot // l.width) // 3
    GROUP BY ALL
    UNION ALL SELECT p.doc_id, p.leaf, p.spot, p.tree, s.height + h.level,
        string_agg(h.digest, '' ORDER BY h.spot) FILTER (WHERE h.spot < s.spot // h.width),
        string_agg(h.digest, '' ORDER BY h.spot) FILTER (WHERE h.spot > s.spot // h.width)
    FROM placed p JOIN subroots s ON s.tree = p.tree JOIN high h ON h.n > 1 AND h.spot // 3 = (s.spot // h.width) // 3
    GROUP BY ALL),
folded AS (SELECT tree, spot, 0 AS level, begun AS digest FROM placed
    UNION ALL SELECT f.tree, f.spot, f.level + 1, sha256(coalesce(s.before, '') || f.digest || coalesce(s.behind, ''))
    FROM folded f JOIN steps s ON s.of = f.tree AND s.place = f.spot AND s.level = f.level),
ended AS (SELECT tree, spot, max_by(digest, level) AS folded_root FROM folded GROUP BY tree, spot),
proofs AS (SELECT of, place, string_agg(coalesce(before, '') || coalesce(behind, ''), '' ORDER BY level) AS proof
    FROM steps GROUP BY of, place)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(coalesce(x.proof, '')) AS proof_sha256, e.folded_root,
       e.folded_root = r.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN ended e ON e.tree = p.tree AND e.spot = p.spot
JOIN high r ON r.n = 1 LEFT JOIN proofs x ON x.of = p.tree AND x.place = p.spot
"""
