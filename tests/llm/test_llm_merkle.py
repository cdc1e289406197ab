import hashlib
from zlib import crc32

import pytest
from hydromelt.llm import merkle
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """All levels of a tree, lists of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    path = []
    for nodes in levels[:-1]:
        first = at - at % 3
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + 3])))
        at //= 3
    return path


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        trees[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    low = {s: climb([leaf(r) for r in trees[s]]) for s in order}
    high = climb([low[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for at, row in enumerate(trees[s]):
            path = siblings(low[s], at) + siblings(high, place)
            hit = row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            folded = leaf((*row[:4], row[4].replace("\n", ""))) if hit else leaf(row)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((row[0], leaf(row), low[s][-1][0], high[-1][0], h(*[a + b for a, b in path]), folded, folded == high[-1][0]))
    return sorted(out, key=repr)


def query(spark, df, monkeypatch):
    monkeypatch.setattr(merkle, "table", lambda *_: df)
    return sorted(map(tuple, merkle.op12_lag_lead_manifest(spark, "").collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [3, 4], [9, 10, 28, 1], [1] * 14, [82, 5]])
def test_trees_of_many_sizes(spark, monkeypatch, sizes):
    """Whole, ragged and lone runs, and blocks so small that several rounds are needed."""
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "SPAN", 9)
    rows = [(1000 * s + i, f"s{s}", "en", i, f"line\n{i}") for s, size in enumerate(sizes) for i in range(size)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert query(spark, df, monkeypatch) == brute(rows)


def test_odd_rows(spark, monkeypatch, odd_docs):
    """Null ids and sources, repeated rows, very long and empty texts, other scripts, clashing columns."""
    df = odd_docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "é").otherwise("z"))
    df = df.withColumns({c: F.lit(1) for c in ("tree", "at", "n", "digest", "leaf", "path", "tie", "spot")})
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert query(spark, df, monkeypatch) == brute(rows)


def test_no_rows(spark, monkeypatch, no_docs):
    assert query(spark, no_docs, monkeypatch) == []


def test_general_interface(spark, make_docs):
    """Paths as they are: folding each leaf with its siblings gives the root, and other columns can be proven."""
    rows = merkle.prove(make_docs([f"t{i}" for i in range(30)]), "lang", columns=("doc_id", "text")).select(
        "*", merkle.fold(F.col("leaf"), F.col("path")).alias("again")).collect()
    assert len(rows) == 30 and all(r["again"] == r["root"] == r["subroot"] for r in rows)
    assert {r["leaf"] for r in rows} == {leaf((i, f"t{i}")) for i in range(30)}
    assert len({r["root"] for r in rows}) == 1 and {len(r["path"]) for r in rows} == {4}


def test_query_over_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    assert sorted(map(tuple, merkle.op12_lag_lead_manifest(spark, sf_dir).collect()), key=repr) == brute(rows)
