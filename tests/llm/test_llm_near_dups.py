import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydromelt.llm import graph, near_dups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), None if doc is None else least[find(i)], doc is None or least[find(i)] == doc)
                   for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted((tuple(r) for r in near_dups.near_duplicates(df).drop("version").collect()), key=str)


def family(chance, size, changes, words=120):
    base = [f"b{chance.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = base[:]
        for _ in range(chance.randint(0, changes)):
            copy[chance.randrange(words)] = f"c{chance.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_families_around_the_threshold(make_docs, seed):
    chance = random.Random(seed)
    texts = [t for changes in (1, 3, 4, 6, 9) for t in family(chance, 12, changes)]
    texts += [f"{t[:400]} {line}" for t in family(chance, 10, 60) for line in ["the same line of words in many texts " * 3]]
    texts += ["a b c", "A b C", "a b c d", "", None, " "] + texts[:5]
    chance.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(make_docs(rows)) == brute(rows)


def test_chains_without_a_common_centre(make_docs):
    """Each text is linked with its neighbours only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(50 - i, " ".join(words[8 * i:8 * i + 100])) for i in range(30)]
    want = brute(rows)
    assert len({r[2] for r in want}) == 1
    assert got(make_docs(rows)) == want


def test_rest_is_found_without_centres(make_docs, monkeypatch):
    """With no rounds of centres, shared rare shingles alone must find every link."""
    monkeypatch.setattr(near_dups, "ROUNDS", 0)
    chance = random.Random(9)
    rows = list(enumerate([t for changes in (2, 4, 7) for t in family(chance, 10, changes)]))
    assert got(make_docs(rows)) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert got(odd_docs) == brute(rows)
    assert got(no_docs) == []


def test_documents(spark, sf_dir, sf_docs):
    assert sorted((tuple(r) for r in near_dups.op6_circulant_minhash(spark, sf_dir).collect()), key=str) == brute(sf_docs)


def test_one_row_of_each_group_stays(odd_docs):
    df = near_dups.drop_near_duplicates(odd_docs)
    assert df.columns == odd_docs.columns
    ids = [r["doc_id"] for r in df.collect()]
    assert ids.count(None) == 2 and 4 in ids and 5 not in ids and 6 not in ids and 13 not in ids
    assert ids.count(8) == 1 and 9 not in ids and ids.count(7) == 1 and {0, 1, 2, 3, 10, 11, 12} <= set(ids)


def test_coordinates_agree_as_often_as_sets():
    chance = np.random.default_rng(4)
    universe = chance.integers(0, 2**63, 1500).astype(np.uint64)
    rates = []
    for _ in range(30):
        sets = [universe[:1000], universe[:0], universe[250:1250]]
        universe = chance.permutation(universe)
        found = near_dups.circulant(np.concatenate(sets), np.array([0, 1000, 1000, 2000]))
        rates.append((found[0] == found[2]).mean())
    assert abs(np.mean(rates) - 750 / 1250) < 0.03


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (1, 0)]
    rows = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, 101, 103], 100)}
    assert graph.components(spark.createDataFrame([], "a long, b long").where(F.lit(True))).count() == 0


def test_blocks_change_no_signature(monkeypatch):
    chance = np.random.default_rng(6)
    sizes = [0, 3, 700, 0, 1, 64, 128, 5, 0]
    sets = [chance.integers(0, 2**63, n).astype(np.uint64) for n in sizes]
    whole = near_dups.circulant(np.concatenate(sets), np.cumsum([0, *sizes]))
    for i, one in enumerate(sets):
        assert (whole[i] == near_dups.circulant(one, np.array([0, len(one)]))[0]).all()
    monkeypatch.setattr(near_dups, "BLOCK", 64)
    assert (near_dups.circulant(np.concatenate(sets), np.cumsum([0, *sizes])) == whole).all()
