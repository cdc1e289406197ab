"""Nearest texts against comparing all with all."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydromelt.functions import similarity
from hydromelt.operators import matching
from hydromelt.operators import nearest as near
from hydromelt.operators.nearest import GramIndex, nearest, shared_at_least


@pytest.fixture(params=["indexed", "few"])
def way(request, monkeypatch):
    """Both ways of searching: the index, and entries few enough to be sent along."""
    if request.param == "indexed":
        monkeypatch.setattr(near, "FEW", -1)


def brute(asked, entries, limit):
    rows = set()
    for q in set(asked):
        if q:
            ranked = sorted((-similarity.ratio(q, text), seq, text) for seq, text in entries)[:limit]
            rows |= {(q, n + 1, text, seq, round(-score, 9)) for n, (score, seq, text) in enumerate(ranked)}
    return rows


def found(spark, asked, entries, limit, **kw):
    rows = nearest(spark.createDataFrame([(q,) for q in asked], "asked string"),
                   spark.createDataFrame(entries, "seq int, text string"), limit, **kw).collect()
    return {(r.asked, r.place, r.text, r.seq, round(r.ratio, 9)) for r in rows}


def words(chance, n, letters="abcdefg가나다", most=14):
    return ["".join(chance.choice(letters) for _ in range(chance.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize("limit", [1, 3])
def test_equals_comparing_all(spark, limit, way):
    """Near and far texts, ties, equal entries, null and empty texts, and texts without a letter in common."""
    chance = random.Random(limit)
    texts = words(chance, 150)
    entries = list(enumerate([*texts, *texts[:20], "", "q" * 90]))
    asked = [t[:5] + "x" + t[5:] for t in texts[:60]] + words(chance, 60) + ["zzz", "z", "q" * 70, "가나다" * 30, "", None, texts[0], texts[0]]
    assert found(spark, asked, entries, limit) == brute(asked, entries, limit)


def test_the_first_ratio_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(near, "FEW", -1)
    chance = random.Random(9)
    entries, asked = list(enumerate(words(chance, 60))), words(chance, 40)
    want = brute(asked, entries, 2)
    for floor in (0.7, 0.95, 1.0):
        assert found(spark, asked, entries, 2, floor=floor) == want


def test_few_or_no_entries(spark, way):
    assert found(spark, ["ab"], [(1, "xy"), (0, "ab")], 3) == {("ab", 1, "ab", 0, 100.0), ("ab", 2, "xy", 1, 0.0)}
    assert found(spark, ["ab"], [], 1) == set()
    assert found(spark, [], [(0, "ab")], 1) == set()


def test_bound_holds_for_random_pairs(spark):
    """No two texts share fewer grams than their ratio demands."""
    chance = random.Random(2)
    pairs = [(a, (a[:3] + b)[:12]) for a, b in zip(words(chance, 400, "abc"), words(chance, 400, "abc"), strict=True)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("ratio", similarity.common_letters(F.col("a"), F.col("b")) * 2 / (
        F.length("a") + F.length("b")))
    from hydromelt.operators.nearest import numbered_grams
    for size in (1, 2):
        held = F.size(F.array_intersect(numbered_grams(F.col("a"), size), numbered_grams(F.col("b"), size)))
        bound = shared_at_least(F.col("ratio"), F.length("a"), F.length("b"), size)
        checked = df.where(F.col("ratio") > (0 if size == 1 else 2 / 3))
        assert checked.where(held < bound).count() == 0 and checked.count() > 50


def test_bounds_of_few(spark, monkeypatch):
    entries = spark.createDataFrame([("abc", 1), ("de", 2)], "text string, seq int")
    assert [r["seq"] for r in near.few(entries)] == [1, 2]
    monkeypatch.setattr(near, "FEW_LETTERS", 4)
    assert near.few(entries) is None
    monkeypatch.setattr(near, "FEW_LETTERS", 2)
    assert near.few(entries) is None


def test_candidates_are_few(spark):
    """Of 3,000 random entries, under a twentieth is scored at a high ratio."""
    chance = random.Random(4)
    texts = words(chance, 3000, "abcdefghijklmnopqrstuvwxyz", 18)
    index = GramIndex(spark.createDataFrame([(t,) for t in set(texts)], "text string"), 2)
    asked = spark.createDataFrame([(t + "q",) for t in texts[:200] if len(t) > 8], "asked string").distinct()
    pairs = index.candidates(index.probes(asked), F.lit(0.85))
    assert pairs.count() < asked.count() * len(set(texts)) / 20 and pairs.select("asked").distinct().count() == asked.count()


def test_batches_equal_single_pairs():
    chance = random.Random(8)
    left = words(chance, 300, "ab가", 150) + ["", "a" * 64, "a" * 65, "ab" * 100]
    right = words(chance, 300, "ab가", 150) + ["abc", "a" * 64, "a" * 130, "ba" * 100]
    want = [similarity.common_subsequence(a, b) for a, b in zip(left, right, strict=True)]
    assert similarity.common_letters.func(pd.Series(left), pd.Series(right)).tolist() == want


def test_containment_equals_comparing_all(spark):
    chance = random.Random(6)
    short = [*words(chance, 60, "ab가", 5), "a", "", None, "zz"]
    long = [*words(chance, 80, "ab가z", 12), "a", "", None]
    pairs = matching.contained_in(spark.createDataFrame([(s,) for s in short], "s string"), "s",
                                  spark.createDataFrame([(t,) for t in long], "l string"), "l").collect()
    want = sorted((s, t) for s in short for t in set(long) if s and t and s in t)
    assert sorted(map(tuple, pairs)) == want
    keyed = matching.contained_in(
        spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "b")], "k int, s string"), "s",
        spark.createDataFrame([(1, "xab"), (2, "x"), (3, "abb")], "k int, l string"), "l", on=("k",)).collect()
    assert sorted((r.k, r.s, r.l) for r in keyed) == [(1, "ab", "xab"), (3, "b", "abb")]
