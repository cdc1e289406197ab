import re

import numpy as np
import pytest

from hydromelt.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeats = sum(line in lines[:i] for i, line in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(again))


CASES = [None, "", " \n ", "a b c a b c d", "a a a a", "x\ny\nx\n x\n\x0bx\n\nx", "é|<> ü #b c", "one two", "1 2 3 4 1 2 3 1 2"]


def test_statistics_equal_brute_force(make_docs, sf_docs):
    texts = CASES + [t for _, t in sf_docs if len(t or "") < 4000][:60]
    rows = Q.judge(make_docs(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_many_distinct_words_take_the_other_way():
    chance = np.random.default_rng(1)
    ids = chance.integers(0, 12, 500)
    assert Q.repeated_words(ids, 12) == Q.repeated_words(ids, 1 << 22)


def test_estimation_finds_planted_chances():
    chance = np.random.default_rng(2)
    truth = chance.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.7, 0.85, 0.6])
    votes = np.where(chance.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[chance.random(votes.shape) < 0.3] = Q.ABSTAIN
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, chances, prior = Q.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.05
    assert np.abs(chances[1, :, 1] - 0.7 * right).max() < 0.05 and np.abs(chances[0, :, 0] - 0.7 * right).max() < 0.1
    best = (posterior[inverse.ravel()] >= 0.5) == truth
    majority = (np.where(votes == 1, 1, np.where(votes == 0, -1, 0)).sum(axis=1) > 0) == truth
    assert best.mean() > majority.mean() and best.mean() > 0.93


def test_labels_agree(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in Q.op4_weak_supervision(spark, sf_dir).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([r["kept"] == bool(labels[r["doc_id"]]) for r in rows]) > 0.9


def test_odd_and_empty(odd_docs, no_docs, make_docs):
    assert Q.judge(odd_docs).count() == odd_docs.count()
    assert Q.judge(no_docs).count() == 0
    assert [r["kept"] for r in Q.judge(make_docs(["too short"])).collect()] == [False]


@pytest.mark.parametrize("rule", Q.RULES, ids=lambda r: r.name)
def test_bounds_are_in_order(rule):
    assert rule.good_to is None or rule.good_to < rule.bad_from


def brute_em(votes, rounds=400):
    """Expectation-maximisation document by document, in plain loops."""
    n, rules = len(votes), len(votes[0])
    good = [(sum(v == Q.GOOD for v in row) + 1) / (sum(v != Q.ABSTAIN for v in row) + 2) for row in votes]
    for _ in range(rounds):
        share = (sum(good) + 1) / (n + 2)
        chance = {}
        for c in (0, 1):
            weight = [g if c else 1 - g for g in good]
            for r in range(rules):
                total = sum(weight) + Q.PRIOR[c].sum()
                for place, vote in enumerate((Q.BAD, Q.GOOD, Q.ABSTAIN)):
                    chance[c, r, vote] = (sum(w for w, row in zip(weight, votes, strict=True) if row[r] == vote) + Q.PRIOR[c, place]) / total
        for i, row in enumerate(votes):
            yes, no = share, 1 - share
            for r, vote in enumerate(row):
                yes, no = yes * chance[1, r, vote], no * chance[0, r, vote]
            good[i] = yes / (yes + no)
    return good


def test_posteriors_equal_a_brute_force_estimation():
    chance = np.random.default_rng(5)
    truth = chance.random(150) < 0.7
    votes = np.where(chance.random((150, 4)) < [0.9, 0.8, 0.75, 0.6], truth[:, None], ~truth[:, None]).astype(int)
    votes[chance.random(votes.shape) < 0.3] = Q.ABSTAIN
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, _, _ = Q.estimate(patterns, counts.astype(float))
    assert np.abs(posterior[inverse.ravel()] - brute_em(votes.tolist())).max() < 1e-6


def test_rules_that_only_know_bad_can_win():
    """Three rules that never vote good overrule one that votes good of a third of the bad documents."""
    chance = np.random.default_rng(6)
    truth = chance.random(20_000) < 0.7
    votes = np.full((20_000, 4), Q.ABSTAIN)
    for r in range(3):
        votes[chance.random(20_000) < np.where(truth, 0.01, 0.7), r] = Q.BAD
    votes[:, 3] = np.where(chance.random(20_000) < np.where(truth, 0.95, 0.33), Q.GOOD, Q.BAD)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, chances, _ = Q.estimate(patterns, counts.astype(float))
    kept = (posterior >= 0.5)[inverse.ravel()]
    praised = votes[:, 3] == Q.GOOD
    assert (kept == truth).mean() > 0.96 > (praised == truth).mean()
    assert not kept[praised & (votes[:, :3] == Q.BAD).all(axis=1)].any()
    assert np.abs(chances[0, :3, 0] - 0.7).max() < 0.03 and chances[1, :3, 0].max() < 0.03


def test_labels_agree_without_the_best_rule(spark):
    """On the given labels the first rule alone is right; the others find nearly the same without it, and no single one does."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = Q.judge(docs, Q.RULES[1:]).join(labels, "doc_id").where("NOT base_failed").toPandas()
    right = (rows["kept"] == (rows["quality"] == 1)).mean()
    assert right > 0.95
    singles = [(Q.judge(docs, (rule,)).join(labels, "doc_id").where("NOT base_failed").toPandas().eval("kept == (quality == 1)").mean())
               for rule in (Q.RULES[1], Q.RULES[6])]
    assert right >= max(singles)
