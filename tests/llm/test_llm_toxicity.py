import os
import random
import zlib

import numpy as np
import pytest

from hydromelt.llm import toxicity as X

LABELS = "doc_id long, quality int, toxic int, text string, score string"


@pytest.fixture(scope="module")
def corpus():
    chance = random.Random(2)
    words = ["".join(chance.choice("aeioubdfglmnprst") for _ in range(chance.randint(2, 7))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(1500):
        body = chance.choices(words, k=chance.randint(20, 200))
        toxic.append(int(i % 8 == 0))
        for _ in range(3 * toxic[-1]):
            body.insert(chance.randrange(len(body)), chance.choice(["vilezzak", "Grobnix", "hatework"]))
        texts.append(" ".join(body))
    return texts, toxic


@pytest.fixture(scope="module")
def model(spark, make_docs, corpus):
    texts, toxic = corpus
    labels = spark.createDataFrame([(i, 1, t, "x", "x") for i, t in enumerate(toxic)] + [(None, 1, 1, "x", "x"), (3, 1, None, "x", "x")], LABELS)
    return X.fit(make_docs(texts), labels)


def test_held_out_rows(make_docs, corpus, model):
    texts, toxic = corpus
    rows = [r for r in X.score(make_docs(texts), model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(rows) > 400
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    right = [r["predicted"] == toxic[r["doc_id"]] for r in rows]
    assert np.mean(right) > 0.97
    unseen = X.score(make_docs(["plain words and a hateworker among them", "plain words and others among them", "", None]), model).collect()
    scores = {r["doc_id"]: r["score"] for r in unseen}
    assert scores[0] > scores[1] and scores[2] == scores[3] < 0.5


def test_training_rows(spark, make_docs, corpus):
    texts, toxic = corpus
    labels = spark.createDataFrame([(i, 1, t, "x", "x") for i, t in enumerate(toxic)], LABELS)
    ids = [r["doc_id"] for r in X.training_rows(make_docs(texts), labels, 100).collect()]
    assert len(ids) == 100 and not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)


def test_one_kind_of_label_gives_no_model(spark, make_docs):
    labels = spark.createDataFrame([(i, 1, 0, "x", "x") for i in range(9)], LABELS)
    assert X.fit(make_docs(["a text"] * 9), labels) is None
    assert {r["score"] for r in X.score(make_docs(["a text", None]), None).collect()} == {0.0}


def test_presence_counts_once_per_text():
    texts = ["abcabcabcabc", "", "xyz", "ABCABC"]
    text, held = X.present(texts, np.ones(1 << X.BUCKET_BITS, bool))
    assert len(set(zip(text.tolist(), held.tolist(), strict=True))) == len(text)
    for i, t in enumerate(texts):
        padded = f"\n{t.lower()}\n"
        assert (text == i).sum() == sum(len({padded[k:k + n] for k in range(len(padded) - n + 1)}) for n in X.SIZES)


def test_documents(spark):
    """Held-out labels of a table that has enough of them to learn from."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("driver tables not present")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = X.op9_naive_bayes_linear(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    unseen = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert unseen.count((1, 0)) <= 1
    assert unseen.count((1, 1)) >= 2 * unseen.count((0, 1))


def test_odd_and_empty(odd_docs, no_docs, model):
    assert X.score(odd_docs, model).count() == odd_docs.count()
    assert X.score(no_docs, model).count() == X.drop_toxic(no_docs, model).count() == 0
    kept = X.drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert kept.count() == X.score(odd_docs, model).where("predicted = 0").count() > odd_docs.count() / 2


def plain_bucket(gram):
    """The hashed bucket of one n-gram, letter by letter."""
    held = 0x811C9DC5
    for letter in gram:
        held = (held ^ ord(letter)) * 0x01000193 & 0xFFFFFFFF
    mixed = (held ^ len(gram)) * 0x9E3779B1 & 0xFFFFFFFF
    return ((mixed ^ mixed >> 15) * 0x01000193 & 0xFFFFFFFF) >> (32 - X.BUCKET_BITS)


def plain_features(text):
    padded = f"\n{(text or '').lower()}\n"
    return {plain_bucket(padded[k:k + n]) for n in X.SIZES for k in range(len(padded) - n + 1)}


def test_scores_equal_a_second_computation(make_docs, corpus, model):
    """From the weights alone: features gram by gram, added up and squashed in plain Python."""
    texts = [*corpus[0][:60], "", None, "Ünïcödé 東京", "a", "hatework " * 50]
    weight = dict(zip(model.bucket.tolist(), model.weight.tolist(), strict=True))
    for r in X.score(make_docs(texts), model).collect():
        total = model.intercept + sum(weight.get(b, 0.0) for b in plain_features(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_ratios_and_weights_equal_a_second_computation(spark, make_docs, corpus, monkeypatch):
    """Log-count ratios counted by sets, and a ridge logistic regression solved by plain Newton steps."""
    monkeypatch.setattr(X, "FEATURES", 150)
    monkeypatch.setattr(X, "STEPS", 4000)
    texts, toxic = corpus[0][:300], corpus[1][:300]
    labels = spark.createDataFrame([(i, 1, t, "x", "x") for i, t in enumerate(toxic)], LABELS)
    fitted = X.fit(make_docs(texts), labels)
    rows = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    held, y = [plain_features(texts[i]) for i in rows], np.array([toxic[i] for i in rows], float)
    ratio = []
    for b in fitted.bucket.tolist():
        has = np.array([b in h for h in held], float)
        ratio.append(np.log(((has @ y + X.SMOOTH) / (y.sum() + 2 * X.SMOOTH)) / ((has @ (1 - y) + X.SMOOTH) / ((1 - y).sum() + 2 * X.SMOOTH))))
    x = np.array([[r if b in h else 0.0 for b, r in zip(fitted.bucket.tolist(), ratio, strict=True)] for h in held])
    full, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.r_[np.full(x.shape[1], X.RIDGE), 0.0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full / len(y) + np.diag(ridge + 1e-12), full.T @ (p - y) / len(y) + ridge * w)
        w -= np.clip(step, -1, 1)
    want = 1 / (1 + np.exp(-(full @ w)))
    assert np.abs(fitted.score([texts[i] for i in rows]) - want).max() < 0.02
