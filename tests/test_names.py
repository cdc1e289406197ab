import difflib
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import names, similarity, words


@pytest.mark.parametrize("text, body, tokens", [
    ("  염_분-값  ", "염분값", []),
    ("물속의 산소(DO_L당mg)", "물속의산소", ["do"]),
    ("물온도（℃）", "물온도", []),
    ("규산 mg/L", "규산", []),
    ("흐림NTU", "흐림", []),
    ("엽록소-b(Chl-b)", "엽록소b", ["chlb"]),
    ("a(b(c d)e)", "a", ["c", "d", "be"]),
    ("깊이(0.0)", "깊이", []),
    ("mpntu", "mp", []),
    (None, "", []),
])
def test_split_name(text, body, tokens):
    assert names.split_name(text) == (body, tokens)


def test_names_in_spark(spark):
    df = spark.createDataFrame([("총질소(T-N)",), (None,)], "raw string")
    row = df.select(names.normalize_name("raw").alias("f")).select("f.*").collect()
    assert (row[0].body, row[0].paren_tokens) == ("총질소", ["tn"])
    assert (row[1].body, row[1].paren_tokens) == ("", [])
    shown = df.select(names.normalize_name("raw").alias("f")).select(
        names.display_name(F.col("f.body"), F.col("f.paren_tokens")).alias("d")).collect()
    assert shown[0].d == "총질소(tn)"


def test_site_tails_stop_at_short_keys():
    tails = names.site_tails("갈대못_염분")
    assert tails[-1]["body"] == "염분" and tails[-1]["site"] == "갈대못"
    assert all(len(t["body"]) >= C.COMPOSITE_MIN_TAIL_LEN for t in tails)


@settings(max_examples=300, deadline=None)
@given(st.text("ab_ ()mgltu㎎（）μs/%.가", max_size=14))
def test_site_tails_match_plain_reading(text):
    want = []
    for cut in range(1, len(text)):
        body = names.split_name(text[cut:])[0]
        if len(body) < C.COMPOSITE_MIN_TAIL_LEN:
            break
        if text[:cut].strip("_ ./"):
            want.append((cut, body))
    assert [(t["cut"], t["body"]) for t in names.site_tails(text)] == want


def test_keys(spark):
    row = spark.createDataFrame([("Total N (mg/L)-가",)], "t string").select(
        names.wq_normalize(F.col("t")).alias("a"), names.alias_key(F.col("t")).alias("b"),
        names.alnum_key(F.col("t")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("totalnmgl가", "totalnmgl가", "totalnmgl가")


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc가나", max_size=70), st.text("abc가나", max_size=70))
def test_common_subsequence_matches_table(a, b):
    assert similarity.common_subsequence(a, b) == _lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=20, unique=True),
       st.text("abcd", min_size=1, max_size=9))
def test_nearest_entry_is_first_best(pool, query):
    common = similarity.common_in_order(pd.Series([query] * len(pool)), pd.Series(pool))
    total = np.array([len(query) + len(text) for text in pool])
    found = (1.0 - (total - 2 * common) / total) * 100.0
    scores = [similarity.ratio(query, text) for text in pool]
    assert (found.max(), found.argmax()) == (max(scores), scores.index(max(scores)))


def test_indel_ratio(spark):
    row = spark.createDataFrame([("산솟소량", "산소량")], "a string, b string").select(
        similarity.indel_ratio("a", "b").alias("s")).first()
    assert row.s == 85.7


def test_trigrams(spark):
    row = spark.createDataFrame([("word", "words", "")], "a string, b string, c string").select(
        similarity.trigrams(F.col("a")).alias("g"),
        similarity.trigram_similarity(similarity.trigrams(F.col("a")), similarity.trigrams(F.col("b"))).alias("s"),
        similarity.trigrams(F.col("c")).alias("e")).first()
    assert row.g == ["  w", " wo", "wor", "ord", "rd "]
    assert abs(row.s - 4 / 7) < 1e-12
    assert row.e == []


def test_decompose_backtracks():
    assert words.decompose("측정시설명", {"측정", "시설", "시설명칭", "명"}, 4) == ["측정", "시설", "명"]
    assert words.decompose("abcd", {"abc", "ab", "cd"}, 3) == ["ab", "cd"]
    assert words.decompose("abx", {"ab"}, 2) is None
    assert words.decompose("", {"ab"}, 2) == []


def _plain_decompose(term, vocabulary, longest):
    if not term:
        return []
    for size in range(min(longest, len(term)), 0, -1):
        if term[:size] in vocabulary:
            rest = _plain_decompose(term[size:], vocabulary, longest)
            if rest is not None:
                return [term[:size]] + rest
    return None


def test_decompose_matches_plain_backtracking():
    rng = random.Random(3)
    for _ in range(300):
        vocabulary = {"".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(4)}
        term = "".join(rng.choices("ab", k=rng.randint(0, 8)))
        assert words.decompose(term, vocabulary, 3) == _plain_decompose(term, vocabulary, 3)


def test_ratio_is_not_edit_distance():
    assert similarity.ratio("ab", "ba") == 50.0
    assert difflib.SequenceMatcher(None, "ab", "ba").ratio() * 100 == 50.0
