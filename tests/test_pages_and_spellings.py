"""The page index and the removal of redundant spellings against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from hydromelt.operators import lexicon, melt
from hydromelt.operators.paging import PageIndex, page


@pytest.mark.parametrize("size", [1, 7, 100, 1000])
def test_pages_of_an_index(spark, tmp_path, size):
    rows = spark.range(530).select((F.col("id") * 7919 % 530).alias("a"), F.lit("x").alias("b")).repartition(9)
    index = PageIndex.build(rows, [F.col("a").desc()], str(tmp_path / "p"))
    assert index.total == 530 and PageIndex(spark, str(tmp_path / "p")).total == 530
    for number in (1, 2, 5, 530 // size, 530 // size + 1, 10_000):
        want = list(range(529, -1, -1))[(max(1, number) - 1) * size:max(1, number) * size]
        got = index.page(number, size)
        assert [r.a for r in got.collect()] == want and got.columns == ["a", "b"]
    assert [r.a for r in page(rows, [F.col("a").desc()], 2, size).collect()] == list(range(529, -1, -1))[size:2 * size]


def test_a_page_reads_few_ranges(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.lit("y" * 50).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are one range
    index = PageIndex.build(rows, [F.col("id")], str(tmp_path / "p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    last = index.page(20_000 // 20, 20)
    assert [r.id for r in last.collect()] == list(range(19_980, 20_000))
    assert len(index.ranges) > 1
    scanned = last._jdf.queryExecution().executedPlan().toString()
    assert "range#" in scanned and "PartitionFilters" in scanned and len(index.ranges) == index.rows.select("range").distinct().count()
    assert PageIndex.build(rows.limit(0), [F.col("id")], str(tmp_path / "e")).page(1).count() == 0


def fold(steps, form):
    """Redundant places of one code's (base, text) in order."""
    keys, gone = set(), set()
    for at, (base, text) in enumerate(steps):
        body, tokens = form[text]
        if not base and body and body in keys:
            gone.add(at)
        else:
            keys |= {k for k in (body, *tokens) if k}
    return gone


def test_redundant_spellings(spark):
    """Chains of bracketed parts, equal bodies, texts without a body, many codes and one with many spellings."""
    from hydromelt.functions import names
    chance = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "가나", "다라"]
    spell = lambda: chance.choice(["{}", "{} ({})", "{}({})({})", "({})", "{}-{}", "{} "]).format(*chance.choices(words, k=3))
    steps = {f"c{i}": [(False, spell()) for _ in range(chance.randint(0, 12))] for i in range(120)}
    steps["big"] = [(False, f"{chance.choice(words)}{chance.randrange(300)} ({chance.choice(words)}{chance.randrange(300)})") for _ in range(6000)]
    # A chain in which every second spelling goes because the one before it stays.
    steps["chain"] = [(False, f"n{i} (n{i + 1})") for i in range(9)]
    for code, some in steps.items():
        some[:0] = [(True, chance.choice(words))]
    rows = [(code, base, at, text) for code, some in steps.items() for at, (base, text) in enumerate(some)]
    df = spark.createDataFrame(rows, "code string, base boolean, at int, text string").repartition(5)
    forms = df.select("text").distinct().withColumn("f", names.normalize_name("text")).collect()
    form = {r.text: (r.f.body, list(r.f.paren_tokens)) for r in forms}
    got = {(r.code, r["at"]) for r in lexicon.mark_redundant(df).where("redundant").collect()}
    want = {(code, at) for code, some in steps.items() for at in fold(some, form)}
    assert got == want and {at for code, at in want if code == "chain"} == {2, 4, 6, 8}
    assert lexicon.mark_redundant(df).count() == len(rows)


def test_kept_spellings_are_joined_in_order(spark):
    terms = spark.createDataFrame([("a", "물", "", "-", ["물", "b", "c (b)", "b "]), ("z", "x", None, None, None)],
                                  "code string, name_ko string, name_en string, abbr string, surfaces array<string>")
    got = {r.code: (r.synonyms, r.redundant) for r in lexicon.drop_redundant(terms).collect()}
    assert got == {"a": ("b|c (b)", 2), "z": ("", 0)}


def test_allowed_columns_over_several_masks(spark):
    """150 columns of one file, in three masks; blanks and cells past a short row count for nothing."""
    allowed = ("u", "v")
    rows = [["u" if i % 3 else ("w" if r == 7 else "v") for i in range(150)] for r in range(20)]
    for r in range(20):
        rows[r][10], rows[r][11], rows[r][140] = None, " ", "u" if r % 2 else None
    rows.append(["u"] * 12)
    data = spark.createDataFrame([("f", r, cells) for r, cells in enumerate(rows)] + [("g", 0, ["x"])],
                                 "file_id string, source_row long, cells array<string>")
    listed = spark.createDataFrame([("f", list(range(0, 150, 1))), ("g", [0, 5]), ("h", [1])], "file_id string, wanted array<int>")
    got = {(r.file_id, r.column_index) for r in melt.allowed_columns(data, listed, allowed).collect()}
    filled = lambda i: [r[i].strip() for r in rows if i < len(r) and (r[i] or "").strip()]
    assert got == {("f", i) for i in range(150) if filled(i) and set(filled(i)) <= set(allowed)}
