from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hydromelt.functions import values


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first().v


NUMBERS = [
    ("1,234.5", "1234.5", "ok"), ("<0.001", "0.001", "ok"), ("≥ 3", "3", "ok"), ("-2", "-2", "ok"), ("１２", "12", "ok"),
    ("불검출", None, "non_numeric"), ("N.D.", None, "non_numeric"), ("nd", None, "non_numeric"), ("-", None, "non_numeric"),
    ("–", None, "non_numeric"), ("1e5", None, "non_numeric"), ("1.", None, "non_numeric"), (".5", None, "non_numeric"),
    ("12 mg", None, "non_numeric"), (None, None, "empty")]


def test_parse_number(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NUMBERS)], "i int, t string")
    got = {r.i: r for r in df.select("i", values.parse_number(F.col("t")).alias("v"),
                                     values.parse_reason(F.col("t")).alias("why")).collect()}
    for i, (text, number, reason) in enumerate(NUMBERS):
        assert got[i].v == (None if number is None else Decimal(number)), text
        assert got[i].why == reason, text


DATES = [
    ("2024-03-14", date(2024, 3, 14)), ("2024/3/4", date(2024, 3, 4)), ("2024.12.01", date(2024, 12, 1)),
    ("20240229", date(2024, 2, 29)), ("2024-03-14 10:20", date(2024, 3, 14)), ("2024-03-14 00:00:00", date(2024, 3, 14)),
    ("2023-02-29", None), ("2024-13-01", None), ("24-03-14", None), ("2024-03/14", None), ("2024", None), ("2024-03", None),
    ("12024-03-14", None), ("2024-03-14T10:00", None), ("x", None), ("", None), (None, None)]


def test_parse_date(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", values.parse_date(F.col("t")).alias("v")).collect()}
    for i, (text, want) in enumerate(DATES):
        assert got[i] == want, text


@pytest.mark.parametrize("cells, measured_on, label", [
    (("2024-03-14", "2024-05-01", "2020", "2", "q"), date(2024, 3, 14), None),
    ((None, "2024-05-01 11:00", "2020", "2", "q"), date(2024, 5, 1), None),
    (("bad", None, "2020", "2", "q"), date(2020, 2, 1), "q"),
    ((None, None, "2,020", "13", "q"), date(2020, 1, 1), "q"),
    ((None, None, "2020", "12.5", None), date(2020, 1, 1), None),
    ((None, None, "2020.0", None, None), date(2020, 1, 1), None),
    ((None, None, "0", "3", "q"), None, "q"),
    ((None, None, "24", "3", "q"), date(24, 3, 1), "q"),
    ((None, None, None, "3", "q"), None, "q")])
def test_resolve_date(spark, cells, measured_on, label):
    df = spark.createDataFrame([cells], "d string, dt string, y string, m string, p string")
    row = values.resolve_dates(df, "d", "dt", "y", "m", "p").first()
    assert (row.measured_on, row.period_label) == (measured_on, label)


def test_flags(spark):
    df = spark.createDataFrame([(1, None, "non_numeric", date(2030, 1, 1)), (2, -1.0, "ok", date(2030, 1, 1)),
                                (3, -1.0, "ok", date(2020, 1, 1)), (4, 1.0, "ok", None)],
                               "i int, v double, why string, d date")
    got = {r.i: r.f for r in df.select("i", values.quality_flag(
        F.col("v"), F.col("why"), F.col("d"), F.lit(date(2024, 1, 1))).alias("f")).collect()}
    assert got == {1: "non_numeric", 2: "future_date", 3: "negative", 4: None}


def test_strip_removes_unicode_blanks(spark):
    assert one(spark, "　\xa0 값  ", values.strip) == "값"


@pytest.mark.parametrize("verdict, candidate, canonical, adopted", [
    ("승인", "WQ-001", "WQ-001", "WQ-001"), ("Approved", "WQ-001", "WQ-001", "WQ-001"), ("기각", "WQ-001", "no_match", None),
    ("REJECTED", "WQ-001", "no_match", None), ("no_match", None, "no_match", None), ("MD-002", "WQ-001", "MD-002", "MD-002"),
    ("승인", None, None, None)])
def test_verdicts(spark, verdict, candidate, canonical, adopted):
    row = spark.createDataFrame([(verdict, candidate)], "v string, c string").select(
        values.canonical_verdict(F.col("v"), F.col("c")).alias("a"), values.adopted_code(F.col("v"), F.col("c")).alias("b")).first()
    assert (row.a, row.b) == (canonical, adopted)


def test_rates_round_half_up(spark):
    df = spark.createDataFrame([(1, 8, 12.5), (1, 2000, 0.1), (2, 14, 14.3), (0, 0, 0.0)], "p long, w long, r double")
    assert all(float(r.got) == r.r for r in df.select("r", values.rate(F.col("p"), F.col("w")).alias("got")).collect())


def test_status_and_json_fallbacks(spark):
    assert one(spark, "odd", values.known_status) == "unmapped" and one(spark, "exact", values.known_status) == "exact"
    assert one(spark, "{broken", lambda c: values.json_or(c, "array<string>", F.array(F.lit("x")))) == ["x"]
