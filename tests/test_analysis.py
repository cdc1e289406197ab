import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.operators import analysis, paging, standards, summaries
from hydromelt.operators.analysis import AnalysisRequest
from hydromelt.plans import analysis as plans
from hydromelt.sources import dictionaries

SCHEMA = ("file_id long, source_row long, source_column_index int, site_name string, outlet string, sample_type string, "
          "measured_on date, item_code string, unit string, value_num decimal(18,6), reported_limit decimal(18,6)")


@pytest.fixture(scope="module")
def facts(spark):
    d = Decimal
    rows = [(1, 0, 0, "a", "1", "방류수", date(2024, 1, 5), "WQ-001", "mg/L", d("31"), d("30")),
            (1, 1, 0, "a", "1", "원폐수", date(2024, 1, 6), "WQ-001", "mg/L", d("500"), d("30")),
            (1, 2, 0, "b", "1", None, date(2024, 4, 6), "WQ-001", "mg/L", None, None),
            (2, 0, 0, "b", "2", None, date(2024, 4, 7), "WQ-008", None, d("5.1"), None),
            (2, 1, 0, "b", "2", None, None, "WQ-008", None, d("7"), None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def limits(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("limits") / "limits.csv"
    path.write_text("\n".join([
        "standard_set,item_code,item_name,region_grade,scale,limit_min,limit_max,unit,legal_basis,legal_article,effective_from,source,note",
        "배출허용기준,WQ-001,x,가지역,large,,30,mg/L,b,a,2026-06-22,law,",
        "배출허용기준,WQ-001,x,가지역,small,,40,mg/L,b,a,2026-06-22,law,",
        "배출허용기준,WQ-008,x,,,5.8,8.6,,b,a,bad-date,,note", ""]), encoding="utf-8")
    return dictionaries.read_limits(spark, str(path))


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(1, 10, "one.csv"), (2, 11, "two.csv")],
                                 "file_id long, owner_user_id long, original_filename string")


def test_limits_typed(limits):
    rows = {(r.item_code, r.scale): r for r in limits.collect()}
    assert rows["WQ-008", None].source == "demo" and rows["WQ-008", None].effective_from is None
    assert rows["WQ-001", "large"].limit_max == Decimal("30") and rows["WQ-001", "large"].limit_min is None


def test_scale_is_checked(limits):
    with pytest.raises(standards.LimitRequestError):
        standards.limits_lookup(limits)
    with pytest.raises(standards.LimitRequestError):
        standards.limits_lookup(limits, scale="huge")
    assert standards.limits_lookup(limits, scale="large").count() == 2
    assert standards.limits_lookup(limits, scale="large", region_grade="가지역").count() == 1


def test_exceedances_leave_influent_out(facts, limits):
    counts, top = plans.exceedance_report(facts, limits, scale="large")
    assert tuple(counts.first()) == (2, 0)
    assert [(r.item_code, r.verdict) for r in top.collect()] == [("WQ-008", C.UNDER_LIMIT), ("WQ-001", C.OVER_LIMIT)]
    counts, _ = plans.exceedance_report(facts, limits, scale=None)
    assert counts.first().exceeded_count == 1
    counts, _ = plans.exceedance_report(facts, limits, scale="small", file_id=1)
    assert counts.first().exceeded_count == 0


def test_defaults_and_assumptions():
    request = AnalysisRequest()
    full = request.with_defaults()
    assert (full.bucket, full.metric, full.standard_set, full.region_grade) == ("month", "avg", "배출허용기준", None)
    assert list(C.ASSUMPTIONS.values()) == request.assumptions()
    assert AnalysisRequest(bucket="year", metric="max", to_date=date(2024, 1, 1), region_grade="가지역", scale="large").assumptions() == []
    with pytest.raises(ValueError):
        AnalysisRequest(bucket="week")


def test_conditions_round_trip():
    request = AnalysisRequest(item_codes=["WQ-001"], from_date=date(2024, 1, 1), scale="small").with_defaults()
    assert plans.stored_request(json.dumps(request.conditions())) == request


def test_series(facts):
    got = {(r.bucket, r.item_code): r for r in analysis.series(facts, AnalysisRequest(bucket="quarter")).collect()}
    assert set(got) == {("2024-Q1", "WQ-001"), ("2024-Q2", "WQ-001"), ("2024-Q2", "WQ-008")}
    assert (float(got["2024-Q1", "WQ-001"].value), got["2024-Q1", "WQ-001"].n, got["2024-Q1", "WQ-001"].unit) == (265.5, 2, "mg/L")
    empty = got["2024-Q2", "WQ-001"]
    assert (empty.value, empty.n, empty.missing) == (None, 1, 1)


def test_run_and_replay(facts, files, limits):
    request = AnalysisRequest(region_grade="가지역", scale="large")
    result = plans.run_analysis(facts, files, limits, request, owner=10)
    assert result.series.count() == 2 and result.exceeded.count() == 1
    record = result.record.first()
    assert (record.row_count, record.exceeded_count, record.limit_count) == (2, 1, result.limits.count())
    assert "Aggregate" in record.generated_plan
    stored = analysis.keyed(result.series, result.execution_id).collect()
    assert {r.execution_id for r in stored} == {record.execution_id} and len(stored) == 2
    rows, total = plans.replay(facts, files, record.conditions, owner=10, size=2)
    assert total == 3 and [r.source_row for r in rows.collect()] == [0, 1]
    assert rows.first().filename == "one.csv"


def test_no_region_no_lines(facts, limits):
    assert analysis.series_limits(limits, AnalysisRequest(scale="large")).count() == 0


def test_page_clamps(facts):
    order = [F.col("measured_on"), F.col("source_row")]
    assert paging.page(facts, order, number=-3, size=0).count() == 1
    rows, total = paging.page_with_total(facts, order, 2, 3)
    assert (rows.count(), total) == (2, 5)


def test_newest_limit_per_null_safe_key(spark):
    df = spark.createDataFrame([(1, "s", "i", None, None), (2, "s", "i", None, None), (3, "s", "i", "r", None)],
                               "id int, standard_set string, item_code string, region_grade string, scale string")
    assert {r.id for r in standards.newest_limits(df).collect()} == {2, 3}


def test_owner_isolation(facts, files):
    assert analysis.owned(facts, files, 11).count() == 2
    assert analysis.owned(facts, files, 99).count() == 0


def test_replace_standard_set(spark, limits, tmp_path):
    from hydromelt.sources import sinks
    path = str(tmp_path / "t")
    other = limits.withColumn("standard_set", F.lit("other"))
    for name, rows in (("other", other), ("배출허용기준", limits)):
        sinks.replace_standard_set(rows, path, name)
    count = lambda: {r.standard_set: r["count"] for r in sinks.stored_limits(spark, path).groupBy("standard_set").count().collect()}
    assert count() == {"other": 3, "배출허용기준": 3}
    sinks.replace_standard_set(limits.limit(1), path)
    assert count() == {"other": 3, "배출허용기준": 1}
    stray = other.limit(2).unionByName(limits.where("false"))
    sinks.replace_standard_set(stray, path)
    assert count() == {"other": 3}


def test_totals(facts):
    row = summaries.measurement_totals(facts).first()
    assert (row.total_values, row.distinct_items, row.distinct_sites, row.first_date) == (5, 2, 2, date(2024, 1, 5))


def test_insensitive_conditions(spark, facts):
    loud = facts.withColumn("site_name", F.when(F.col("source_row") == 0, F.upper("site_name")).otherwise(F.col("site_name")))
    request = AnalysisRequest(site_names=["a"], bucket="year")
    assert analysis.series(loud, request).first().n == 1
    assert analysis.series(analysis.insensitive(loud), request).first().n == 2
