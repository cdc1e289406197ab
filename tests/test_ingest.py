import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.operators import melt
from hydromelt.plans import ingest
from hydromelt.sources import ndjson, sinks

AS_OF = date(2025, 1, 1)
COLUMNS = ("file_id string, column_index int, raw string, code string, dict_type string, site string")
M, D = C.DICT_MEASUREMENT, C.DICT_METADATA


@pytest.fixture(scope="module")
def report(spark):
    """A report file with a limit column per item and an influent row."""
    columns = spark.createDataFrame([
        ("r", 0, "사업장 명칭", "MD-034", D, None), ("r", 1, "방류구", "MD-033", D, None),
        ("r", 2, "시료채취일", "MD-011", D, None), ("r", 3, "구분", None, None, None),
        ("r", 4, "부유물질(mg/L)", "WQ-004", M, None), ("r", 5, "부유물질 배출허용기준", "MD-054", D, "부유물질"),
        ("r", 6, "총 질소(mg/L)", "WQ-005", M, None), ("r", 7, "총질소 배출허용기준", "MD-054", D, "총질소"),
        ("r", 8, "수소이온농도", "WQ-008", M, None), ("r", 9, "측정소명", "MD-001", D, None)], COLUMNS)
    rows = [("r", 0, ["공장", "1번", "2024-03-14", "방류수", "12.5", "10", "<0.001", "20", "7.1", "다른 곳"]),
            ("r", 1, ["공장", "1번", "2024.03.15", "원폐수", "99", "10", "불검출", "20", " ", None]),
            ("r", 2, ["공장", "2번", "2030-01-01", "방류수", "-1", None, None, "20", "7", None])]
    return columns, spark.createDataFrame(rows, "file_id string, source_row long, cells array<string>")


def test_roles_and_limits(report):
    columns, data = report
    row = ingest.layouts_of(columns, data).first()
    assert (row.site, row.outlet, row.date, row.sample_type, row.datetime) == (0, 1, 2, 3, None)
    assert [(m.column_index, m.code, m.limit_index) for m in row.measures] == [
        (4, "WQ-004", 5), (6, "WQ-005", 7), (8, "WQ-008", None)]


def test_priority_of_roles(spark):
    columns = spark.createDataFrame([("f", 0, "측정소명", "MD-001", D, None), ("f", 1, "사업장명", "MD-034", D, None)], COLUMNS)
    data = spark.createDataFrame([("f", 0, ["a", "b"])], "file_id string, source_row long, cells array<string>")
    assert ingest.layouts_of(columns, data).first().site == 0
    assert ingest.layouts_of(columns, data, priority=True).first().site == 1


def test_sample_type_by_value_needs_all_values(spark):
    columns = spark.createDataFrame([("f", 0, "x", None, None, None), ("f", 1, "y", None, None, None),
                                     ("g", 0, "시료구분", "WQ-001", M, None)], COLUMNS)
    data = spark.createDataFrame([("f", 0, ["원폐수", "방류수"]), ("f", 1, ["기타", "원수"]), ("f", 2, [None, " "]),
                                  ("g", 0, ["1"])], "file_id string, source_row long, cells array<string>")
    got = {r.file_id: r.sample_type for r in melt.sample_type_columns(columns, data).collect()}
    assert got == {"f": 1, "g": 0}
    assert ingest.layouts_of(columns, data).where("file_id = 'g'").first().measures == []


def test_records(report):
    columns, data = report
    got = {(r.source_row, r.item_code): r for r in ingest.records_of(columns, data, AS_OF).collect()}
    assert len(got) == 7
    first = got[0, "WQ-004"]
    assert (first.site_name, first.outlet, first.sample_type, first.measured_on) == ("공장", "1번", "방류수", date(2024, 3, 14))
    assert (float(first.value_num), float(first.reported_limit), first.quality_flag) == (12.5, 10.0, None)
    assert got[0, "WQ-005"].censored and float(got[0, "WQ-005"].value_num) == 0.001
    assert got[1, "WQ-005"].quality_flag == "non_numeric" and got[1, "WQ-005"].value_text == "불검출"
    assert got[2, "WQ-004"].quality_flag == "future_date" and got[2, "WQ-004"].reported_limit is None
    assert not {r.source_column for r in got.values()} & {"부유물질 배출허용기준", "총질소 배출허용기준"}


def test_overrides_touch_only_their_column(spark, report):
    columns, data = report
    fix = spark.createDataFrame([("r", 8, "WQ-099", None), ("r", 4, " ", None), ("r", 77, "WQ-001", None)],
                                "file_id string, column_index int, code string, dict_type string")
    from hydromelt.operators.matching import apply_overrides
    full = columns.withColumns({"status": F.lit("unmapped"), "via": F.lit(None).cast("string")})
    got = {r.column_index: r for r in apply_overrides(full, fix).collect()}
    assert len(got) == 10 and (got[8].code, got[8].status, got[8].via, got[8].dict_type) == ("WQ-099", "exact", "review", M)
    assert (got[4].code, got[4].status) == ("WQ-004", "unmapped")


def test_large_numbers_are_flagged_and_long_texts_kept(spark):
    columns = spark.createDataFrame([("f", 0, "c", "WQ-001", M, None)], COLUMNS)
    cells = ["1234567890123", "x" * 500, "123456789012"]
    data = spark.createDataFrame([("f", i, [c]) for i, c in enumerate(cells)], "file_id string, source_row long, cells array<string>")
    got = {r.source_row: r for r in ingest.records_of(columns, data, AS_OF).collect()}
    assert [got[i].value_text for i in range(3)] == cells
    assert [got[i].quality_flag for i in range(3)] == ["out_of_range", "non_numeric", None]
    assert got[0].is_numeric and got[0].value_num is None and int(got[2].value_num) == 123456789012


def test_newest_mapping_and_its_run_reach_the_records(spark, report, tmp_path):
    columns, data = report
    runs = spark.createDataFrame([(11, "r", 1), (12, "r", 2)], "mapping_run_id long, file_id string, round_no int")
    both = columns.withColumns({"status": F.lit("exact"), "via": F.lit(None).cast("string")}).join(runs.drop("round_no"), "file_id")
    reviews = spark.createDataFrame([("r", 8, "WQ-099", None), ("r", 4, None, None)], "file_id string, column_index int, code string, dict_type string")
    chosen, overrides = ingest.newest_mapping(runs, both, reviews)
    assert {r.mapping_run_id for r in chosen.collect()} == {12}
    ingest.ingest(chosen, data, str(tmp_path / "m"), AS_OF, "v1", overrides)
    stored = ingest.stored_measurements(spark, str(tmp_path / "m"))
    assert {(r.mapping_run_id, r.item_code) for r in stored.collect()} == {(12, "WQ-004"), (12, "WQ-005"), (12, "WQ-099")}
    audit = ingest.stored_runs(spark, str(tmp_path / "m")).first()
    assert audit.mapping_run_id == 12 and audit.ran_at is not None


def _plain_cell(text):
    text = (text or "").strip()
    return text or None


def test_record_count_matches_filled_cells(spark):
    rng = random.Random(5)
    rows = [("f", i, [rng.choice(["1", "", None, " ", "불검출"]) for _ in range(5)]) for i in range(200)]
    columns = spark.createDataFrame([("f", i, f"c{i}", f"WQ-00{i}", M, None) for i in range(5)], COLUMNS)
    data = spark.createDataFrame(rows, "file_id string, source_row long, cells array<string>")
    want = sum(_plain_cell(c) is not None for _, _, cells in rows for c in cells)
    assert ingest.records_of(columns, data, AS_OF).count() == want


def test_ingest_replaces_files(spark, report, tmp_path):
    columns, data = report
    path = str(tmp_path / "m")
    other = columns.withColumn("file_id", F.lit("other")), data.withColumn("file_id", F.lit("other"))
    ingest.ingest(*other, path, AS_OF, "v1")
    for _ in range(2):
        ingest.ingest(columns, data, path, AS_OF, "v1")
    stored = ingest.stored_measurements(spark, path)
    assert {(r.file_id, r["count"]) for r in stored.groupBy("file_id").count().collect()} == {("r", 7), ("other", 7)}
    ingest.ingest(columns, data.where("source_row = 0"), path, AS_OF, "v2")
    assert ingest.stored_measurements(spark, path).where("file_id = 'r'").count() == 3
    audit = {r.file_id: r for r in ingest.stored_runs(spark, path).collect()}
    assert (audit["other"].source_rows, audit["other"].inserted_values, audit["other"].non_numeric_values,
            audit["other"].flagged_values, audit["other"].measured_columns) == (3, 7, 1, 3, 3)
    assert audit["r"].dictionary_version == "v2" and audit["r"].inserted_values == 3


def test_appended_loads_show_the_newest(spark, report, tmp_path):
    columns, data = report
    path = str(tmp_path / "m")
    other = columns.withColumn("file_id", F.lit("other")), data.withColumn("file_id", F.lit("other"))
    ingest.ingest(*other, path, AS_OF, "v1", batch_id=1)
    for _ in range(2):
        ingest.ingest(columns, data, path, AS_OF, "v1", batch_id=2)
    count = lambda: {r.file_id: r["count"] for r in ingest.stored_measurements(spark, path).groupBy("file_id").count().collect()}
    assert count() == {"r": 7, "other": 7}
    ingest.ingest(columns, data.where("source_row = 0"), path, AS_OF, "v2", batch_id=3)
    assert count() == {"r": 3, "other": 7}
    blank = other[1].withColumn("cells", F.transform("cells", lambda c: F.lit(None).cast("string")))
    ingest.ingest(other[0], blank, path, AS_OF, "v2", batch_id=4)
    assert count() == {"r": 3}


def test_ndjson_round_trip(spark, report, tmp_path):
    columns, data = report
    records = ingest.records_of(columns, data, AS_OF)
    meta = records.groupBy("file_id").agg(F.count("*").alias("source_rows"))
    ingest.export_ndjson(records, meta, str(tmp_path / "n"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "n" / "rows")).collect()]
    assert {line["kind"] for line in lines} == {"row"} and "quality_flag" in lines[0]
    back = ndjson.read_records(spark, str(tmp_path / "n" / "rows"))
    fields = ["source_row", "item_code", "value_num", "value_text", "measured_on", "quality_flag"]
    assert sorted(map(tuple, back.select(fields).collect()), key=str) == sorted(
        map(tuple, records.select(fields).collect()), key=str)
    assert ndjson.parse_meta(spark.read.text(str(tmp_path / "n" / "meta"))).first().source_rows == 7


def test_ndjson_defaults(spark):
    lines = spark.createDataFrame([('{"kind":"meta","source_rows":3}',), ("  ",), ('{"kind":"row","item_code":"WQ-001"}',)], "value string")
    row = ndjson.parse_lines(lines).collect()
    assert len(row) == 1 and (row[0].source_column, row[0].source_row, row[0].is_numeric) == ("", 0, True)


def test_csv_lines_quote_where_needed(spark):
    row = spark.createDataFrame([('a,"b"', "x", None)], "a string, b string, c string").select(
        sinks.csv_line([F.col("a"), F.col("b"), F.col("c")]).alias("l")).first()
    assert row.l == '"a,""b""",x,'
