"""Plans whose cost must not grow faster than their input."""

from datetime import date

from pyspark.sql import functions as F

from hydromelt import config as C, session
from hydromelt.operators import analysis, melt
from hydromelt.operators.analysis import AnalysisRequest
from hydromelt.plans import ingest
from hydromelt.sources import sinks
from hydromelt.sources.snapshots import Store


def test_a_large_file_is_dealt_over_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(table, "id").rdd.getNumPartitions() == cores
    monkeypatch.setattr(C, "SPREAD_BYTES", 100)
    dealt = session.spread(table, "id")
    assert dealt.rdd.getNumPartitions() > 4 * cores and dealt.count() == 1000


def test_series_sorts_no_rows(spark, capsys):
    """Several units in a group: the least is shown, and average and counts are those of all rows."""
    rows = [("a", 2, "WQ-1", "mg/L"), ("a", 3, "WQ-1", None), ("a", 3, "WQ-1", "g/L"), ("a", None, "WQ-1", "mg/L"), ("a", 1, "WQ-2", None)]
    facts = spark.createDataFrame(rows, "site_name string, v int, item_code string, unit string").select(
        "site_name", F.col("v").cast("decimal(18,6)").alias("value_num"), "item_code", "unit", F.lit(date(2024, 1, 2)).alias("measured_on"))
    points = analysis.series(facts, AnalysisRequest())
    got = sorted((r.item_code, str(r.value), r.n, r.missing, r.unit) for r in points.collect())
    assert got == [("WQ-1", "2.6667", 4, 1, "g/L"), ("WQ-2", "1.0000", 1, 0, None)]
    points.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_melt_reads_each_cell_once(spark, capsys):
    """Entries of a row are made once, not again in a filter before the fan-out; blank and oddly blank cells give no record."""
    rows = [("f", 0, [" 1 ", "　x "]), ("f", 1, ["  ", None]), ("f", 2, ["", "2"]), ("g", 0, ["3", "4"])]
    data = spark.createDataFrame(rows, "file_id string, source_row long, cells array<string>")
    columns = spark.createDataFrame([("f", i, f"c{i}", f"WQ-{i}", C.DICT_MEASUREMENT, None) for i in (0, 1)] + [
        ("g", 0, "d", "MD-006", C.DICT_METADATA, None)],
        "file_id string, column_index int, raw string, code string, dict_type string, site string")
    layouts = session.stage(melt.file_layouts(columns, melt.sample_type_columns(columns, data)), "layouts")
    found = melt.melt(data, layouts, F.lit(date(2024, 1, 1)))
    found.explain()
    assert capsys.readouterr().out.count("transform(") == 1
    got = sorted((r.file_id, r.source_row, r.item_code, r.value_text) for r in found.collect())
    assert got == [("f", 0, "WQ-0", "1"), ("f", 0, "WQ-1", "x"), ("f", 2, "WQ-1", "2")]


def test_stored_records_are_not_shuffled(spark, tmp_path, capsys):
    """Loads, their compaction and reading move no record; a replay of a load that a compaction took in writes nothing."""
    path = str(tmp_path / "m")
    records = spark.range(4000).select(F.concat(F.lit("f"), F.col("id") % 50).alias("file_id"), F.col("id").alias("source_row"),
                                       F.lit("WQ-001").alias("item_code"), F.lit("2024-01-01").alias("measured_on"))
    files = lambda written: written.select("file_id").distinct()
    for batch_id in (1, 2):
        sinks.append_load(spark, records, files, path, batch_id)
    stored = ingest.stored_measurements(spark, path)
    stored.explain()
    shown = capsys.readouterr().out
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown and stored.count() == 4000
    sinks.compact_loads(spark, path)
    held, folders = Store(spark, path), len(list((tmp_path / "m" / "data").iterdir()))
    assert sinks.append_load(spark, records, files, path, 1).count() == 50
    assert len(list((tmp_path / "m" / "data").iterdir())) == folders and held.read(sinks.MEASUREMENTS).count() == 4000


def test_ingestion_moves_no_record_for_its_run(spark, monkeypatch, capsys):
    """The mapping run of each file is sent along with the layouts."""
    monkeypatch.setattr(sinks, "append_load", lambda _, records, audit, store, batch_id: records)
    data = spark.createDataFrame([("f", 0, ["1"])], "file_id string, source_row long, cells array<string>")
    columns = spark.createDataFrame([("f", 0, "c", "WQ-1", C.DICT_MEASUREMENT, None, 7)],
                                    "file_id string, column_index int, raw string, code string, dict_type string, site string, mapping_run_id long")
    records = ingest.ingest(columns, data, "", date(2024, 1, 1), "1")
    records.explain()
    shown = capsys.readouterr().out
    assert shown.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in shown
    assert [(r.file_id, r.item_code, r.mapping_run_id) for r in records.collect()] == [("f", "WQ-1", 7)]
