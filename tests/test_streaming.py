from datetime import date

from pyspark.sql import functions as F

from hydromelt.operators import melt, tables, usage
from hydromelt.sources import ndjson
from hydromelt.sources.snapshots import Store
from hydromelt.streaming import jobs


def test_records_landed_in_parts_and_twice(spark, tmp_path):
    records = spark.createDataFrame([("f", i, 1, "WQ-001") for i in range(5)],
                                    "file_id string, source_row long, source_column_index int, item_code string")
    lands = [(records.where("source_row < 3"), 1), (records.where("source_row >= 3"), 1), (records, 2)]
    for part, value in lands:
        lines = ndjson.record_lines(part.withColumns({
            "measured_on": F.lit(date(2024, 1, 1)), "value_num": F.lit(value).cast("decimal(18,6)")}))
        lines.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
        jobs.land_records(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = jobs.read_records(spark, str(tmp_path / "out")).collect()
    assert sorted((r.source_row, int(r.value_num)) for r in got) == [(i, 2) for i in range(5)]


def test_sightings_over_several_batches_match_one_batch(spark, tmp_path):
    schema = "surface string, source_id string, seen_on date"
    parts = [[("T N", None, date(2024, 1, 3)), ("tn", None, date(2024, 1, 1))], [("t-n", None, date(2024, 1, 9)), ("x", "s", date(2024, 1, 2))]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
        jobs.accumulate_sightings(stream, str(tmp_path / "q"), str(tmp_path / "cp")).awaitTermination()
    empty = spark.createDataFrame([], "surface string, source_id string, first_seen_on date, last_seen_on date, seen_count bigint, status string")
    whole = tables.merge_sightings(empty, spark.createDataFrame(sum(parts, []), schema))
    columns = ["surface_norm", "source_id", "surface", "first_seen_on", "last_seen_on", "seen_count", "status"]
    key = lambda df: sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    assert key(jobs.read_sightings(spark, str(tmp_path / "q"))) == key(whole)


def test_late_requests_count(spark, tmp_path):
    schema = "api_key_id long, requested_at timestamp_ntz"
    for part in ([(1, "2024-01-01 00:05:00"), (1, "2024-01-01 09:00:00")], [(1, "2024-01-01 00:05:30"), (2, "2024-01-01 00:05:01")]):
        rows = spark.createDataFrame(part, "api_key_id long, t string").select("api_key_id", F.to_timestamp_ntz("t").alias("requested_at"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.land_rate_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.api_key_id, r.minute.hour, r.minute.minute): r.requests for r in jobs.read_rate_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, 0, 5): 2, (1, 9, 0): 1, (2, 0, 5): 1}


def test_rate_counts_and_breaches(spark):
    log = spark.createDataFrame([(1, f"2024-01-01 00:00:{s:02d}") for s in range(5)] + [(2, "2024-01-01 00:00:10")],
                                "api_key_id long, requested_at string").withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    batch = {(r.api_key_id, r.requests) for r in jobs.rate_counts(log).collect()}
    assert batch == {(1, 5), (2, 1)}
    assert [(r.api_key_id, r.refused) for r in jobs.breaches(jobs.rate_counts(log), 3).collect()] == [(1, 2)]
    own = spark.createDataFrame([(1, 4)], "api_key_id long, requests_per_minute int")
    assert [(r.api_key_id, r.refused) for r in usage.rate_breaches(log, own).collect()] == [(1, 1)]


def test_typed_stream_matches_batch(spark, tmp_path):
    columns = ["file_id", "source_row", "source_column", "source_column_index", "site_name", "outlet", "sample_type", "measured_on",
               "period_label", "item_code", "unit", "text", "limit_text"]
    rows = spark.range(50).select(F.lit("f").alias("file_id"), F.col("id").alias("source_row"), F.lit("c").alias("source_column"),
                                  F.lit(1).alias("source_column_index"), *[F.lit(None).cast("string").alias(c) for c in columns[4:7]],
                                  F.lit(date(2024, 1, 1)).alias("measured_on"), F.lit(None).cast("string").alias("period_label"),
                                  F.lit("WQ-001").alias("item_code"), F.lit(None).cast("string").alias("unit"),
                                  F.when(F.col("id") % 7 == 0, "불검출").otherwise(F.col("id").cast("string")).alias("text"),
                                  F.lit(None).cast("string").alias("limit_text"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.land_cells(stream, str(tmp_path / "out"), str(tmp_path / "cp"), date(2025, 1, 1)).awaitTermination()
    batch = melt.typed_records(rows, F.lit(date(2025, 1, 1)))
    landed = jobs.read_cells(spark, str(tmp_path / "out")).select(batch.columns)
    assert landed.exceptAll(batch).count() == 0 and landed.count() == 50


def test_a_file_sent_again_takes_the_place_of_all_it_had(spark, tmp_path):
    """Three cells, then one; a file sent again with its meta line only; a file that spans two batches of one sending."""
    sent = [(1, ["f"], [("f", 0), ("f", 1), ("f", 2), ("g", 0), ("h", 0)]), (1, [], [("h", 1)]), (2, ["f"], [("f", 1)]), (3, ["g"], [])]
    for load_id, announced, cells in sent:
        records = spark.createDataFrame([(f, r, load_id) for f, r in cells], "file_id string, source_row long, value_num int")
        lines = ndjson.record_lines(records.withColumn("value_num", F.col("value_num").cast("decimal(18,6)")).withColumn("item_code", F.lit("WQ-001")))
        meta = ndjson.meta_lines(spark.createDataFrame([(f, 0) for f in announced], "file_id string, source_rows int"))
        lines = lines.unionByName(meta).withColumn("load_id", F.lit(load_id).cast("long"))
        lines.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
        jobs.land_records(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.file_id, r.source_row, int(r.value_num)) for r in jobs.read_records(spark, str(tmp_path / "out")).collect())
    assert got == [("f", 1, 2), ("h", 0, 1), ("h", 1, 1)]


def test_rolling_usage_over_batches(spark, tmp_path):
    """Counts grow over batches, seconds past the horizon leave state and store, and totals equal those of the whole log."""
    parts = [[(1, "2024-01-01 00:00:00"), (1, "2024-02-09 23:00:00"), (2, "2024-02-09 12:00:01")],
             [(1, "2024-02-09 23:00:00"), (2, "2024-02-10 12:00:00"), (2, "2024-02-10 12:00:01")],
             [(1, "2024-01-02 00:00:00"), (1, "2024-02-10 00:00:00")]]
    schema = "organization_id long, requested_at timestamp"
    frame = lambda rows: spark.createDataFrame(rows, "organization_id long, t string").select("organization_id", F.to_timestamp("t").alias("requested_at"))
    as_of = F.expr("TIMESTAMP '2024-02-10 12:00:00'")
    for rows in parts:
        frame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.land_usage(stream, str(tmp_path / "u"), str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted((r.organization_id, r.last_24_hours, r.last_30_days) for r in df.collect())
    want = key(usage.recent_usage(frame(sum(parts, [])), as_of))
    assert key(jobs.read_usage(spark, str(tmp_path / "u"), as_of)) == want == [(1, 3, 3), (2, 2, 2)]
    jobs.compact_usage(spark, str(tmp_path / "u"))
    assert key(jobs.read_usage(spark, str(tmp_path / "u"), as_of)) == want
    assert Store(spark, str(tmp_path / "u")).read(jobs.USAGE).agg(F.min("second")).first()[0].year == 2024
    assert Store(spark, str(tmp_path / "u")).read(jobs.USAGE).where("second < '2024-01-10'").count() == 0


def test_usage_within_the_second_of_the_total(spark, tmp_path):
    """A request within the second that begins at the moment of the total is later than it; one at that moment counts."""
    rows = [(1, "2024-02-10 12:00:00"), (1, "2024-02-10 12:00:00.000001"), (2, "2024-02-10 12:00:00.5"), (2, "2024-02-10 11:59:59.999999"),
            (1, "2024-02-09 12:00:00"), (1, "2024-02-09 12:00:00.25"), (1, "2024-02-09 11:59:59.75"), (3, "2024-02-10 12:00:00.25")]
    log = spark.createDataFrame(rows, "organization_id long, t string").select("organization_id", F.to_timestamp("t").alias("requested_at"))
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.land_usage(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), str(tmp_path / "u"), str(tmp_path / "cp")).awaitTermination()
    as_of = F.expr("TIMESTAMP '2024-02-10 12:00:00'")
    key = lambda df: sorted((r.organization_id, r.last_24_hours, r.last_30_days) for r in df.collect())
    want = key(usage.recent_usage(log, as_of))
    assert key(jobs.read_usage(spark, str(tmp_path / "u"), as_of)) == want == [(1, 3, 4), (2, 1, 1), (3, 0, 0)]
    jobs.compact_usage(spark, str(tmp_path / "u"))
    assert key(jobs.read_usage(spark, str(tmp_path / "u"), as_of)) == want
    assert key(jobs.read_usage(spark, str(tmp_path / "u"), F.expr("TIMESTAMP '2024-02-10 12:00:00.75'"))) == want
