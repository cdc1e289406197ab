"""Headline timings: one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hydromelt import catalog, session  # noqa: E402

HEADLINE = (
    "melt", "melt_unpivot", "analysis_month", "analysis_none", "exceedances", "exceedance_counts", "series_exceeded",
    "measure_by_item", "value_summary", "ingestion_audit", "replace_by_file", "dq_duplicates", "map_composite", "map_fuzzy",
    "trigram_topk", "match_cascade", "mapping_round", "term_verify", "upsert", "ndjson_rows")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false", "spark__driver__memory": "16g",
        "spark__driver__host": "localhost", "spark__driver__bindAddress": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    # The published figures are for a resident service, so session and Python workers are started before timing.
    for name in ("map_exact", "melt_unpivot"):
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        started = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - started, 3)
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "melted_values_per_sec": round(4 * rows / timings["melt_unpivot"]),
        "series_values_per_sec": round(4 * rows / timings["analysis_month"])}))
    spark.stop()


if __name__ == "__main__":
    main()
