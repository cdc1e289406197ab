"""Running, storing and replaying analyses; the exceedance report."""

from __future__ import annotations

import contextlib
import io
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.operators import analysis, paging, standards
from hydromelt.operators.analysis import AnalysisRequest


@dataclass
class AnalysisResult:
    execution_id: str
    assumptions: list[str]
    series: DataFrame
    limits: DataFrame
    exceeded: DataFrame
    record: DataFrame


def plan_text(df: DataFrame) -> str:
    """The plan of a query, kept with its result as evidence."""
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    return shown.getvalue()


def run_analysis(measurements: DataFrame, files: DataFrame, limits: DataFrame, request: AnalysisRequest,
                 owner: int | None = None, ingestion_runs: DataFrame | None = None) -> AnalysisResult:
    """Series, limit lines, exceeded points and the record to store."""
    points = analysis.series(analysis.owned(measurements, files, owner), request)
    lines = analysis.series_limits(limits, request)
    execution_id = str(uuid.uuid4())
    record = analysis.run_record(points, lines, request, plan_text(points), execution_id)
    if ingestion_runs is not None:
        version = analysis.latest_version(ingestion_runs, files)
        if owner is not None:
            version = version.where(F.col("owner_user_id") == owner)
        newest = version.agg(F.max_by("dictionary_version", "ran_at").alias("dictionary_version")).withColumn("_one", F.lit(1))
        record = record.withColumn("_one", F.lit(1)).join(newest, "_one").drop("_one")
    return AnalysisResult(execution_id, request.assumptions(), points.orderBy("bucket", "item_code"), lines,
                          analysis.exceeded_points(points, lines), record)


def stored_request(conditions: str) -> AnalysisRequest:
    return AnalysisRequest.from_conditions(json.loads(conditions))


def replay(measurements: DataFrame, files: DataFrame, conditions: str, owner: int | None = None,
           page: int = 1, size: int = 20) -> tuple[DataFrame, int]:
    """A page of the rows behind a stored analysis, with their total number."""
    rows = analysis.evidence(analysis.owned(measurements, files, owner), files, stored_request(conditions))
    return paging.page_with_total(rows, [F.col(c) for c in analysis.EVIDENCE_ORDER], page, size)


def index_pages(measurements: DataFrame, files: DataFrame, conditions: str, path: str, owner: int | None = None) -> paging.PageIndex:
    """The rows behind a stored analysis, stored in order under ``path``, to be paged through at will."""
    rows = analysis.evidence(analysis.owned(measurements, files, owner), files, stored_request(conditions))
    return paging.PageIndex.build(rows, [F.col(c) for c in analysis.EVIDENCE_ORDER], path)


def exceedance_report(measurements: DataFrame, limits: DataFrame, standard_set: str = C.DEFAULT_STANDARD_SET,
                      region_grade: str = "가지역", scale: str | None = None,
                      file_id=None, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, rows) of values outside legal limits: all of them, or the newest ``rows``."""
    part = measurements if file_id is None else measurements.where(F.col("file_id") == file_id)
    found = standards.exceedances(part, limits, standard_set, region_grade, scale)
    tiebreak = [F.col(c) for c in ("file_id", "source_row", "source_column_index", "item_code", "limit_max")
                if c in found.columns]
    return standards.exceedance_counts(found), standards.top_exceedances(found, tiebreak, rows)
