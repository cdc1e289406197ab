"""Analysis requests: conditions, period series, evidence rows, run records."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt.functions import values
from hydromelt.operators.standards import applicable_limits, checked_scale, violated

CONDITIONS = ("struct<site_names:array<string>,outlets:array<string>,item_codes:array<string>,"
              "sample_type:string,from:date,to:date,bucket:string,metric:string,standard_set:string,"
              "region_grade:string,scale:string>")


@dataclass(frozen=True)
class AnalysisRequest:
    """Conditions of one analysis; bucket, metric and scale are closed lists."""

    site_names: list[str] = field(default_factory=list)
    outlets: list[str] = field(default_factory=list)
    item_codes: list[str] = field(default_factory=list)
    sample_type: str | None = None
    from_date: date | None = None
    to_date: date | None = None
    bucket: str | None = None
    metric: str | None = None
    standard_set: str | None = None
    region_grade: str | None = None
    scale: str | None = None

    def __post_init__(self):
        for name, allowed in (("bucket", values.BUCKETS), ("metric", values.METRICS), ("scale", C.SCALES)):
            chosen = getattr(self, name)
            if chosen is not None and chosen not in allowed:
                raise ValueError(f"{name} must be one of {tuple(allowed)}, not {chosen!r}")

    def with_defaults(self) -> "AnalysisRequest":
        return replace(self, site_names=self.site_names or [], outlets=self.outlets or [],
                       item_codes=self.item_codes or [], bucket=self.bucket or "month",
                       metric=self.metric or "avg", standard_set=self.standard_set or C.DEFAULT_STANDARD_SET)

    def assumptions(self) -> list[str]:
        """What the defaults filled in, in words."""
        open_points = {
            "bucket": self.bucket is None, "metric": self.metric is None,
            "period": self.from_date is None and self.to_date is None,
            "region_grade": self.region_grade is None, "scale": self.scale is None}
        return [C.ASSUMPTIONS[name] for name, assumed in open_points.items() if assumed]

    def conditions(self) -> dict:
        """The stored form of the request."""
        stored = {("from" if k == "from_date" else "to" if k == "to_date" else k): v
                  for k, v in asdict(self).items()}
        return {k: v.isoformat() if isinstance(v, date) else v for k, v in stored.items()}

    @classmethod
    def from_conditions(cls, stored: dict) -> "AnalysisRequest":
        known = dict(stored)
        for name in ("from", "to"):
            text = known.pop(name, None)
            known[f"{name}_date"] = date.fromisoformat(text) if isinstance(text, str) else text
        return cls(**known).with_defaults()


def condition(request: AnalysisRequest) -> Column:
    """Row filter of a request; an empty list restricts nothing."""
    parts = [F.col(name).isin(chosen) for name, chosen in (
        ("site_name", request.site_names), ("outlet", request.outlets), ("item_code", request.item_codes)) if chosen]
    if (request.sample_type or "").strip():
        parts.append(F.col("sample_type") == request.sample_type)
    if request.from_date:
        parts.append(F.col("measured_on") >= F.lit(request.from_date))
    if request.to_date:
        parts.append(F.col("measured_on") <= F.lit(request.to_date))
    return values.all_of([*parts, F.col("measured_on").isNotNull()])


def insensitive(df: DataFrame, columns: tuple[str, ...] = ("site_name", "outlet", "sample_type")) -> DataFrame:
    """The table with texts that compare and group without regard to case and accents."""
    return df.withColumns({c: F.collate(F.col(c), "UNICODE_CI_AI") for c in columns})


def owned(measurements: DataFrame, files: DataFrame, owner: int | None) -> DataFrame:
    """Rows of files the owner holds."""
    if owner is None:
        return measurements
    return measurements.join(files.where(F.col("owner_user_id") == owner).select("file_id"), "file_id", "left_semi")


def series(measurements: DataFrame, request: AnalysisRequest) -> DataFrame:
    """Aggregate per period bucket and item, with the number of unusable values.

    A text among aggregates would make Spark sort all rows. Units are therefore told apart first, in the same
    hashed aggregation, and the least one is taken from the few that a group has.
    """
    request = request.with_defaults()
    number = values.METRICS[request.metric](F.col("value_num"))
    rounded = number if request.metric == "count" else F.round(number, 4)
    grouped, spelled = values.BUCKETS[request.bucket]
    return (measurements.where(condition(request))
            .groupBy(grouped(F.col("measured_on")).alias("_period"), "item_code")
            .agg(rounded.alias("value"), F.count("*").alias("n"),
                 F.count_if(F.col("value_num").isNull()).alias("missing"),
                 F.array_min(F.expr("collect_list(DISTINCT unit)")).alias("unit"))
            .select(spelled(F.col("_period")).alias("bucket"), "item_code", "value", "n", "missing", "unit"))


def series_limits(limits: DataFrame, request: AnalysisRequest) -> DataFrame:
    """Limit lines of a request; none unless a region is chosen."""
    request = request.with_defaults()
    if not (request.region_grade or "").strip():
        return limits.where(F.lit(False))
    lines = applicable_limits(limits, request.standard_set, request.region_grade, checked_scale(request.scale))
    return lines.where(F.col("item_code").isin(request.item_codes)) if request.item_codes else lines


def exceeded_points(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Series points outside any of their limits, one row per point.

    An item may have several limits: they are folded to the tightest pair
    first, which violates exactly when one of them is violated.
    """
    tight = lines.groupBy("item_code").agg(F.max("limit_min").alias("limit_min"),
                                           F.min("limit_max").alias("limit_max"),
                                           F.count("*").alias("limit_rows"))
    return points.join(tight, "item_code").where(violated(F.col("value"), F.col("limit_min"), F.col("limit_max")))


def evidence(measurements: DataFrame, files: DataFrame, request: AnalysisRequest) -> DataFrame:
    """The stored rows behind an analysis, with their file names."""
    return measurements.where(condition(request.with_defaults())).join(
        files.select("file_id", F.col("original_filename").alias("filename")), "file_id")


EVIDENCE_ORDER = ("measured_on", "file_id", "source_row", "source_column_index")


def latest_version(ingestion_runs: DataFrame, files: DataFrame) -> DataFrame:
    """Dictionary version of the newest ingestion per owner, and when it ran."""
    return ingestion_runs.join(files.select("file_id", "owner_user_id"), "file_id").groupBy("owner_user_id").agg(
        F.max_by("dictionary_version", F.struct("ran_at", "file_id")).alias("dictionary_version"),
        F.max("ran_at").alias("ran_at"))


def run_record(points: DataFrame, lines: DataFrame, request: AnalysisRequest, plan: str, execution_id: str) -> DataFrame:
    """One stored row of a run: conditions and counts over all points and limit lines.

    Points and lines themselves are stored as tables under the run's id, see :func:`keyed`.
    """
    import json

    over = exceeded_points(points, lines).agg(F.count("*").alias("exceeded_count"))
    body, rows = points.agg(F.count("*").alias("row_count")), lines.agg(F.count("*").alias("limit_count"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    joined = one(body).join(one(over), "_one").join(one(rows), "_one").drop("_one")
    full = request.with_defaults()
    return joined.select(
        F.lit(execution_id).alias("execution_id"),
        F.lit(json.dumps(full.conditions(), ensure_ascii=False)).alias("conditions"),
        F.lit(json.dumps(request.assumptions(), ensure_ascii=False)).alias("assumptions"),
        F.lit(plan).alias("generated_plan"), F.lit(C.RULESET_VERSION).alias("ruleset_version"),
        F.lit(full.standard_set).alias("standard_set"), F.lit(full.region_grade).alias("region_grade"),
        F.lit(full.scale).alias("scale"), "row_count", "exceeded_count", "limit_count")


def keyed(rows: DataFrame, execution_id: str) -> DataFrame:
    """Rows of one run as they are stored with those of others."""
    return rows.select(F.lit(execution_id).alias("execution_id"), "*")
