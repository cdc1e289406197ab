"""Session building and stage materialisation."""

from __future__ import annotations

import functools
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from hydromelt import config as C

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keep splitting a skewed join side even if that costs an extra exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build(app: str = "hydromelt", master: str | None = None, **confs: str) -> SparkSession:
    """A session with the engine's defaults; ``confs`` (dots as ``__``) win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = dict(DEFAULTS)
    wanted.update({key.replace("__", "."): value for key, value in confs.items()})
    for key, value in wanted.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


@functools.cache
def packed() -> str:
    """The package as a zip file, packed once per driver."""
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="hydromelt-"), "hydromelt.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                out.write(file, os.path.relpath(file, os.path.dirname(top)))
    return path


def ship(spark: SparkSession) -> None:
    """Gives the package to the workers, which may not have it; Spark copies the file to them, once per application.

    Batches for them are bounded by bytes too, unless the session sets a bound of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(C.ARROW_BATCH_BYTES))
    shipped = os.path.basename(packed()) in [os.path.basename(f) for f in spark.sparkContext._python_includes]
    if not shipped:
        spark.sparkContext.addPyFile(packed())


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A local master without one gets a temporary folder: driver and executors are one process there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), "hydromelt-scratch")


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage in a way that survives lost executors, and lets later steps
    prune columns and row groups instead of recomputing the producer. The table
    goes with :func:`release`, or else when the application ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    # Several files per task, so that one task's large output is read by many.
    writer = df.write.mode("errorifexists").option("maxRecordsPerFile", C.STAGE_FILE_ROWS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def _place(spark: SparkSession, path: str):
    """A path and its file system, as the JVM knows them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that no plan will read again, and lets Spark drop the shuffle files of plans that are gone.

    Shuffle files go when the driver's JVM finds their plan unreachable, which on a quiet driver takes long.
    """
    for table in tables:
        place, files = _place(table.sparkSession, table.staged_at)
        files.delete(place, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def work_splits(spark: SparkSession) -> int:
    """Number of splits for stages whose work is heavy for their bytes.

    Adaptive execution merges small shuffle outputs by size; asking for a number keeps
    such stages parallel. It follows the shuffle setting the cluster is sized by.
    """
    return C.SPLITS_PER_SHUFFLE_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal a table of few files out over all cores before per-row work, and over more tasks the larger its files are.

    A table of at least one file per core is left alone: Spark splits its large files. ``by`` names columns to deal by, which
    spares the sort of a round-robin exchange; as later aggregations by these columns stay in the same tasks, a task's share must not grow.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if len(files) >= cores:
        return df
    size = sum(held.getFileStatus(place).getLen() for place, held in (_place(spark, file) for file in files))
    return df.repartition(max(cores, -(-size // C.SPREAD_BYTES)), *by)
