"""Session set-up, shared storage and the few size checks the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS_PER_TASK_KEY = "spark.plantwatch.rowsPerTask"
ROWS_PER_TASK = 2_000_000
SMALL_TABLE_ROWS = 100_000
_SHIPPED: set[str] = set()


def build_session(app: str = "plantwatch", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, so that functions sent to them can import it.

    Spark's own file server hands the archive out; it is sent once per Spark context.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):
        archive = os.path.join(tempfile.mkdtemp(prefix="plantwatch-package-"), "plantwatch.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a folder of this machine; on a cluster
    an unset folder is an error, because other executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="plantwatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None, compression: str | None = None,
                file_rows: int | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; ``file_rows``: most rows of a file, where rows are big.

    Parquet's writer and reader hold at least 100 rows at a time, or all of a file.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write
    if compression:
        writer = writer.option("compression", compression)
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def rows_per_task(spark: SparkSession) -> int:
    """Most rows of one group that one task may sort; bigger groups are split."""
    return int(spark.conf.get(ROWS_PER_TASK_KEY, str(ROWS_PER_TASK)))


def fits_one_task(df: DataFrame, limit: int | None = None) -> bool:
    """True when the whole frame is below the per-task size, so no group can be hot."""
    return df.count() <= (limit or rows_per_task(df.sparkSession))


def spread(df: DataFrame, most_splits: int = 16) -> DataFrame:
    """Share a scan of very few splits among the cores.

    A file with one row group is one task, however many cores there are. Only a scan
    of at most ``most_splits`` splits (about 2 GB) is redistributed; anything bigger
    is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits <= most_splits and splits * 2 <= cores else df


def pin_small(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Turn a small result into a local table that joins broadcast, so joins with it need no shuffle.

    At most ``max_rows + 1`` rows are fetched. A bigger result is returned as it
    is and keeps its distributed plan, and Spark then picks a shuffled join. Spark does not
    know the size of a table made from rows: without the hint it shuffles the other side
    by the few keys of this one.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
