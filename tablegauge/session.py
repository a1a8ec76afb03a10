"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tablegauge", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on and a fixed UTC clock."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # no call-site capture for every column expression: plans here have thousands of them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it in ``spark.checkpoint.dir``.

    Only a master inside this process (``local``, ``local[n]``) may fall back to a folder of its own where the setting is
    missing, as in tests; the name is then kept in the session's settings, so that there is one folder per session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[[^,\]]*(,[^,\]]*)?\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tablegauge-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table below the shared folder, on whatever file system it is."""
    if not path.startswith(f"{shared_folder(spark)}/"):
        raise ValueError(f"{path} is not below the shared folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, where the cluster has not installed it; once per Spark context.

    Spark serves the archive to its executors; the driver's copy lies in a temporary folder.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    if f"{name}.zip" in context._python_includes:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join(name, os.path.relpath(os.path.join(folder, f), package)))
    context.addPyFile(archive)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a fixed result that a lost executor cannot change."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Scan results over all cores when the input has fewer splits than the cluster has cores.

    For work that costs much more per row than moving the row, such as parsing documents. A table of many splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
