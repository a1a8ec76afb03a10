"""Reading tables, one or many."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from fnmatch import fnmatch

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_named(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def collect_all(
    sources: dict[str, Callable[[], DataFrame] | DataFrame],
    name_filter: str = "*",
    exclude: Iterable[str] = (),
) -> DataFrame:
    """All wanted sources as one frame with a ``source_name`` column.

    A source is a frame or a function that opens one. A source that cannot be opened is reported and skipped.
    """
    skip = set(exclude)
    merged = None
    for name, source in sources.items():
        if name in skip or not fnmatch(name, name_filter):
            continue
        try:
            df = source() if callable(source) else source
            df = df.withColumn("source_name", F.lit(name))
        except (PySparkException, OSError) as e:
            log.warning("source %s skipped: %s", name, str(e).splitlines()[0])
            continue
        merged = df if merged is None else merged.unionByName(df, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no source could be read")
    return merged


EVENT_LOG_SCHEMA = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("text_data", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("database_name", T.StringType()),
])


def read_events(spark: SparkSession, log_df: DataFrame | None, names: Iterable[str]) -> DataFrame:
    """The event log cut to the wanted event names; an empty log of the same schema when there is none."""
    if log_df is None:
        return spark.createDataFrame([], EVENT_LOG_SCHEMA)
    return log_df.filter(F.col("event_name").isin(list(names))).select(*EVENT_LOG_SCHEMA.names)


def count_events(events: DataFrame) -> DataFrame:
    return events.groupBy("event_name").agg(F.count(F.lit(1)).alias("events"))
