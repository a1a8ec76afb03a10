"""Saving collected tables, check results, accuracy rows and plan documents; dropping them again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def _try_read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def save(tables: dict[str, DataFrame], path: str, refresh: bool = False) -> dict[str, DataFrame]:
    """Write each table below ``path`` and read it back; tables already there are reused unless ``refresh``."""
    out = {}
    for name, df in tables.items():
        spark, target = df.sparkSession, f"{path}/{name}"
        kept = None if refresh else _try_read(spark, target)
        if kept is None:
            df.write.mode("overwrite").parquet(target)
            kept = spark.read.schema(df.schema).parquet(target)
        out[name] = kept
    return out


def load(spark: SparkSession, names: list[str], path: str) -> dict[str, DataFrame] | None:
    """The saved tables, or None when one of them is missing."""
    out = {n: _try_read(spark, f"{path}/{n}") for n in names}
    return None if any(df is None for df in out.values()) else out


def write_results(results: dict[str, DataFrame], path: str) -> dict[str, int]:
    """One result set per check; an empty one gets a single marker row. Gives the rows of each."""
    counts = {}
    for name, df in results.items():
        target = f"{path}/{name}"
        df.write.mode("overwrite").parquet(target)
        counts[name] = df.sparkSession.read.schema(df.schema).parquet(target).count()
        if counts[name] == 0:
            marker = df.sparkSession.range(1).select(F.lit(name).alias("check"), F.lit("No rows").alias("result"))
            marker.write.mode("overwrite").parquet(target)
    return counts


def append_results(df: DataFrame, path: str, cleanup: bool = False) -> DataFrame:
    """Add rows to one shared result table, or start it anew."""
    df.write.mode("overwrite" if cleanup else "append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_plans(plans: DataFrame, path: str) -> None:
    """One folder per query hash, in it one per distinct plan (named by its md5) with one file of its text.

    Plans are dealt out by hash and plan, so a hash with many plans is no single task's work.
    """
    texts = plans.filter("plan_doc IS NOT NULL").select("query_hash", F.md5("plan_doc").alias("plan"), F.col("plan_doc").alias("value"))
    one_each = texts.groupBy("query_hash", "plan").agg(F.first("value").alias("value"))
    one_each.write.mode("overwrite").partitionBy("query_hash", "plan").text(path)


def cleanup(spark: SparkSession, prefix: str) -> list[str]:
    """Drop all catalog tables whose name starts with ``prefix``."""
    dropped = []
    for t in spark.catalog.listTables():
        if t.name.lower().startswith(prefix.lower()):
            if t.isTemporary:
                spark.catalog.dropTempView(t.name)
            else:
                spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
            dropped.append(t.name)
    return sorted(dropped)
