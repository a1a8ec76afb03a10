"""Roll-ups of a query log: totals, one row per query hash, derived figures, counters and call rates.

A log row is one execution: query_hash, plan_hash, plan_handle, id, execution_time, creation_time, cpu, elapsed, reads,
writes, rows. Times are microseconds, reads and writes pages of 8 KB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import boundaries, idiv
from ..functions.numbers import or_one, ratio
from .asof import asof_join

METRICS = ["cpu", "elapsed", "reads", "writes", "rows"]


def valid_executions(log: DataFrame, stubs: DataFrame | None = None) -> DataFrame:
    """Executions with CPU time and a plan; plans that are only a stub are left out."""
    kept = log.filter((F.col("cpu") > 0) & (F.col("plan_hash") != "0"))
    return kept if stubs is None else kept.join(stubs.select("plan_handle").distinct(), "plan_handle", "left_anti")


def log_totals(valid: DataFrame) -> DataFrame:
    return valid.agg(F.count(F.lit(1)).alias("executions"), *[F.sum(m).alias(f"total_{m}") for m in METRICS])


def log_rollup(valid: DataFrame) -> DataFrame:
    """One row per query hash; the last figures come from its newest execution."""
    newest = F.max_by(F.struct("plan_hash", "creation_time", "execution_time", *METRICS), F.struct("execution_time", "id"))
    g = valid.groupBy("query_hash").agg(
        F.count_distinct("plan_hash").alias("plan_count"), F.count(F.lit(1)).alias("executions"), newest.alias("last"),
        *[f(m).alias(f"{n}_{m}") for m in METRICS for n, f in (("total", F.sum), ("min", F.min), ("max", F.max))],
    )
    return g.select(
        "query_hash", "plan_count", "executions", F.col("last.plan_hash").alias("last_plan_hash"),
        F.col("last.creation_time").alias("creation_time"), F.col("last.execution_time").alias("last_execution_time"),
        *[f"{n}_{m}" for m in METRICS for n in ("total", "min", "max")], *[F.col(f"last.{m}").alias(f"last_{m}") for m in METRICS],
    )


def query_impact() -> Column:
    return F.round(F.ln(F.col("total_cpu") * 3 + F.col("total_reads") + F.col("total_writes")), 2)


def log_metrics(valid: DataFrame) -> DataFrame:
    """The roll-up with impact, shares of the grand totals, rates, seconds and gigabytes."""
    roll = log_rollup(valid)
    totals = log_totals(valid).select(F.struct("*").alias("t")).scalar()
    share = lambda part, whole: F.when(F.coalesce(totals[whole], F.lit(0)) == 0, 0.0).otherwise(ratio(F.col(part), totals[whole], 2, 100))
    seconds = lambda c: ratio(c, F.lit(1_000_000), 4)
    gb = lambda c: ratio(c * 8, F.lit(1024 * 1024), 4)
    avg = lambda m: idiv(F.col(f"total_{m}"), F.col("executions"))
    minutes = boundaries("MINUTE", F.col("creation_time"), F.col("last_execution_time"))
    return roll.select(
        "query_hash", "plan_count", "creation_time", "last_execution_time", query_impact().alias("query_impact"), "executions",
        share("executions", "executions").alias("executions_percent"), idiv(F.col("executions"), or_one(minutes)).alias("executions_per_minute"),
        F.when(F.col("executions") == 1, F.timestamp_diff("MILLISECOND", F.col("creation_time"), F.col("last_execution_time"))).alias("compile_ms"),
        *[x for m in ("elapsed", "cpu") for x in (
            seconds(F.col(f"total_{m}")).alias(f"total_{m}_sec"), share(f"total_{m}", f"total_{m}").alias(f"{m}_percent"),
            seconds(avg(m)).alias(f"avg_{m}_sec"), seconds(F.col(f"min_{m}")).alias(f"min_{m}_sec"),
            seconds(F.col(f"max_{m}")).alias(f"max_{m}_sec"), seconds(F.col(f"last_{m}")).alias(f"last_{m}_sec"))],
        *[x for m in ("reads", "writes") for x in (
            F.col(f"total_{m}"), share(f"total_{m}", f"total_{m}").alias(f"{m}_percent"), avg(m).alias(f"avg_{m}"), F.col(f"min_{m}"), F.col(f"max_{m}"),
            F.col(f"last_{m}"), gb(F.col(f"total_{m}")).alias(f"total_{m}_gb"), gb(avg(m)).alias(f"avg_{m}_gb"))],
        "total_rows", avg("rows").alias("avg_rows"), "min_rows", "max_rows", "last_rows",
    )


def log_top(metrics: DataFrame, n: int = 5000, skip: bool = False) -> DataFrame:
    """The queries of most impact; none when the log is skipped."""
    return metrics.orderBy(F.desc("query_impact"), "query_hash").limit(0 if skip else n)


def counter_delta(before: DataFrame, after: DataFrame, key: str, counter: str) -> DataFrame:
    """Growth of a counter between two readings. A key that was not there before started at 0; a counter that has fallen was
    reset in between and has grown by what it shows now."""
    old, new = F.coalesce("before", F.lit(0)), F.col(counter)
    return after.join(before.select(key, F.col(counter).alias("before")), key, "left").select(
        key, old.alias("before"), new.alias("after"), F.when(new < old, new).otherwise(new - old).alias("delta"))


def counter_segments(readings: DataFrame, key: str, ts: str, counter: str, bucket: str = "DAY") -> DataFrame:
    """Per key and time bucket: first and last reading and the growth between them, where a reading below the one before is a reset.

    Buckets split the readings of a hot key; what lies between two buckets is added by ``joined_growth``.
    """
    order = Window.partitionBy("key", "bucket").orderBy("ts", "counter")
    new, old = F.col("counter"), F.col("old")
    rows = readings.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(counter).cast("long").alias("counter")).filter(
        "key IS NOT NULL AND ts IS NOT NULL AND counter IS NOT NULL")
    return rows.withColumn("bucket", F.date_trunc(bucket, "ts").cast("timestamp_ntz")).withColumn("old", F.lag("counter").over(order)).groupBy("key", "bucket").agg(
        F.min_by("counter", F.struct("ts", "counter")).alias("first"), F.max_by("counter", F.struct("ts", "counter")).alias("last"),
        F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("readings"), F.count_if(new < old).alias("resets"),
        F.coalesce(F.sum(F.when(new < old, new).otherwise(new - old)), F.lit(0).cast("long")).alias("grown"))


def joined_growth(segments: DataFrame) -> DataFrame:
    """Growth per key over all its segments in order of their buckets; a segment without a bucket is what was known before and comes first."""
    order = Window.partitionBy("key").orderBy(F.asc_nulls_first("bucket"))
    first, old = F.col("first"), F.col("old")
    gap = F.when(F.col("bucket").isNull(), 0).when(old.isNull() | (first < old), first).otherwise(first - old)
    return segments.withColumn("old", F.lag("last").over(order)).groupBy("key").agg(
        F.max("last_ts").alias("last_ts"), F.max_by("last", F.struct(F.col("bucket").isNotNull(), "bucket")).alias("last"),
        F.sum("readings").alias("readings"), (F.sum("resets") + F.count_if(first < old)).alias("resets"), (F.sum("grown") + F.sum(gap)).alias("grown"))


def counter_growth(readings: DataFrame, key: str, ts: str, counter: str) -> DataFrame:
    """Growth of each key's counter over all its readings. The first reading counts from 0, a reading below the one before is a reset and counts
    whole; readings of one time are taken in order of their values, and those without key, time or value are left out."""
    return joined_growth(counter_segments(readings, key, ts, counter))


def row_variance(roll: DataFrame, pct: int = 30, rows: int = 100) -> DataFrame:
    """Queries whose row counts swing far around their average (min_rows, max_rows, avg_rows)."""
    lo, hi, avg = F.col("min_rows"), F.col("max_rows"), F.col("avg_rows")
    unstable = (idiv(lo + hi, F.lit(2)) >= rows) & ((lo * 100 < avg * (100 - pct)) | (hi * 100 > avg * (100 + pct)))
    return roll.select("*", unstable.alias("has_unstable_rows"))


SIZE_BANDS = [  # fixed values: lower bound in MB and text
    (20, "Gigantic plan (20MB or more)"), (15, "Enormous plan (15MB or more)"), (10, "Colossal plan (10MB or more)"),
    (5, "Huge plan (5MB or more)"), (2, "Big plan (2MB or more)"),
]


def size_band(mb: Column) -> Column:
    out = F.when(mb >= SIZE_BANDS[0][0], SIZE_BANDS[0][1])
    for low, text in SIZE_BANDS[1:]:
        out = out.when(mb >= low, text)
    return out.otherwise("Normal plan (less than 2MB)")


def clean_text(c: Column) -> Column:
    """Text that any document format can hold: no NUL, other control characters but tab and line ends as ``?``."""
    return F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit("")), "[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]", "?")


def cut_statement(c: Column, start: Column, end: Column) -> Column:
    """The part of a text between two byte offsets of two bytes per character; the whole text when that part is empty."""
    first = idiv(start, F.lit(2)) + 1
    length = F.when(end < start, 0).otherwise(idiv(end - start, F.lit(2))) + 2
    return F.coalesce(F.nullif(F.substr(c, first.cast("int"), length.cast("int")), F.lit("")), c)


def slow_with_update(plans: DataFrame, updates: DataFrame, slow_ms: int = 200, slack_ms: int = 50) -> DataFrame:
    """Slow compilations that a statistic refresh may explain.

    ``plans``: plan_id, start_time, compile_ms, plan_text. ``updates``: update_id, name, updated. The first refresh at or
    after the start counts if it falls before the end of the compilation and its name is in the plan.
    """
    slow = plans.filter(F.col("compile_ms") >= slow_ms)
    j = asof_join(slow, updates, "start_time", "updated", "plan_id", "update_id", "forward")
    end = F.timestamp_add("MILLISECOND", F.col("compile_ms") + slack_ms, F.col("start_time"))
    return j.filter((F.col("match.updated") <= end) & F.contains("plan_text", F.col("match.name"))).select(
        "plan_id", "start_time", "compile_ms", F.col("match.name").alias("associated_stats_name"),
        F.col("match.updated").alias("associated_update"),
    )


def call_rate(plans: DataFrame) -> DataFrame:
    """Most executions of one plan and its calls per minute (execution_count, creation_time, last_execution_time)."""
    g = plans.agg(F.max("execution_count").alias("n"), F.min("creation_time").alias("a"), F.max("last_execution_time").alias("b"))
    return g.select(
        F.coalesce("n", F.lit(0)).alias("total_execution_count"),
        F.coalesce(ratio(F.col("n"), or_one(boundaries("MINUTE", F.col("a"), F.col("b"))), 2), F.lit(0.0)).alias("executions_per_minute"))
