"""Running all checks and the prioritised summary of their results."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Metric:
    check: str  # name of the result it is counted on
    info: str
    where: str = "true"  # rows that count
    priority: str = "High"
    fix: str = ""
    kind: str = "count"  # count | percent | distinct | any | none | value | total
    expr: str = ""  # what distinct counts, or the value


METRICS = [
    Metric("stat", "Databases", priority="NA", kind="total", expr="count(DISTINCT database_name)"),
    Metric("stat", "Tables", priority="NA", kind="total", expr="count(DISTINCT database_name || '.' || table_name)"),
    Metric("stat", "Statistics", priority="NA", kind="total", expr="count(*)"),
    Metric("stat", "Databases with statistics that are not refreshed by themselves", "NOT is_auto_update_stats_on", fix="Switch it on or refresh by schedule", kind="distinct", expr="database_name"),
    Metric("stat", "Databases with tables whose statistics are not created by themselves", "NOT is_auto_create_stats_on", fix="Switch it on", kind="distinct", expr="database_name"),
    Metric("stat", "Databases that create statistics by themselves but do not refresh them", "is_auto_create_stats_on AND NOT is_auto_update_stats_on", "Medium", "Switch both on", "distinct", "database_name"),
    Metric("stat", "Partitioned tables that a rebuild of an index would only sample", "is_table_partitioned AND statistic_type = 'Index_Statistic'", fix="Refresh after the rebuild", kind="distinct", expr="database_name || '.' || table_name"),
    Metric("chk01_history", "No history of refreshes found", "number_of_statistic_data_available > 1", "Medium", "Keep the history", "none"),
    Metric("src_event_filter", "No log of events found", priority="Low", fix="Log them", kind="none"),
    Metric("chk30_stale", "Changed statistics not refreshed for a day", "hours_since_last_update >= 24 AND current_number_of_modified_rows_since_last_update > 0", fix="Schedule a refresh"),
    Metric("chk30_stale", "Percent of statistics changed and not refreshed for a day", "hours_since_last_update >= 24 AND current_number_of_modified_rows_since_last_update > 0", kind="percent"),
    Metric("chk08_tiny", "Tiny tables with changed statistics", fix="Refresh them"),
    Metric("chk23_small_sample", "Statistics sampled below 5 percent", "statistic_percent_sampled < 5", "Medium", "Take a larger sample"),
    Metric("chk42_sample_rate", "Statistics an automatic refresh would sample below 5 percent", "auto_update_percent_sample < 5", "Low", "Refresh with a set sample"),
    Metric("chk34_steps_changed", "Statistics whose sample may have become smaller", fix="Pin them and refresh by schedule"),
    Metric("chk30_stale", "Statistics with 1000 modifications or 1 percent of the table", "current_number_of_modified_rows_since_last_update >= 1000 OR current_number_of_modified_rows_since_last_update * 100 > current_number_of_rows", fix="Refresh more often"),
    Metric("chk01_history", "Statistics refreshed only once", "number_of_statistic_data_available = 1"),
    Metric("chk28_duplicate", "Duplicated statistics", "comment <> 'OK'", fix="Drop them"),
    Metric("chk05_unused", "Unused statistics", fix="Drop them"),
    Metric("chk40_missing_multicol", "References without a statistic on their columns", "comment <> 'OK'", "Low", "Create them"),
    Metric("chk41_auto_multicol", "Automatic statistics over several columns", priority="Medium", fix="Keep those that are needed"),
    Metric("chk39_events", "Logged events of missing column statistics", priority="Medium", fix="Look at the queries"),
    Metric("chk35_leftover", "Statistics left behind by a tuning tool", fix="Drop them"),
    Metric("chk31_empty_hist", "Statistics without a histogram", priority="Low", fix="Refresh them"),
    Metric("chk27_too_many", "Statistics on tables with more statistics than columns", "comment <> 'OK'", "Low", "Drop duplicates"),
    Metric("chk26_wide_keys", "Statistics on large values", fix="Pin them where they cost too much"),
    Metric("chk25_pinned", "Statistics without automatic refresh", "comment <> 'OK'", fix="Make sure a schedule refreshes them"),
    Metric("chk33_persisted", "Statistics with a persisted sample", "persisted_sample_percent > 0", "Low", "Check that it is wanted"),
    Metric("chk33_persisted", "Full scans without a persisted sample", "comment LIKE 'Warning - Full scan without%'", "Medium"),
    Metric("chk33_persisted", "Full scans with a persisted sample", "comment LIKE 'Warning - Full scan with a %'", fix="Check that it is wanted"),
    Metric("chk07_threshold", "Statistics with the static threshold", "auto_update_threshold_type = 'Static'", "Low"),
    Metric("chk20_partition", "Statistics of partitioned tables not kept per partition", "comment LIKE 'Warning%'", "Medium", "Keep them per partition"),
    Metric("chk10_ascending", "Ascending or descending keys", priority="Medium", fix="Look at queries on the newest data"),
    Metric("chk14_filter_candidates", "Filtered statistics", "filter_definition IS NOT NULL", "Low"),
    Metric("chk14_filter_candidates", "Candidates for a filtered statistic", "comment_1 <> 'OK' OR comment_2 <> 'OK'", fix="Create filtered statistics"),
    Metric("chk16_filtered_stale", "Filtered statistics not refreshed for a day", "comment <> 'OK'", fix="Refresh more often"),
    Metric("chk15_skew", "Histograms with gaps inside a step", "comment_1 <> 'OK'", fix="Take a larger sample"),
    Metric("chk15_skew", "Histograms with half of the rows inside one step", "range_rows_percent_from_total >= 50", fix="Look at the queries"),
    Metric("chk15_skew", "Histograms with half of the rows on one value", "eq_rows_percent_from_total >= 50", fix="Look at the queries"),
    Metric("chk15_skew", "Histograms with many NULLs", "comment_4 <> 'OK'"),
    Metric("chk02_cadence", "Statistics refreshed without modifications", "comment_1 <> 'OK'", fix="Look at the schedule"),
    Metric("chk02_cadence", "Statistics refreshed twice within 15 minutes", "comment_2 <> 'OK'"),
    Metric("chk02_cadence", "Statistics not refreshed for over 25 hours", "comment_3 <> 'OK'", "Low", "Look at the schedule"),
    Metric("chk02_cadence", "Statistics refreshed hourly or more often", "comment_4 <> 'OK'", "Low"),
    Metric("chk06_mod_rate", "Statistics that change faster than the average", "comment <> 'OK'", "Low"),
    Metric("chk07_threshold", "Statistics about to be refreshed", "comment_1 LIKE 'Warning - The next query%' OR comment_1 LIKE 'Warning - The threshold is reached within%'", "Medium"),
    Metric("chk07_threshold", "Statistics past their threshold", "comment_1 LIKE 'Warning - The next query%' OR comment_1 LIKE 'Warning - The threshold is reached but%'", "Medium"),
    Metric("chk29_large", "Very large tables", "comment <> 'OK'", fix="Give them their own schedule", kind="distinct", expr="database_name || '.' || table_name"),
    Metric("log_asof_forward", "Slow compilations explained by a refresh", priority="Low", fix="Look at the queries"),
    Metric("chk46_order_mismatch", "Statistics whose stored column order differs", priority="Low", fix="Do not rely on the stored order"),
    Metric("chk04_nearest_event", "Events caused by a refresh", "comment_1 LIKE 'Event was%'", "Low", "Refresh outside working hours"),
    Metric("chk19_group_flag", "Databases with partitioned tables but no statistics per partition", "comment LIKE 'Warning%'", fix="Keep statistics per partition"),
    Metric("chk50_bad_leading", "Statistics with a bad first column", "comment <> 'OK'", fix="Put the most selective column first"),
    Metric("chk17_name_without_word", "Objects named without the second word", "NOT has_word", "Low", "Add the word"),
    Metric("log_call_rate", "Statistics loads per minute from remote queries", priority="Low", fix="Watch compile times", kind="value", expr="executions_per_minute"),
    Metric("chk22_phrase", "Texts that refresh statistics by hand", priority="Medium", fix="Check that it is needed"),
    Metric("plan_many_refs", "Plans that load many statistics", priority="Medium", fix="Look at compile times"),
    Metric("plan_stale_refs", "Plans on statistics with many modifications", fix="Check that refreshes run"),
    Metric("chk24_big_tables", "More parallel refreshes worth a look", "comment_large LIKE 'Warning%'", "Medium", "Raise the parallelism", "any"),
    Metric("chk43_keyword_2hop", "No maintenance plan found", "comment = 'OK'", "High", "Set one up", "none"),
    Metric("chk51_busy_window", "Collected within hours of the busy window", "after_window", "Low", "Collect at another time", "any"),
    Metric("chk11_hidden_ascending", "Keys that grow but are not typed so", "comment LIKE 'Warning%'", "Medium", kind="any"),
    Metric("chk12_hidden_ascending_list", "Keys that grow but are not typed so, without share", priority="Medium", kind="any"),
    Metric("chk24_big_tables", "Tables to refresh in parallel", "comment_huge LIKE 'Warning%'", "Medium", kind="any"),
]


def check_label(name: str) -> str:
    """``chk05_unused`` -> ``Check5``; other results keep their name."""
    m = re.match(r"chk0*(\d+)", name)
    return f"Check{m.group(1)}" if m else "NA" if name == "stat" else name


def metric_sql(m: Metric) -> str:
    """SQL text of the result of one metric over the rows of its check."""
    hits = f"count(CASE WHEN {m.where} THEN 1 END)"
    return {
        "count": f"CAST({hits} AS STRING)",
        "percent": f"CAST(CAST(round(100.0 * {hits} / greatest(count(*), 1)) AS BIGINT) AS STRING)",
        "distinct": f"CAST(count(DISTINCT CASE WHEN {m.where} THEN {m.expr} END) AS STRING)",
        "any": f"CASE WHEN {hits} > 0 THEN '1' ELSE '0' END",
        "none": f"CASE WHEN {hits} > 0 THEN '0' ELSE '1' END",
        "value": f"CAST(max({m.expr}) AS STRING)",
        "total": f"CAST({m.expr} AS STRING)",
    }[m.kind]


class ChecksFailed(RuntimeError):
    """What a summary counts on has failed, so that its figures would be those of a part."""


class Results(dict):
    """Results by name of the check; ``failed`` has the error of each check that gave none."""

    def __init__(self, found: dict[str, DataFrame], failed: dict[str, str]):
        super().__init__(found)
        self.failed = failed


def summary(results: dict[str, DataFrame], metrics: list[Metric] = METRICS) -> DataFrame:
    """All metrics whose check has a result: one aggregation per check. A check that was run for a metric and failed is an error here."""
    wanted = {m.check for m in metrics}
    if failed := [f"{name}: {e}" for name, e in getattr(results, "failed", {}).items() if name in wanted]:
        raise ChecksFailed(f"{len(failed)} checks failed: {'; '.join(failed)}")
    merged = None
    for check in dict.fromkeys(m.check for m in metrics):
        if check not in results:
            continue
        mine = [(i, m) for i, m in enumerate(metrics) if m.check == check]
        figures = results[check].agg(*[F.expr(metric_sql(m)).alias(f"m{i}") for i, m in mine])
        rows = ", ".join(
            f"{i}, '{m.info}', m{i}, '{m.priority}', '{check_label(m.check)}', '{m.fix}'" for i, m in mine)
        part = figures.selectExpr(f"stack({len(mine)}, {rows}) AS (metric, info, result, priority, more_info, quick_fix)")
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        raise ValueError("no check has a result")
    return merged.orderBy("metric").select("info", "result", "priority", "more_info", "quick_fix")


def priority_counts(summary_df: DataFrame) -> DataFrame:
    return summary_df.filter("priority <> 'NA'").groupBy("priority").agg(F.count(F.lit(1)).alias("metrics")).orderBy("priority")


def collected_after_window(window: DataFrame, collected_at: str, hours: int = 4) -> DataFrame:
    """Whether the collection was made within a few hours after the busy window."""
    gap = F.timestamp_diff("HOUR", F.col("max_end_datetime"), F.lit(collected_at).cast("timestamp_ntz"))
    return window.select("max_end_datetime", gap.alias("hours_after_window"), (gap <= hours).alias("after_window"))


def natural_order(names) -> list[str]:
    return sorted(names, key=lambda n: [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", n)])


def run_all(checks: dict[str, Callable[[], DataFrame]], path: str, at_once: int = 4) -> tuple[Results, dict[str, float]]:
    """Run the checks as jobs of their own, ``at_once`` side by side, write each result below ``path`` and read it back.

    Jobs are begun in natural order of the names of checks and share the executors as Spark schedules them. A check that fails, also while it
    runs, leaves the others; its error is in ``failed`` of the results, and a summary that counts on it fails too. The seconds of each check come
    with the results.
    """
    def run(name: str) -> tuple[DataFrame | None, str | None, float]:
        start, result, error = time.monotonic(), None, None
        try:
            df = checks[name]()
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            result = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
        except (PySparkException, Py4JJavaError, ValueError, KeyError) as e:
            error = str(e).splitlines()[0] if str(e) else type(e).__name__
            log.warning("check %s failed: %s", name, error)
        took = time.monotonic() - start
        log.info("check %s took %.1f s", name, took)
        return result, error, took

    names = natural_order(checks)
    with ThreadPoolExecutor(at_once) as pool:
        done = dict(zip(names, pool.map(run, names)))
    found = Results({n: df for n, (df, e, _) in done.items() if e is None}, {n: e for n, (_, e, _) in done.items() if e is not None})
    return found, {n: took for n, (_, _, took) in done.items()}
