"""Collects statistics of many tables at once: catalogue, headers, density vectors, histograms and update history.

Each key column is scanned once for the value counts of all statistics on it, and each table once for its row and byte
totals. Nothing but the declarations lives on the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..functions.keys import key_is_null, key_is_null_sql, key_sql
from ..functions.numbers import (
    LARGE_VALUE_BYTES, auto_threshold, density_values, or_one, pages, ratio, threshold_type, value_bytes,
)
from ..session import spread
from ..sources.definitions import StatDef, TableDef, in_sample, stat_def_frame
from ..sources.store import load, save
from .histogram import MAX_STEPS, histogram_steps, written_counts
from .sketches import DISTINCT_BITS, MERGE_GROUPS, tuple_hash

log = logging.getLogger(__name__)

SNAPS = [1, 2, 3, 4]  # 1 is the newest refresh


def _seen_at(table: TableDef, n: int) -> str:
    """SQL text: was a row there at the n-th refresh, newest first? Rows without an append time always were."""
    if n > len(table.cutoffs):
        return "false"
    if table.ts_column is None:
        return "true" if n == 1 else "false"
    return f"(`{table.ts_column}` IS NULL OR `{table.ts_column}` <= CAST('{table.cutoffs[n - 1]}' AS TIMESTAMP_NTZ))"


def _seen_now(table: TableDef) -> str:
    if table.ts_column is None:
        return "true"
    return f"(`{table.ts_column}` IS NULL OR `{table.ts_column}` <= CAST('{table.as_of}' AS TIMESTAMP_NTZ))"


def _sampled(s: StatDef, types: dict) -> str:
    on = s.sample_on or s.columns[0]
    return "true" if s.sample_pct is None else in_sample(on, types[on], s.sample_pct)


def key_counts(df: DataFrame, table: TableDef, stats: list[StatDef]) -> DataFrame:
    """Rows per (statistic, key value) in each snapshot, for all statistics of one table.

    Sampled counts are s1..s4, counts of all rows that pass the filter f0 (now) and f1..f4. A key column is read and grouped once, in its own
    type, for all statistics on it; what tells these apart are counts. So no row is multiplied before it is counted.
    """
    types = {f.name: f.dataType for f in df.schema}
    by_key: dict[str, list[StatDef]] = {}
    for s in stats:
        by_key.setdefault(s.columns[0], []).append(s)
    parts = []
    for key, own in by_key.items():
        dtype, rules = types[key], dict.fromkeys((s.filter, _sampled(s, types)) for s in own)
        place = {rule: i for i, rule in enumerate(rules)}
        counts = []
        for (where, sampled), i in place.items():
            kept = f"({where})" if where else "true"
            counts += [f"count_if({kept}) AS n{i}", *[f"count_if({kept} AND {p}) AS f{h}_{i}" for h, p in [(0, _seen_now(table)), *[(h, _seen_at(table, h)) for h in SNAPS]]]]
            counts += [f"count_if({kept} AND {_seen_at(table, h)} AND {sampled}) AS s{h}_{i}" for h in SNAPS if sampled != "true"]
        grouped = df.groupBy(F.col(f"`{key}`").alias("key")).agg(*map(F.expr, counts))
        entries = []
        for s in own:
            i = place[s.filter, _sampled(s, types)]
            sampled = "f" if s.sample_pct is None else "s"
            entries.append(
                f"IF(n{i} > 0, named_struct('rowid', {s.rowid}, 'hi', {key_sql('key', dtype)}, 'key_bytes', {value_bytes('key', dtype)}, "
                + ", ".join([*[f"'s{h}', {sampled}{h}_{i}" for h in SNAPS], *[f"'f{h}', f{h}_{i}" for h in [0, *SNAPS]]]) + "), NULL)")
        parts.append(grouped.selectExpr(f"explode(array({', '.join(entries)})) AS e").filter("e IS NOT NULL").select("e.*"))
    return _union(parts)


def _told_apart(name: str, dtype: T.DataType) -> str:
    """SQL text of a value that is only told apart from others; as text where the type itself does not compare like its text."""
    plain = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampNTZType, T.StringType)
    return f"`{name}`" if isinstance(dtype, plain) else f"CAST(`{name}` AS string)"


def prefix_sizes(df: DataFrame, table: TableDef, stats: list[StatDef]) -> DataFrame | None:
    """Distinct values and size of every prefix of two or more columns, at the newest refresh.

    Such values only need to be told apart, so they are grouped and never ordered or written.
    """
    types = {f.name: f.dataType for f in df.schema}
    parts = []
    for s in stats:
        keep = f"({s.filter or 'true'}) AND {_sampled(s, types)}"
        for n in range(2, len(s.columns) + 1):
            cols = s.columns[:n]
            rows = df.filter(_seen_at(table, 1)).filter(keep).selectExpr(
                *[f"{_told_apart(c, types[c])} AS v{i}" for i, c in enumerate(cols)], f"{' + '.join(value_bytes(c, types[c]) for c in cols)} AS key_bytes")
            values = rows.groupBy(*[f"v{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias("s1"), F.max("key_bytes").alias("key_bytes"))
            parts.append(_sizes(values.selectExpr(f"{s.rowid} AS rowid", f"{n} AS n", "s1", "key_bytes")))
    return _union(parts) if parts else None


def sketched_prefix_sizes(df: DataFrame, table: TableDef, stats: list[StatDef]) -> DataFrame | None:
    """As ``prefix_sizes``, with distinct values from sketches: of each prefix one sketch per group of tasks is shuffled, no values."""
    types = {f.name: f.dataType for f in df.schema}
    aggs, merged, stacked = [], [], []
    for s in stats:
        keep = F.expr(f"coalesce(({s.filter or 'true'}) AND {_sampled(s, types)}, false)")
        for n in range(2, len(s.columns) + 1):
            cols, at = s.columns[:n], len(stacked)
            size = F.expr(" + ".join(value_bytes(c, types[c]) for c in cols))
            aggs += [F.hll_sketch_agg(F.when(keep, tuple_hash(cols)), DISTINCT_BITS).alias(f"v{at}"), F.sum(F.when(keep, size)).alias(f"b{at}"), F.count_if(keep).alias(f"r{at}")]
            merged += [F.hll_sketch_estimate(F.hll_union_agg(f"v{at}")).alias(f"v{at}"), F.sum(f"b{at}").alias(f"b{at}"), F.sum(f"r{at}").alias(f"r{at}")]
            stacked.append(f"{s.rowid}, {n}, v{at}, b{at} / r{at}, r{at}")
    if not stacked:
        return None
    one = df.filter(_seen_at(table, 1)).groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("part")).agg(*aggs).agg(*merged)
    return one.selectExpr(f"stack({len(stacked)}, {', '.join(stacked)}) AS (rowid, n, distinct_values, average_length, rows_sampled)").filter("rows_sampled > 0")


def _sizes(values: DataFrame) -> DataFrame:
    return values.groupBy("rowid", "n").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.try_divide(F.sum(F.col("key_bytes") * F.col("s1")), F.sum("s1")).alias("average_length"),
        F.sum("s1").alias("rows_sampled"))


def table_profile(df: DataFrame, table: TableDef) -> DataFrame:
    """Row and byte totals of one table: one row."""
    sizes = [value_bytes(f.name, f.dataType) for f in df.schema]
    short = " + ".join(f"IF({s} <= {LARGE_VALUE_BYTES}, {s}, 0)" for s in sizes)
    large = " + ".join(f"IF({s} > {LARGE_VALUE_BYTES}, {s}, 0)" for s in sizes)
    return df.selectExpr(
        f"count_if({_seen_now(table)}) AS current_rows", *[f"count_if({_seen_at(table, h)}) AS rows{h}" for h in SNAPS],
        f"coalesce(sum(IF({_seen_now(table)}, {short}, 0)), 0) AS in_row_bytes",
        f"coalesce(sum(IF({_seen_now(table)}, {large}, 0)), 0) AS lob_bytes", f"'{table.name}' AS table_name",
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def density_vectors(counts: DataFrame, longer: list[DataFrame], defs: DataFrame) -> DataFrame:
    """Density of each column prefix at the newest refresh."""
    seen = _union([_sizes(counts.filter("s1 > 0").withColumn("n", F.lit(1))), *longer])
    return seen.join(F.broadcast(defs.select("rowid", "stat_columns")), "rowid").select(
        "rowid", F.col("n").alias("density_number"), (F.lit(1.0) / F.col("distinct_values")).alias("all_density"),
        "distinct_values", "average_length", "rows_sampled",
        F.expr("slice(stat_columns, 1, n)").alias("columns"),
    )


def update_history(counts: DataFrame, profile: DataFrame, steps: DataFrame, defs: DataFrame,
                   tables: list[TableDef]) -> DataFrame:
    """The last refreshes of each statistic: what was inserted since the one before, and on which side of its histogram."""
    first = counts
    keyed = first.filter(~key_is_null())
    bounds = steps.filter(~key_is_null()).groupBy("rowid").agg(*[
        F.expr(f"{side}_by(hi, IF(snap = {h}, stepnumber, NULL)) AS {side}{h}") for h in SNAPS[1:] for side in ("min", "max")])
    # one row per statistic
    placed = keyed.join(F.broadcast(bounds), "rowid")
    newest, oldest = SNAPS[:-1], SNAPS[-1]
    sides = placed.groupBy("rowid").agg(
        *[F.expr(f"count_if(s{h} > 0) AS keys{h}") for h in SNAPS],
        *[F.expr(f"sum(IF(hi > max{h + 1}, f{h} - f{h + 1}, 0)) AS above{h}") for h in newest],
        *[F.expr(f"sum(IF(hi < min{h + 1}, f{h} - f{h + 1}, 0)) AS below{h}") for h in newest],
        F.expr(f"0L AS above{oldest}"), F.expr(f"0L AS below{oldest}"),
    )
    inserted = first.groupBy("rowid").agg(
        *[F.sum(f"f{h}").alias(f"rows{h}") for h in SNAPS],
        *[F.expr(f"count_if({key_is_null_sql()} AND s{h} > 0) AS nullkeys{h}") for h in SNAPS])
    card = profile.select("table_name", *[F.col(f"rows{h}").alias(f"card{h}") for h in SNAPS])
    kept = {t.name: t for t in tables}
    spark = counts.sparkSession
    times = spark.createDataFrame(
        [(t.name, h, t.cutoffs[h - 1], t.ts_column is not None, h < len(t.cutoffs))
         for t in kept.values() for h in SNAPS if h <= len(t.cutoffs)],
        "table_name string, history_number int, updated string, readable boolean, has_previous boolean",
    ).withColumn("updated", F.col("updated").cast("timestamp_ntz"))
    rows = [
        f"named_struct('history_number', {h}, 'table_cardinality', card{h}, 'keys', keys{h} + nullkeys{h}, "
        f"'inserts', rows{h} - {f'rows{h + 1}' if h < oldest else '0'}, 'above', above{h}, 'below', below{h})" for h in SNAPS]
    entries = F.expr(f"array({', '.join(rows)})")
    long = (
        inserted.join(sides, "rowid", "left")
        .join(F.broadcast(defs.select("rowid", "table_name", "with_histogram")), "rowid")
        .join(F.broadcast(card), "table_name")
        .select("rowid", "table_name", "with_histogram", F.explode(entries).alias("x"))
        .select("rowid", "table_name", "with_histogram", "x.*")
        .join(F.broadcast(times), ["table_name", "history_number"])
    )
    n_steps = steps.groupBy("rowid", F.col("snap").alias("history_number")).agg(F.max("stepnumber").alias("steps"))
    ok = F.col("readable")
    zero = F.lit(0).cast("long")
    inserts = F.when(ok, F.col("inserts")).otherwise(zero)
    above = F.when(ok & F.col("has_previous"), F.col("above")).otherwise(zero)
    below = F.when(ok & F.col("has_previous"), F.col("below")).otherwise(zero)
    return (
        long.join(n_steps, ["rowid", "history_number"], "left")
        .select(
            "rowid", "history_number", "updated", "table_cardinality",
            F.when(F.col("with_histogram"), F.col("steps")).alias("steps"),
            F.when(F.col("keys") > 0, F.lit(1.0) / F.col("keys")).alias("density"),
            above.alias("rows_above"), below.alias("rows_below"),
            inserts.alias("inserts_since_last_update"), zero.alias("deletes_since_last_update"),
            leading_type(ok & F.col("has_previous"), inserts, above, below).alias("leading_column_type"),
        )
    )


def leading_type(has_previous: Column, inserts: Column, above: Column, below: Column) -> Column:
    """Ascending or Descending when at least 90% of the inserted rows lie outside on that side."""
    return (
        F.when(~has_previous | (F.coalesce(inserts, F.lit(0)) == 0), "Unknown")
        .when(above * 10 >= inserts * 9, "Ascending")
        .when(below * 10 >= inserts * 9, "Descending")
        .otherwise("Stationary")
    )


def modifications(inserts: Column, deletes: Column) -> Column:
    """|inserts| + |deletes|; NULL only when both are NULL."""
    zero = F.lit(0).cast("long")
    return F.when(inserts.isNotNull() | deletes.isNotNull(),
                  F.abs(F.coalesce(inserts, zero)) + F.abs(F.coalesce(deletes, zero)))


def catalogue(defs: DataFrame, profile: DataFrame, density: DataFrame, steps: DataFrame, counts: DataFrame,
              usage: DataFrame | None = None) -> DataFrame:
    """One row per statistic with everything the checks look at."""
    sizes = counts.groupBy("rowid").agg(
        F.sum("f1").alias("number_of_rows_at_time_stat_was_updated"),
        F.sum("s1").alias("rows_sampled"),
        F.sum("f0").alias("rows_now"),
        F.max("key_bytes").alias("max_key_bytes"),
        F.try_divide(F.sum(F.col("key_bytes") * F.col("s1")), F.sum("s1")).alias("average_key_length"),
    )
    n_steps = steps.filter("snap = 1").groupBy("rowid").agg(F.max("stepnumber").alias("found_steps"))
    full = density.groupBy("rowid").agg(
        F.max_by("distinct_values", "density_number").alias("distinct_full"),
        F.min_by("all_density", "density_number").alias("key_density"),
    )
    prof = profile.select(
        "table_name", F.col("current_rows").alias("current_number_of_rows"), F.col("rows1").alias("unfiltered_rows"),
        pages(F.col("in_row_bytes")).alias("number_of_in_row_data_pages_on_table"),
        pages(F.col("lob_bytes")).alias("number_of_lob_data_pages_on_table"),
    )
    zero = F.lit(0).cast("long")
    out = (
        defs.join(F.broadcast(prof), "table_name").join(sizes, "rowid", "left").join(n_steps, "rowid", "left")
        .join(full, "rowid", "left")
        .withColumn("number_of_rows_at_time_stat_was_updated", F.coalesce("number_of_rows_at_time_stat_was_updated", zero))
        .withColumn("rows_sampled", F.coalesce("rows_sampled", zero))
        .withColumn("current_number_of_modified_rows_since_last_update",
                    F.when(F.col("fixed_modifications") > 0, F.col("fixed_modifications"))
                    .otherwise(F.coalesce(F.col("rows_now"), zero) - F.col("number_of_rows_at_time_stat_was_updated")))
        .withColumn("steps", F.when(F.col("with_histogram") & (F.col("found_steps") > 0), F.col("found_steps")))
        .withColumn("statistic_percent_sampled", ratio(F.col("rows_sampled"), or_one(F.col("number_of_rows_at_time_stat_was_updated")), 2, 100))
        .withColumn("auto_update_threshold", F.when(F.col("dynamic_threshold"), auto_threshold(F.col("unfiltered_rows"))).otherwise(auto_threshold(F.col("unfiltered_rows"), False)))
        .withColumn("auto_update_threshold_type", F.when(F.col("dynamic_threshold"), threshold_type(F.col("unfiltered_rows"))).otherwise("Static"))
        .withColumn("percent_of_threshold", ratio(F.col("current_number_of_modified_rows_since_last_update"), or_one(F.col("auto_update_threshold")), 2, 100))
        .withColumn("is_unique", F.col("distinct_full") == F.col("rows_sampled"))
        .withColumn("is_lob", F.coalesce(F.col("max_key_bytes") > LARGE_VALUE_BYTES, F.lit(False)))
        .withColumn("has_filter", F.col("filter_definition").isNotNull())
        .withColumn("stat_all_columns", F.array_join("stat_columns", ","))
        .withColumn("number_of_statistics_in_this_table", F.count(F.lit(1)).over(Window.partitionBy("table_name")))
        .withColumn("fqn_stats_name", F.concat_ws(".", "database_name", "table_name", "stats_name"))
        .drop("found_steps", "rows_now", "distinct_full", "fixed_modifications", "dynamic_threshold")
    )
    if usage is not None:
        out = attach_usage_columns(out, usage)
    return out


USAGE_COUNTS = ["user_seeks", "user_scans", "user_lookups", "user_updates", "wait_count", "wait_ms"]
USAGE_TIMES = ["last_user_seek", "last_user_scan", "last_user_lookup"]


def attach_usage_columns(stat: DataFrame, usage: DataFrame) -> DataFrame:
    """Usage per statistic; its ages in seconds become times before the clock of the table."""
    cols = [*USAGE_COUNTS, *[c.replace("last_user", "age") for c in USAGE_TIMES]]
    out = stat.join(usage.select("rowid", *cols), "rowid", "left")
    for c in USAGE_TIMES:
        age = c.replace("last_user", "age")
        out = out.withColumn(c, F.timestamp_add("SECOND", -F.col(age), F.col("as_of"))).drop(age)
    return out.withColumn("last_used", F.greatest(*USAGE_TIMES))


FAILURES = (PySparkException, Py4JJavaError, OSError, KeyError, TypeError, ValueError)


def _first_pass(frames: dict[str, DataFrame], used: list[TableDef], by_table: dict[str, list[StatDef]], path: str) -> tuple[DataFrame, DataFrame]:
    """Value counts of all statistics and totals of their tables, written."""
    counts = written_counts(_union([key_counts(frames[t.name], t, by_table[t.name]) for t in used]), ["rowid", "hi"])
    return counts, save({"profile": _union([table_profile(frames[t.name], t) for t in used])}, path, True)["profile"]


def _can_be_read(frames: dict[str, DataFrame], table: TableDef, stats: list[StatDef]) -> bool:
    """Whether one table can be counted on its own; only asked for when all of them together have failed."""
    try:
        df = frames[table.name]
        key_counts(df, table, stats).write.format("noop").mode("overwrite").save()
        table_profile(df, table).write.format("noop").mode("overwrite").save()
        if (longer := prefix_sizes(df, table, stats)) is not None:
            longer.write.format("noop").mode("overwrite").save()
    except FAILURES as e:
        log.warning("table %s skipped: %s", table.name, str(e).splitlines()[0] if str(e) else type(e).__name__)
        return False
    return True


TABLES = ["stat", "stat_header", "density", "histogram", "stat_history", "profile"]


def collect(
    spark: SparkSession, frames: dict[str, DataFrame], tables: list[TableDef], stats: list[StatDef], path: str,
    refresh: bool = False, max_steps: int = MAX_STEPS, usage: Callable[[], DataFrame] | None = None, sketched: bool = False,
) -> dict[str, DataFrame]:
    """All collected tables, saved below ``path`` and reused from there unless ``refresh``.

    A table that fails, also while it is read, is reported and skipped with its statistics; the others are collected. With ``sketched``, distinct values
    of prefixes of two or more columns come from sketches.
    """
    if not refresh:
        kept = load(spark, TABLES, path)
        if kept is not None:
            return kept
    by_table = {t.name: [s for s in stats if s.table == t.name] for t in tables}
    for t in tables:
        if by_table[t.name] and t.name not in frames:
            log.warning("table %s skipped: it is not there", t.name)
    used = [t for t in tables if by_table[t.name] and t.name in frames]
    try:
        counts, profile = _first_pass(frames, used, by_table, path)
    except FAILURES:
        used = [t for t in used if _can_be_read(frames, t, by_table[t.name])]
        if not used:
            raise
        counts, profile = _first_pass(frames, used, by_table, path)
    kept_stats = [s for t in used for s in by_table[t.name]]
    defs = stat_def_frame(spark, frames, used, [s for s in stats if s in kept_stats])
    steps = histogram_steps(counts, SNAPS, max_steps)
    saved = save({"steps_all": steps}, path, True)["steps_all"]
    sizes_of = sketched_prefix_sizes if sketched else prefix_sizes
    longer = [p for t in used if (p := sizes_of(spread(frames[t.name]) if sketched else frames[t.name], t, by_table[t.name])) is not None]
    shown = defs.filter("with_histogram").select("rowid")
    out = save({
        "density": density_vectors(counts, longer, defs),
        "stat_history": update_history(counts, profile, saved, defs, used),
        "histogram": saved.filter("snap = 1").drop("snap").join(F.broadcast(shown), "rowid", "left_semi"),
    }, path, True)
    out["stat"] = save({"stat": catalogue(defs, profile, out["density"], saved, counts, usage() if usage else None)}, path, True)["stat"]
    out["stat_header"] = save({"stat_header": header_of(out["stat"])}, path, True)["stat_header"]
    out["profile"] = profile
    return out


def header_of(stat: DataFrame) -> DataFrame:
    return stat.select(
        "rowid", F.col("last_updated").alias("updated"), F.col("number_of_rows_at_time_stat_was_updated").alias("rows"),
        "rows_sampled", "steps", F.col("key_density").alias("density"), "average_key_length",
        F.col("filter_definition").alias("filter_expression"), "unfiltered_rows", "persisted_sample_percent",
    )
