"""Checks that look at the catalogue row of a statistic, with its header and density where needed.

Each check takes the collected tables and gives a frame whose comment columns hold ``OK``, ``Information - ...`` or
``Warning - ...``. Row limits are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.clock import boundaries, elapsed_text
from ..functions.numbers import default_sample_rows, density_values, or_one, ratio
from ..sources.definitions import Reference

Tables = dict[str, DataFrame]
NAMES = ["database_name", "table_name", "stats_name", "key_column_name"]


def _sorted(df: DataFrame, size: str = "current_number_of_rows") -> DataFrame:
    return df.orderBy(F.desc(size), *NAMES)


def note(cond: Column, text: str | Column, otherwise: str = "OK") -> Column:
    return F.when(cond, F.lit(text) if isinstance(text, str) else text).otherwise(otherwise)


def leading_density(c: Tables) -> DataFrame:
    """Density of the key column alone, one row per statistic."""
    return c["density"].filter("density_number = 1").select("rowid", F.col("all_density").alias("key_column_density"))


def drop_statement() -> Column:
    return F.concat(F.lit("DROP STATISTICS "), F.col("fqn_stats_name"))


def check_unused(c: Tables, pct: int = 100) -> DataFrame:
    """Statistics past their refresh threshold that nothing refreshed: probably no query uses them."""
    a = c["stat"].filter((F.col("percent_of_threshold") >= pct) & F.col("is_auto_update_stats_on")
                         & ~F.col("no_recompute") & (F.col("stats_id") != 1))
    return _sorted(a.select(
        *NAMES, "statistic_type", "current_number_of_rows", "current_number_of_modified_rows_since_last_update",
        "auto_update_threshold", "percent_of_threshold", "last_used",
        elapsed_text(F.col("last_updated"), F.col("as_of")).alias("time_since_last_update"),
        elapsed_text(F.col("last_used"), F.col("as_of")).alias("time_since_last_use"),
    ))


def check_tiny(c: Tables, rows: int = 500, days: int = 7) -> DataFrame:
    a = c["stat"].filter((F.col("number_of_rows_at_time_stat_was_updated") <= rows)
                         & (F.col("current_number_of_modified_rows_since_last_update") >= 1))
    old = boundaries("DAY", F.col("last_updated"), F.col("as_of")) >= days
    return _sorted(a.select(
        *NAMES, "statistic_type", "current_number_of_rows", "number_of_rows_at_time_stat_was_updated",
        "current_number_of_modified_rows_since_last_update", "auto_update_threshold", "auto_update_threshold_type",
        note(old, F.concat(F.lit(f"Warning - Not refreshed for {days} days or more: "), elapsed_text(F.col("last_updated"), F.col("as_of")))).alias("comment"),
    ))


NAME_PATTERNS = ["is%", "%archive%", "%active%", "%flag%", "%status%", "%deleted%", "%D_E_L_E_T_%"]  # fixed values


def check_filter_candidates(c: Tables, few_values: int = 20, rows: int = 1_000_000, few_steps: int = 10) -> DataFrame:
    """Statistics that are filtered or could be: few values, flag-like type or name, few steps."""
    a = c["stat"].join(leading_density(c), "rowid").withColumn("unique_values_on_key_column", density_values(F.col("key_column_density")))
    small = (F.col("unique_values_on_key_column") <= few_values) & (F.col("current_number_of_rows") >= rows)
    flagged = F.col("key_column_data_type").isin("boolean", "tinyint")
    for p in NAME_PATTERNS:
        flagged = flagged | F.col("key_column_name").ilike(p)
    few = F.col("steps") <= few_steps
    a = a.filter(F.col("steps").isNotNull() & (F.col("has_filter") | small | flagged | few))
    return _sorted(a.select(
        *NAMES, "key_column_data_type", "statistic_type", "filter_definition", "current_number_of_rows", "rows_sampled",
        F.col("steps").cast("long").alias("steps"), "unique_values_on_key_column",
        "number_of_rows_at_time_stat_was_updated", "unfiltered_rows",
        note(~F.col("has_filter"), F.concat(
            F.lit("Information - The key column suggests a filtered statistic"),
            F.when(small, f", few values ({few_values} or less) in a large table").otherwise(""))).alias("comment_1"),
        note(few, f"Information - {few_steps} steps or less suggest a filtered statistic").alias("comment_2"),
    ))


def check_filtered_stale(c: Tables, hours: int = 24) -> DataFrame:
    a = c["stat"].filter("has_filter")
    age = boundaries("HOUR", F.col("last_updated"), F.col("as_of"))
    return _sorted(a.select(
        *NAMES, "statistic_type", "filter_definition", "current_number_of_rows", "number_of_rows_at_time_stat_was_updated",
        "unfiltered_rows", "current_number_of_modified_rows_since_last_update", "percent_of_threshold",
        age.alias("hours_since_last_update"),
        note(age > hours, F.concat(F.lit(f"Warning - Last refresh more than {hours} hours ago: "),
                                   elapsed_text(F.col("last_updated"), F.col("as_of")))).alias("comment"),
    ))


def check_partition(c: Tables) -> DataFrame:
    """Partitioned tables whose statistics are not kept per partition."""
    a = c["stat"].filter("is_table_partitioned")
    return _sorted(a.select(
        *NAMES, "statistic_type", "current_number_of_rows", "is_table_partitioned", "is_incremental",
        note(~F.col("is_incremental"), "Warning - The table is partitioned but this statistic is not kept per partition").alias("comment"),
        note(~F.col("is_incremental"), F.concat(F.lit("ANALYZE TABLE "), F.col("table_name"), F.lit(" PARTITION COMPUTE STATISTICS FOR COLUMNS "), F.col("stat_all_columns"))).alias("command"),
    ))


def check_group_flag(c: Tables) -> DataFrame:
    """Per database: does it have partitioned tables, and are their statistics kept per partition?"""
    g = c["stat"].groupBy("database_name").agg(
        F.max("is_table_partitioned").alias("has_partitioned_tables"),
        F.min(F.when(F.col("is_table_partitioned"), F.col("is_incremental"))).alias("all_incremental"),
    )
    return g.select(
        "database_name", "has_partitioned_tables",
        F.when(~F.col("has_partitioned_tables"), "Information - No partitioned tables, the check does not apply")
        .when(~F.col("all_incremental"), "Warning - Partitioned tables with statistics that are not kept per partition")
        .otherwise("OK").alias("comment"),
    ).orderBy("database_name")


def check_small_sample(c: Tables, pct: int = 25) -> DataFrame:
    a = c["stat"].filter("current_number_of_rows > 0")
    return _sorted(a.select(
        *NAMES, "current_number_of_rows", "rows_sampled", "statistic_percent_sampled",
        note(F.coalesce("statistic_percent_sampled", F.lit(0)) < pct, f"Warning - Less than {pct} percent of the rows were sampled").alias("comment"),
    ))


def check_big_tables(c: Tables, large: int = 1_000_000, huge: int = 10_000_000) -> DataFrame:
    """Per database: the largest table and how many tables are large or huge."""
    per_table = c["stat"].groupBy("database_name", "table_name").agg(F.max("current_number_of_rows").alias("rows"))
    n_large, n_huge = F.count(F.when(F.col("rows") >= large, 1)), F.count(F.when(F.col("rows") >= huge, 1))
    return per_table.groupBy("database_name").agg(
        F.max("rows").alias("max_number_of_rows_in_a_table"),
        n_large.alias("number_of_large_tables"), n_huge.alias("number_of_huge_tables"),
        note(n_large > 0, F.concat(F.lit("Warning - "), n_large.cast("string"), F.lit(f" tables with {large} rows or more"))).alias("comment_large"),
        note(n_huge > 0, F.concat(F.lit("Warning - "), n_huge.cast("string"), F.lit(f" tables with {huge} rows or more"))).alias("comment_huge"),
    ).orderBy("database_name")


def check_pinned(c: Tables) -> DataFrame:
    a = c["stat"].filter("current_number_of_rows > 0 AND no_recompute")
    return _sorted(a.select(
        *NAMES, "current_number_of_rows", "rows_sampled", "current_number_of_modified_rows_since_last_update", "no_recompute",
        note(F.col("no_recompute"), "Warning - Automatic refresh is off for this statistic, it needs its own schedule").alias("comment"),
    ))


def check_wide_keys(c: Tables) -> DataFrame:
    a = c["stat"].filter("current_number_of_rows > 0 AND is_lob")
    mb = lambda p: ratio(F.col(p) * 8, F.lit(1024), 2)
    return a.select(
        *NAMES, "key_column_data_type", "current_number_of_rows", "number_of_in_row_data_pages_on_table",
        mb("number_of_in_row_data_pages_on_table").alias("in_row_data_size_in_mb"),
        "number_of_lob_data_pages_on_table", mb("number_of_lob_data_pages_on_table").alias("lob_data_size_in_mb"),
        "rows_sampled", "statistic_percent_sampled",
        note(F.col("is_lob"), "Warning - The key column holds large values, building this statistic takes long").alias("comment"),
    ).orderBy(F.desc("number_of_in_row_data_pages_on_table"), *NAMES)


def check_too_many(c: Tables, more_than: int = 5) -> DataFrame:
    a = c["stat"].filter("current_number_of_rows > 0")
    n, cols = F.col("number_of_statistics_in_this_table"), F.col("number_of_columns_in_this_table")
    return a.select(
        *NAMES, "statistic_type", "current_number_of_rows", n.cast("long").alias("number_of_statistics_in_this_table"),
        cols.cast("long").alias("number_of_columns_in_this_table"),
        note((n > more_than) & (n >= cols), F.concat(F.lit("Warning - At least as many statistics as columns ("), cols.cast("string"), F.lit(")"))).alias("comment"),
    ).orderBy(F.desc("number_of_statistics_in_this_table"), *NAMES)


def check_duplicate(c: Tables) -> DataFrame:
    """Automatic or user statistics whose columns begin an index statistic of the same table with the same filter."""
    a = c["stat"].filter("current_number_of_rows > 0")
    b = c["stat"].filter("statistic_type = 'Index_Statistic'").select(
        F.col("database_name").alias("b_db"), F.col("table_name").alias("b_table"), F.col("rowid").alias("b_rowid"),
        F.col("stat_columns").alias("b_columns"), F.col("filter_definition").alias("b_filter"))
    prefix = F.expr("slice(b_columns, 1, size(stat_columns)) = stat_columns")
    dup = a.filter(F.col("statistic_type") != "Index_Statistic").join(
        b, (F.col("database_name") == F.col("b_db")) & (F.col("table_name") == F.col("b_table"))
        & F.col("filter_definition").eqNullSafe(F.col("b_filter")) & (F.col("rowid") != F.col("b_rowid")) & prefix,
        "left_semi").select("rowid", F.lit(True).alias("duplicated"))
    return _sorted(a.join(dup, "rowid", "left").select(
        *NAMES, "stat_all_columns", "statistic_type", "filter_definition", "current_number_of_rows", "rows_sampled",
        note(F.col("duplicated"), F.concat(F.lit("Warning - An index statistic already covers ["), F.col("stat_all_columns"), F.lit("]"))).alias("comment"),
        drop_statement().alias("drop_stat_command"),
    ))


def check_large(c: Tables, rows: int = 1_000_000, warn: int = 10_000_000) -> DataFrame:
    a = c["stat"].join(leading_density(c), "rowid").filter(F.col("current_number_of_rows") >= rows)
    uniq = density_values(F.col("key_column_density"))
    return _sorted(a.select(
        *NAMES, "statistic_type", "current_number_of_rows", "rows_sampled", "statistic_percent_sampled",
        "key_column_density", uniq.alias("unique_values"),
        note(F.col("current_number_of_rows") > warn, F.concat(
            F.lit("Warning - Large table with "), uniq.cast("string"), F.lit(" unique values in ["), F.col("key_column_name"), F.lit("]"))).alias("comment"),
    ))


def check_stale(c: Tables, hours: int = 24) -> DataFrame:
    age = boundaries("HOUR", F.col("last_updated"), F.col("as_of"))
    mods, rows = F.col("current_number_of_modified_rows_since_last_update"), F.col("number_of_rows_at_time_stat_was_updated")
    pct = ratio(F.coalesce(mods, F.lit(0)), or_one(rows), 2, 100)
    return _sorted(c["stat"].select(
        *NAMES, "statistic_type", "last_updated", age.alias("hours_since_last_update"),
        note(age > hours, F.concat(F.lit(f"Warning - Last refresh more than {hours} hours ago: "),
                                   elapsed_text(F.col("last_updated"), F.col("as_of")))).alias("comment_1"),
        note(F.coalesce(mods, F.lit(0)) > 0, F.concat(
            mods.cast("string"), F.lit(" modifications since the last refresh"))).alias("comment_2"),
        "last_used", "current_number_of_rows", rows, mods, pct.alias("percent_modifications"),
        (F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups")).alias("number_of_reads"), "user_updates",
        "percent_of_threshold",
    ))


def check_empty_histogram(c: Tables) -> DataFrame:
    a = c["stat"].filter((F.col("current_number_of_rows") > 0) & (F.coalesce("steps", F.lit(0)) == 0))
    return a.select(
        *NAMES, "statistic_type", "is_unique", "no_recompute", "filter_definition", "current_number_of_rows", "rows_sampled",
        note(F.col("steps").isNull() & (F.col("current_number_of_rows") > 0), "Warning - Rows exist but the statistic has no histogram").alias("comment"),
        drop_statement().alias("drop_stat_command"),
    ).orderBy(*NAMES)


def check_persisted(c: Tables) -> DataFrame:
    full = F.col("statistic_percent_sampled") == 100
    auto = F.col("is_auto_update_stats_on")
    p = F.col("persisted_sample_percent")
    analyze = F.concat(F.lit("ANALYZE TABLE "), F.col("table_name"), F.lit(" COMPUTE STATISTICS FOR COLUMNS "), F.col("stat_all_columns"))
    a = c["stat"].drop("persisted_sample_percent").join(c["stat_header"].select("rowid", "persisted_sample_percent"), "rowid")
    return _sorted(a.select(
        *NAMES, "statistic_type", "current_number_of_rows", "rows_sampled", "statistic_percent_sampled",
        p.cast("long").alias("persisted_sample_percent"),
        F.when(full & auto & (p == 0), "Warning - Full scan without a persisted sample, an automatic refresh falls back to the default sample")
        .when(full & auto & (p > 0), "Warning - Full scan with a persisted sample, an automatic refresh reads the whole table")
        .when(p > 0, "Information - A persisted sample is in use, check that its size is as wanted")
        .otherwise("OK").alias("comment"),
        F.when(p == 0, F.concat(analyze, F.lit(" -- persist the sample: on"))).alias("command_to_enable"),
        F.when(p > 0, F.concat(analyze, F.lit(" -- persist the sample: off"))).alias("command_to_disable"),
    ))


def check_leftover(c: Tables, pattern: str = "%\\_dta\\_stat%") -> DataFrame:
    """Statistics left behind by a tuning tool, told by name; without steps they are only hypothetical."""
    a = c["stat"].filter(F.col("stats_name").like(pattern) & (F.col("statistic_type") != "Index_Statistic"))
    return a.select(
        *NAMES, "stat_all_columns", "statistic_type", F.col("steps").cast("long").alias("steps"), "current_number_of_rows",
        F.when(F.col("steps").isNull(), "Warning - Hypothetical statistic left behind by a tuning tool")
        .otherwise("Warning - Statistic made by a tuning tool, check that it is of use").alias("comment"),
        drop_statement().alias("drop_stat_command"),
    ).orderBy("comment", F.desc("current_number_of_rows"), *NAMES)


REFERENCE_SCHEMA = ("constraint_name string, database_name string, table_name string, columns array<string>, "
                    "ref_table string, ref_columns array<string>")


def reference_frame(spark: SparkSession, refs: Sequence[Reference]) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.database, r.table, list(r.columns), r.ref_table, list(r.ref_columns)) for r in refs], REFERENCE_SCHEMA)


def check_missing_multicol(c: Tables, references: DataFrame) -> DataFrame:
    """References over several columns without a statistic on exactly those columns."""
    multi = references.filter(F.size("columns") > 1)
    missing = multi.join(
        c["stat"].select("database_name", "table_name", F.col("stat_columns").alias("columns")).distinct(),
        ["database_name", "table_name", "columns"], "left_anti")
    cols = F.array_join("columns", ",")
    rows = missing.select(
        F.lit("Warning - No statistic on the columns of this reference").alias("comment"),
        "database_name", "constraint_name", "table_name", cols.alias("parent_columns"),
        F.col("ref_table").alias("referenced_table"), F.array_join("ref_columns", ",").alias("referenced_columns"),
        F.concat(F.lit("CREATE STATISTICS Stats_"), F.replace("constraint_name", F.lit(" "), F.lit("_")), F.lit(" ON "),
                 F.col("database_name"), F.lit("."), F.col("table_name"), F.lit(" ("), cols, F.lit(")")).alias("create_stat_command"),
    )
    none = references.sparkSession.range(1).join(missing.agg(F.count(F.lit(1)).alias("n")), F.col("n") == 0).select(F.lit("OK").alias("comment"))
    return rows.unionByName(none, allowMissingColumns=True).orderBy("database_name", "table_name", "referenced_table")


def check_auto_multicol(c: Tables) -> DataFrame:
    a = c["stat"].filter((F.col("current_number_of_rows") > 0) & (F.col("statistic_type") == "Auto_Created") & (F.size("stat_columns") > 1))
    return _sorted(a.select(
        *NAMES, "statistic_type", "stat_all_columns", "current_number_of_rows", "rows_sampled",
        F.col("number_of_statistics_in_this_table").cast("long").alias("number_of_statistics_in_this_table"),
        F.lit("Warning - Automatic statistic over several columns, check that it is needed").alias("comment"),
        drop_statement().alias("drop_stat_command"),
    ))


def check_sample_rate(c: Tables) -> DataFrame:
    """Sample an automatic refresh would take of each table."""
    a = c["stat"].filter("current_number_of_rows > 0 AND number_of_in_row_data_pages_on_table > 0").select(
        "database_name", "table_name", "stats_name", "current_number_of_rows",
        "current_number_of_modified_rows_since_last_update", "auto_update_threshold", "auto_update_threshold_type",
        "percent_of_threshold", "number_of_in_row_data_pages_on_table", "number_of_lob_data_pages_on_table").distinct()
    rows, pages = F.col("current_number_of_rows"), F.col("number_of_in_row_data_pages_on_table")
    sample_rows = default_sample_rows(rows)
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  (products of rows and pages pass the range of a long)
    sample_pages = F.least(pages, F.call_function("div", wide(pages) * sample_rows, rows) + 1024)
    mb = lambda p: ratio(F.col(p) * 8, F.lit(1024), 2)
    return a.select(
        "*", sample_rows.alias("sample_rows"), sample_pages.alias("sample_pages"),
        ratio(wide(rows) * sample_pages, pages, 0).cast("long").alias("auto_update_rows_sample"),
        ratio(sample_pages, pages, 6, 100).alias("auto_update_percent_sample"),
        ratio(rows, pages, 4).alias("rows_per_page"),
        mb("number_of_in_row_data_pages_on_table").alias("in_row_data_size_in_mb"),
        mb("number_of_lob_data_pages_on_table").alias("lob_data_size_in_mb"),
    ).orderBy(F.desc(F.col("number_of_in_row_data_pages_on_table") + F.col("number_of_lob_data_pages_on_table")),
              "database_name", "table_name", "stats_name")


def check_order_mismatch(c: Tables) -> DataFrame:
    a = c["stat"].filter(F.col("stat_columns") != F.col("stored_columns"))
    return a.select(
        *NAMES, F.array_join("stat_columns", ",").alias("key_order"), F.array_join("stored_columns", ",").alias("stored_order"),
        F.lit("Information - Key order and stored order of the columns differ").alias("comment"),
    ).orderBy(*NAMES)


def check_bad_leading(c: Tables, values: int = 200, rows: int = 100) -> DataFrame:
    a = c["stat"].join(leading_density(c), "rowid").filter((F.size("stat_columns") > 1) & (F.col("current_number_of_rows") >= rows))
    uniq = density_values(F.col("key_column_density"))
    return a.select(
        *NAMES, "stat_all_columns", "key_column_density", uniq.alias("unique_values_on_key_column"), "current_number_of_rows",
        note(uniq <= values, "Warning - The first column has few unique values, put a more selective column first").alias("comment"),
    ).orderBy("unique_values_on_key_column", "current_number_of_rows", *NAMES)
