"""Registered queries of the catalogue checks, with their DuckDB counterparts."""

from __future__ import annotations

from ..operators import checks_catalogue as k
from .fixture import REFERENCES, collected
from .oracle_base import elapsed, q, ratio, with_collected

ROWS_LARGE, ROWS_HUGE = 10_000, 50_000  # the test tables are small
USED_UP = 50


def _on(check, **params):
    return lambda spark, sf: check(collected(spark, sf), **params)


QUERIES = {
    "chk05_unused": _on(k.check_unused, pct=USED_UP),
    "chk08_tiny": _on(k.check_tiny),
    "chk14_filter_candidates": _on(k.check_filter_candidates, rows=ROWS_LARGE),
    "chk16_filtered_stale": _on(k.check_filtered_stale),
    "chk20_partition": _on(k.check_partition),
    "chk19_group_flag": _on(k.check_group_flag),
    "chk23_small_sample": _on(k.check_small_sample),
    "chk24_big_tables": _on(k.check_big_tables, large=ROWS_LARGE, huge=ROWS_HUGE),
    "chk25_pinned": _on(k.check_pinned),
    "chk26_wide_keys": _on(k.check_wide_keys),
    "chk27_too_many": _on(k.check_too_many),
    "chk28_duplicate": _on(k.check_duplicate),
    "chk29_large": _on(k.check_large, rows=ROWS_LARGE, warn=ROWS_HUGE),
    "chk30_stale": _on(k.check_stale),
    "chk31_empty_hist": _on(k.check_empty_histogram),
    "chk33_persisted": _on(k.check_persisted),
    "chk35_leftover": _on(k.check_leftover),
    "chk40_missing_multicol": lambda spark, sf: k.check_missing_multicol(collected(spark, sf), k.reference_frame(spark, REFERENCES)),
    "chk41_auto_multicol": _on(k.check_auto_multicol),
    "chk42_sample_rate": _on(k.check_sample_rate),
    "chk46_order_mismatch": _on(k.check_order_mismatch),
    "chk50_bad_leading": _on(k.check_bad_leading),
}

N = "database_name, table_name, stats_name, key_column_name"
AGE = "date_diff('hour', last_updated, as_of)"
UNIQ = "CAST(round(CAST(1.0 AS DOUBLE) / key_column_density, 6) AS BIGINT)"
LEAD = "stat JOIN (SELECT rowid, all_density AS key_column_density FROM dens WHERE density_number = 1) ld USING (rowid)"
DROP = "'DROP STATISTICS ' || fqn_stats_name AS drop_stat_command"
ANALYZE = "'ANALYZE TABLE ' || table_name || ' COMPUTE STATISTICS FOR COLUMNS ' || stat_all_columns"
_refs = ", ".join("(" + ", ".join([q(r.name), q(r.database), q(r.table), q(",".join(r.columns)), q(r.ref_table), q(",".join(r.ref_columns)), q(len(r.columns))]) + ")" for r in REFERENCES)
_srows = "CAST(ceil(round(15.0 * pow(CAST(current_number_of_rows AS DOUBLE), 0.55), 6)) AS BIGINT)"
_spages = f"least(number_of_in_row_data_pages_on_table, number_of_in_row_data_pages_on_table * {_srows} // current_number_of_rows + 1024)"

ORACLES = {k_: with_collected(v) for k_, v in {
    "chk05_unused": f"""SELECT {N}, statistic_type, current_number_of_rows, current_number_of_modified_rows_since_last_update,
      auto_update_threshold, percent_of_threshold, last_used, {elapsed('last_updated', 'as_of')} AS time_since_last_update,
      {elapsed('last_used', 'as_of')} AS time_since_last_use
      FROM stat WHERE percent_of_threshold >= {USED_UP} AND is_auto_update_stats_on AND NOT no_recompute AND stats_id <> 1""",
    "chk08_tiny": f"""SELECT {N}, statistic_type, current_number_of_rows, number_of_rows_at_time_stat_was_updated,
      current_number_of_modified_rows_since_last_update, auto_update_threshold, auto_update_threshold_type,
      CASE WHEN date_diff('day', last_updated, as_of) >= 7 THEN 'Warning - Not refreshed for 7 days or more: ' || {elapsed('last_updated', 'as_of')} ELSE 'OK' END AS comment
      FROM stat WHERE number_of_rows_at_time_stat_was_updated <= 500 AND current_number_of_modified_rows_since_last_update >= 1""",
    "chk14_filter_candidates": f"""SELECT {N}, key_column_data_type, statistic_type, filter_definition, current_number_of_rows, rows_sampled, steps,
      unique_values_on_key_column, number_of_rows_at_time_stat_was_updated, unfiltered_rows,
      CASE WHEN NOT has_filter THEN 'Information - The key column suggests a filtered statistic' || CASE WHEN small THEN ', few values (20 or less) in a large table' ELSE '' END ELSE 'OK' END AS comment_1,
      CASE WHEN steps <= 10 THEN 'Information - 10 steps or less suggest a filtered statistic' ELSE 'OK' END AS comment_2
      FROM (SELECT *, {UNIQ} AS unique_values_on_key_column, {UNIQ} <= 20 AND current_number_of_rows >= {ROWS_LARGE} AS small FROM {LEAD})
      WHERE steps IS NOT NULL AND (has_filter OR small OR key_column_data_type IN ('boolean', 'tinyint') OR key_column_name ILIKE 'is%'
        OR key_column_name ILIKE '%archive%' OR key_column_name ILIKE '%active%' OR key_column_name ILIKE '%flag%'
        OR key_column_name ILIKE '%status%' OR key_column_name ILIKE '%deleted%' OR key_column_name ILIKE '%D_E_L_E_T_%' OR steps <= 10)""",
    "chk16_filtered_stale": f"""SELECT {N}, statistic_type, filter_definition, current_number_of_rows, number_of_rows_at_time_stat_was_updated,
      unfiltered_rows, current_number_of_modified_rows_since_last_update, percent_of_threshold, {AGE} AS hours_since_last_update,
      CASE WHEN {AGE} > 24 THEN 'Warning - Last refresh more than 24 hours ago: ' || {elapsed('last_updated', 'as_of')} ELSE 'OK' END AS comment
      FROM stat WHERE has_filter""",
    "chk20_partition": f"""SELECT {N}, statistic_type, current_number_of_rows, is_table_partitioned, is_incremental,
      CASE WHEN NOT is_incremental THEN 'Warning - The table is partitioned but this statistic is not kept per partition' ELSE 'OK' END AS comment,
      CASE WHEN NOT is_incremental THEN 'ANALYZE TABLE ' || table_name || ' PARTITION COMPUTE STATISTICS FOR COLUMNS ' || stat_all_columns ELSE 'OK' END AS command
      FROM stat WHERE is_table_partitioned""",
    "chk19_group_flag": """SELECT database_name, bool_or(is_table_partitioned) AS has_partitioned_tables,
      CASE WHEN NOT bool_or(is_table_partitioned) THEN 'Information - No partitioned tables, the check does not apply'
        WHEN bool_or(is_table_partitioned AND NOT is_incremental) THEN 'Warning - Partitioned tables with statistics that are not kept per partition' ELSE 'OK' END AS comment
      FROM stat GROUP BY database_name""",
    "chk23_small_sample": f"""SELECT {N}, current_number_of_rows, rows_sampled, statistic_percent_sampled,
      CASE WHEN coalesce(statistic_percent_sampled, 0) < 25 THEN 'Warning - Less than 25 percent of the rows were sampled' ELSE 'OK' END AS comment
      FROM stat WHERE current_number_of_rows > 0""",
    "chk24_big_tables": f"""SELECT database_name, max(r) AS max_number_of_rows_in_a_table, count(*) FILTER (WHERE r >= {ROWS_LARGE}) AS number_of_large_tables,
      count(*) FILTER (WHERE r >= {ROWS_HUGE}) AS number_of_huge_tables,
      CASE WHEN max(r) >= {ROWS_LARGE} THEN 'Warning - ' || count(*) FILTER (WHERE r >= {ROWS_LARGE}) || ' tables with {ROWS_LARGE} rows or more' ELSE 'OK' END AS comment_large,
      CASE WHEN max(r) >= {ROWS_HUGE} THEN 'Warning - ' || count(*) FILTER (WHERE r >= {ROWS_HUGE}) || ' tables with {ROWS_HUGE} rows or more' ELSE 'OK' END AS comment_huge
      FROM (SELECT DISTINCT database_name, table_name, current_number_of_rows AS r FROM stat) GROUP BY database_name""",
    "chk25_pinned": f"""SELECT {N}, current_number_of_rows, rows_sampled, current_number_of_modified_rows_since_last_update, no_recompute,
      'Warning - Automatic refresh is off for this statistic, it needs its own schedule' AS comment FROM stat WHERE no_recompute AND current_number_of_rows > 0""",
    "chk26_wide_keys": f"""SELECT {N}, key_column_data_type, current_number_of_rows, number_of_in_row_data_pages_on_table,
      {ratio('number_of_in_row_data_pages_on_table * 8', '1024', 2)} AS in_row_data_size_in_mb, number_of_lob_data_pages_on_table,
      {ratio('number_of_lob_data_pages_on_table * 8', '1024', 2)} AS lob_data_size_in_mb, rows_sampled, statistic_percent_sampled,
      'Warning - The key column holds large values, building this statistic takes long' AS comment FROM stat WHERE is_lob AND current_number_of_rows > 0""",
    "chk27_too_many": f"""SELECT {N}, statistic_type, current_number_of_rows, number_of_statistics_in_this_table, CAST(number_of_columns_in_this_table AS BIGINT) AS number_of_columns_in_this_table,
      CASE WHEN number_of_statistics_in_this_table > 5 AND number_of_statistics_in_this_table >= number_of_columns_in_this_table
        THEN 'Warning - At least as many statistics as columns (' || number_of_columns_in_this_table || ')' ELSE 'OK' END AS comment FROM stat WHERE current_number_of_rows > 0""",
    "chk28_duplicate": f"""SELECT {N}, stat_all_columns, statistic_type, filter_definition, current_number_of_rows, rows_sampled,
      CASE WHEN statistic_type <> 'Index_Statistic' AND EXISTS (SELECT 1 FROM stat b WHERE b.database_name = a.database_name AND b.table_name = a.table_name
        AND b.statistic_type = 'Index_Statistic' AND b.rowid <> a.rowid AND b.filter_definition IS NOT DISTINCT FROM a.filter_definition
        AND (b.stat_all_columns || ',') LIKE (replace(a.stat_all_columns, '_', '\\_') || ',%') ESCAPE '\\')
        THEN 'Warning - An index statistic already covers [' || stat_all_columns || ']' ELSE 'OK' END AS comment, {DROP}
      FROM stat a WHERE current_number_of_rows > 0""",
    "chk29_large": f"""SELECT {N}, statistic_type, current_number_of_rows, rows_sampled, statistic_percent_sampled, key_column_density, {UNIQ} AS unique_values,
      CASE WHEN current_number_of_rows > {ROWS_HUGE} THEN 'Warning - Large table with ' || {UNIQ} || ' unique values in [' || key_column_name || ']' ELSE 'OK' END AS comment
      FROM {LEAD} WHERE current_number_of_rows >= {ROWS_LARGE}""",
    "chk30_stale": f"""SELECT {N}, statistic_type, last_updated, {AGE} AS hours_since_last_update,
      CASE WHEN {AGE} > 24 THEN 'Warning - Last refresh more than 24 hours ago: ' || {elapsed('last_updated', 'as_of')} ELSE 'OK' END AS comment_1,
      CASE WHEN current_number_of_modified_rows_since_last_update > 0 THEN current_number_of_modified_rows_since_last_update || ' modifications since the last refresh' ELSE 'OK' END AS comment_2,
      last_used, current_number_of_rows, number_of_rows_at_time_stat_was_updated, current_number_of_modified_rows_since_last_update,
      {ratio('current_number_of_modified_rows_since_last_update', 'number_of_rows_at_time_stat_was_updated', 2, 100)} AS percent_modifications,
      user_seeks + user_scans + user_lookups AS number_of_reads, user_updates, percent_of_threshold FROM stat""",
    "chk31_empty_hist": f"""SELECT {N}, statistic_type, is_unique, no_recompute, filter_definition, current_number_of_rows, rows_sampled,
      'Warning - Rows exist but the statistic has no histogram' AS comment, {DROP} FROM stat WHERE current_number_of_rows > 0 AND coalesce(steps, 0) = 0""",
    "chk33_persisted": f"""SELECT {N}, statistic_type, current_number_of_rows, rows_sampled, statistic_percent_sampled, CAST(persisted_sample_percent AS BIGINT) AS persisted_sample_percent,
      CASE WHEN statistic_percent_sampled = 100 AND is_auto_update_stats_on AND persisted_sample_percent = 0 THEN 'Warning - Full scan without a persisted sample, an automatic refresh falls back to the default sample'
        WHEN statistic_percent_sampled = 100 AND is_auto_update_stats_on AND persisted_sample_percent > 0 THEN 'Warning - Full scan with a persisted sample, an automatic refresh reads the whole table'
        WHEN persisted_sample_percent > 0 THEN 'Information - A persisted sample is in use, check that its size is as wanted' ELSE 'OK' END AS comment,
      CASE WHEN persisted_sample_percent = 0 THEN {ANALYZE} || ' -- persist the sample: on' END AS command_to_enable,
      CASE WHEN persisted_sample_percent > 0 THEN {ANALYZE} || ' -- persist the sample: off' END AS command_to_disable FROM stat""",
    "chk35_leftover": f"""SELECT {N}, stat_all_columns, statistic_type, steps, current_number_of_rows,
      CASE WHEN steps IS NULL THEN 'Warning - Hypothetical statistic left behind by a tuning tool' ELSE 'Warning - Statistic made by a tuning tool, check that it is of use' END AS comment, {DROP}
      FROM stat WHERE contains(stats_name, '_dta_stat') AND statistic_type <> 'Index_Statistic'""",
    "chk40_missing_multicol": f"""SELECT 'Warning - No statistic on the columns of this reference' AS comment, database_name, constraint_name, table_name, parent_columns,
      referenced_table, referenced_columns, 'CREATE STATISTICS Stats_' || replace(constraint_name, ' ', '_') || ' ON ' || database_name || '.' || table_name || ' (' || parent_columns || ')' AS create_stat_command
      FROM (VALUES {_refs}) r(constraint_name, database_name, table_name, parent_columns, referenced_table, referenced_columns, n)
      WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM stat s WHERE s.database_name = r.database_name AND s.table_name = r.table_name AND s.stat_all_columns = r.parent_columns)""",
    "chk41_auto_multicol": f"""SELECT {N}, statistic_type, stat_all_columns, current_number_of_rows, rows_sampled, number_of_statistics_in_this_table,
      'Warning - Automatic statistic over several columns, check that it is needed' AS comment, {DROP}
      FROM stat WHERE current_number_of_rows > 0 AND statistic_type = 'Auto_Created' AND n_columns > 1""",
    "chk42_sample_rate": f"""SELECT DISTINCT database_name, table_name, stats_name, current_number_of_rows, current_number_of_modified_rows_since_last_update, auto_update_threshold,
      auto_update_threshold_type, percent_of_threshold, number_of_in_row_data_pages_on_table, number_of_lob_data_pages_on_table, {_srows} AS sample_rows, {_spages} AS sample_pages,
      CAST({ratio(f'current_number_of_rows * {_spages}', 'number_of_in_row_data_pages_on_table', 0)} AS BIGINT) AS auto_update_rows_sample,
      {ratio(_spages, 'number_of_in_row_data_pages_on_table', 6, 100)} AS auto_update_percent_sample,
      {ratio('current_number_of_rows', 'number_of_in_row_data_pages_on_table', 4)} AS rows_per_page,
      {ratio('number_of_in_row_data_pages_on_table * 8', '1024', 2)} AS in_row_data_size_in_mb, {ratio('number_of_lob_data_pages_on_table * 8', '1024', 2)} AS lob_data_size_in_mb
      FROM stat WHERE current_number_of_rows > 0 AND number_of_in_row_data_pages_on_table > 0""",
    "chk46_order_mismatch": f"""SELECT {N}, stat_all_columns AS key_order, stored_order, 'Information - Key order and stored order of the columns differ' AS comment
      FROM stat WHERE stat_all_columns <> stored_order""",
    "chk50_bad_leading": f"""SELECT {N}, stat_all_columns, key_column_density, {UNIQ} AS unique_values_on_key_column, current_number_of_rows,
      CASE WHEN {UNIQ} <= 200 THEN 'Warning - The first column has few unique values, put a more selective column first' ELSE 'OK' END AS comment
      FROM {LEAD} WHERE n_columns > 1 AND current_number_of_rows >= 100""",
}.items()}
