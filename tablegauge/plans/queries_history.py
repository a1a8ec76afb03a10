"""Registered queries of the history checks, with their DuckDB counterparts."""

from __future__ import annotations

from ..operators import checks_history as k
from .fixture import collected
from .oracle_base import elapsed, mtext, ratio, with_collected
from .queries_catalogue import LEAD, N, UNIQ


def _on(check, **params):
    return lambda spark, sf: check(collected(spark, sf), **params)


QUERIES = {
    "chk01_history": _on(k.check_history),
    "chk02_cadence": _on(k.check_cadence),
    "chk06_mod_rate": _on(k.check_modification_rate),
    "chk07_threshold": _on(k.check_threshold),
    "chk10_ascending": _on(k.check_ascending),
    "chk11_hidden_ascending": _on(k.check_hidden_ascending),
    "chk12_hidden_ascending_list": _on(k.check_hidden_ascending_list),
    "chk34_steps_changed": _on(k.check_steps_changed),
}

HW = """hw AS (SELECT rowid, count(*) AS n_hist, """ + ", ".join(
    f"max({c}) FILTER (WHERE history_number = {n}) AS {a}{n}" for c, a, ns in [
        ("updated", "u", (1, 2, 3, 4)), ("mods", "m", (1, 2, 3)), ("table_cardinality", "c", (1, 2)), ("steps", "st", (1, 2)),
        ("leading_column_type", "lt", (1,)), ("rows_above", "ra", (1,)), ("rows_below", "rb", (1,)),
        ("inserts_since_last_update", "i", (1,)), ("deletes_since_last_update", "d", (1,))] for n in ns) + " FROM history GROUP BY rowid)"
CAD = """cad AS (SELECT *, CASE WHEN tm IS NOT NULL THEN """ + ratio("tmod", "CASE WHEN tm = 0 THEN 1 ELSE tm END", 2) + """ END AS rate FROM (
  SELECT *, CASE WHEN coalesce(g1, g2, g3) IS NOT NULL THEN coalesce(g1, 0) + coalesce(g2, 0) + coalesce(g3, 0) END AS tm,
    (coalesce(g1, 0) + coalesce(g2, 0) + coalesce(g3, 0)) // nullif((CASE WHEN g1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN g2 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN g3 IS NULL THEN 0 ELSE 1 END), 0) AS am,
    CASE WHEN coalesce(m1, m2, m3) IS NOT NULL THEN coalesce(m1, 0) + coalesce(m2, 0) + coalesce(m3, 0) END AS tmod
  FROM (SELECT *, date_diff('minute', u2, u1) AS g1, date_diff('minute', u3, u2) AS g2, date_diff('minute', u4, u3) AS g3 FROM stat JOIN hw USING (rowid))))"""
UPD = ", ".join(f"u{n} AS update_stat_{n}_datetime" for n in (1, 2, 3, 4))
MODS = ", ".join(f"m{n} AS modifications_before_update_{n}" for n in (1, 2, 3))
MOD = "current_number_of_modified_rows_since_last_update"
R100 = "CAST(round(rate * 100) AS BIGINT)"
SINCE = "(CASE WHEN date_diff('minute', last_updated, as_of) = 0 THEN 1 ELSE date_diff('minute', last_updated, as_of) END)"
READS = "user_seeks + user_scans + user_lookups"
HID = "stat JOIN history USING (rowid) WHERE history_number = 1 AND leading_column_type IN ('Unknown', 'Stationary') AND rows_above > 0 AND rows_below = 0 AND current_number_of_rows > 1000"
_now = f"({MOD} // {SINCE})"
_eff100 = f"(CASE WHEN rate IS NOT NULL THEN {R100} ELSE {_now} * 100 END)"

ORACLES = {
    "chk01_history": with_collected(f"""SELECT {N}, stat_all_columns, statistic_type, lt1 AS leading_column_type, current_number_of_rows, {MOD}, percent_of_threshold, rows_sampled,
      statistic_percent_sampled, date_diff('hour', last_updated, as_of) AS hours_since_last_update, {elapsed('last_updated', 'as_of')} AS time_since_last_update, {UPD},
      {UNIQ} AS unique_values, CAST(floor(key_column_density * current_number_of_rows) AS BIGINT) AS rows_per_value, {READS} AS number_of_reads,
      {ratio('wait_ms', 'wait_count', 2)} AS avg_wait_in_ms, last_used, n_hist AS number_of_statistic_data_available,
      CASE WHEN n_hist < 4 THEN 'Warning - Fewer than 4 refreshes are known, other checks see little' ELSE 'OK' END AS comment_1,
      CASE WHEN regexp_matches(lower(table_name), 'bkp|test|backup|temp') THEN 'Warning - The table name looks like a copy that is not in use' ELSE 'OK' END AS comment_2
      FROM {LEAD} JOIN hw USING (rowid) WHERE current_number_of_rows > 0""", HW),
    "chk02_cadence": with_collected(f"""SELECT {N}, current_number_of_rows, auto_update_threshold_type, auto_update_threshold, {MOD}, percent_of_threshold,
      'Refreshed every ' || {mtext('am')} AS info_0,
      'At this rate the threshold is reached every ' || (auto_update_threshold * 100 // (CASE WHEN {R100} = 0 THEN 100 ELSE {R100} END)) || ' minutes' AS info_1,
      {UPD}, {MODS}, g1 AS minutes_between_1_and_2, g2 AS minutes_between_2_and_3, g3 AS minutes_between_3_and_4, am AS avg_minutes_between_updates, rate AS modifications_per_minute,
      CASE WHEN m1 = 0 OR m2 = 0 OR m3 = 0 THEN 'Warning - A refresh happened without any modification' ELSE 'OK' END AS comment_1,
      CASE WHEN g1 <= 15 OR g2 <= 15 OR g3 <= 15 THEN 'Warning - Two refreshes lie 15 minutes or less apart' ELSE 'OK' END AS comment_2,
      CASE WHEN g1 >= 1500 OR g2 >= 1500 OR g3 >= 1500 THEN 'Warning - Two refreshes lie 1500 minutes or more apart' ELSE 'OK' END AS comment_3,
      CASE WHEN am <= 60 THEN 'Warning - Refreshed every 60 minutes or more often on average' ELSE 'OK' END AS comment_4
      FROM cad WHERE current_number_of_rows > 0""", HW, CAD),
    "chk06_mod_rate": with_collected(f"""SELECT {N}, n_hist AS number_of_statistic_data_available, last_updated, current_number_of_rows, number_of_rows_at_time_stat_was_updated,
      unfiltered_rows, {MOD}, last_used, rate AS modifications_per_minute, round(avg(rate) OVER (), 2) AS avg_of_all,
      CASE WHEN rate >= avg(rate) OVER () THEN 'Warning - Changes faster than the average of all statistics' ELSE 'OK' END AS comment,
      {MOD} // {SINCE} AS modifications_per_minute_since_update, {READS} AS number_of_reads, ({READS}) // 43200 AS reads_per_minute,
      user_updates, user_updates // 43200 AS updates_per_minute, wait_count FROM cad WHERE current_number_of_rows > 100""", HW, CAD),
    "chk07_threshold": with_collected(f"""SELECT * EXCLUDE (on_), CASE WHEN on_ AND percent_of_threshold >= 100 THEN 'Warning - The next query refreshes this statistic'
        WHEN on_ AND minutes_until_next_update <= 120 THEN 'Warning - The threshold is reached within 120 minutes'
        WHEN NOT on_ AND minutes_until_next_update <= 0 THEN 'Warning - The threshold is reached but automatic refresh is off' ELSE 'OK' END AS comment_1
      FROM (SELECT {N}, last_updated, last_used, current_number_of_rows, number_of_rows_at_time_stat_was_updated, unfiltered_rows, filter_definition, {MOD}, auto_update_threshold,
      auto_update_threshold_type, percent_of_threshold, is_auto_update_stats_on AS on_,
      CASE WHEN rate > 0 THEN as_of + CAST((auto_update_threshold - {MOD}) * 100 // {R100} AS INTEGER) * INTERVAL 1 MINUTE END AS estimated_next_update,
      CASE WHEN {_eff100} > 0 THEN (auto_update_threshold - {MOD}) * 100 // {_eff100} END AS minutes_until_next_update, {MODS},
      tm AS total_minutes_between_updates, tmod AS total_modifications_between_updates, rate AS modifications_per_minute, {_now} AS modifications_per_minute_since_update
      FROM cad WHERE current_number_of_rows > 0)""", HW, CAD),
    "chk10_ascending": with_collected(f"""SELECT {N}, statistic_type, last_updated, filter_definition, current_number_of_rows, {MOD}, rows_above AS number_of_rows_inserted_above,
      rows_below AS number_of_rows_inserted_below, leading_column_type, 'Warning - ' || leading_column_type || ' key, the newest values lie outside the histogram' AS comment, last_used
      FROM stat JOIN history USING (rowid) WHERE history_number = 1 AND leading_column_type IN ('Ascending', 'Descending') AND current_number_of_rows > 0"""),
    "chk11_hidden_ascending": with_collected(f"""SELECT {N}, current_number_of_rows, last_updated, leading_column_type, rows_above AS number_of_rows_inserted_above,
      rows_below AS number_of_rows_inserted_below, {ratio('rows_above', 'CASE WHEN mods = 0 THEN 1 ELSE mods END', 2, 100)} AS percent_of_modifications, mods AS number_of_modifications,
      inserts_since_last_update AS number_of_inserted_rows, deletes_since_last_update AS number_of_deleted_rows, count(*) OVER (PARTITION BY database_name) AS number_in_database,
      'Warning - ' || count(*) OVER (PARTITION BY database_name) || ' statistics grow above their range but are not typed as ascending' AS comment FROM {HID}"""),
    "chk12_hidden_ascending_list": with_collected(f"""SELECT {N}, current_number_of_rows, leading_column_type, rows_above AS number_of_rows_inserted_above,
      rows_below AS number_of_rows_inserted_below FROM {HID}"""),
    "chk34_steps_changed": with_collected(f"""SELECT {N}, statistic_type, current_number_of_rows, {MOD}, m1 AS number_of_modifications_since_previous_update, percent_of_threshold,
      number_of_rows_at_time_stat_was_updated AS rows_at_update_1, c2 AS rows_at_update_2, rows_sampled, statistic_percent_sampled, steps AS steps_1, st2 AS steps_2,
      u1 AS update_stat_1_datetime, u2 AS update_stat_2_datetime, {ratio('steps', 'st2', 2, 100)} AS steps_diff_pct,
      CASE WHEN {ratio('steps', 'st2', 2, 100)} < 90 AND m1 < 1000000 THEN 'Warning - Fewer steps than at the refresh before, the sample may have been smaller' ELSE 'OK' END AS comment
      FROM stat JOIN hw USING (rowid) WHERE statistic_percent_sampled <> 100 AND st2 <> 1 AND steps <> st2""", HW),
}
