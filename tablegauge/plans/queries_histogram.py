"""Registered queries of the histogram checks, with their DuckDB counterparts."""

from __future__ import annotations

from ..operators import checks_histogram as k
from .fixture import collected
from .oracle_base import ratio, with_collected
from .queries_catalogue import LEAD, N, ROWS_LARGE, UNIQ


def _on(check, **params):
    return lambda spark, sf: check(collected(spark, sf), **params)


QUERIES = {
    "chk15_skew": _on(k.check_skew),
    "chk56_date_range": _on(k.check_date_range, rows=ROWS_LARGE),
    "chk57_distribution": _on(k.check_distribution),
    "chk57_ascii": _on(k.text_chart),
    "chk58_growth": _on(k.check_growth),
}

HP = "hp AS (SELECT *, lag(l) OVER w AS pl, lag(t) OVER w AS pt, lag(hi_text) OVER w AS prev_text FROM hist WINDOW w AS (PARTITION BY rowid ORDER BY stepnumber))"


def _top(measure: str, tag: str) -> str:
    return f"{tag} AS (SELECT * FROM hp QUALIFY row_number() OVER (PARTITION BY rowid ORDER BY {measure} DESC, stepnumber) = 1)"


def _btw(tag: str) -> str:
    return f"('(' || key_column_name || ' > [' || {tag}.prev_text || '] AND ' || key_column_name || ' < [' || {tag}.hi_text || '])')"


TT = "tt AS (SELECT rowid, CAST(sum(range_rows + eq_rows) AS BIGINT) AS total, CAST(sum(range_rows) AS BIGINT) AS sum_range_rows, CAST(sum(eq_rows) AS BIGINT) AS sum_eq_rows FROM hist GROUP BY rowid)"
_exp = "(CASE WHEN key_column_data_type IN ('bigint', 'int') THEN a.l - a.pl - 1 WHEN key_column_data_type = 'timestamp_ntz' THEN date_diff('day', a.pt, a.t) - 1 END)"
_rp, _ep = ratio("r.range_rows", "total", 2, 100), ratio("e.eq_rows", "total", 2, 100)

DIST = """d0 AS (SELECT stat.*, key_column_density, stepnumber, hi_text, eq_rows, max(stepnumber) OVER (PARTITION BY rowid) AS n,
  row_number() OVER (PARTITION BY rowid ORDER BY eq_rows, stepnumber) AS rn, count(*) OVER (PARTITION BY rowid, eq_rows) AS same
  FROM """ + LEAD.replace("stat JOIN", "stat JOIN") + """ JOIN (SELECT rowid, stepnumber, hi_text, eq_rows FROM hist) hh USING (rowid)
  WHERE NOT is_unique AND current_number_of_rows >= 1000 AND rowid IN (SELECT rowid FROM hist GROUP BY rowid HAVING count(DISTINCT eq_rows) > 1)),
d1 AS (SELECT *, CASE WHEN stepnumber BETWEEN n // 2 AND n // 2 + n % 2 THEN eq_rows END AS middle FROM d0),
d2 AS (SELECT *, CAST(sum(eq_rows) OVER p AS BIGINT) AS total, """ + ratio("sum(eq_rows) OVER p", "n", 2) + " AS mean_avg, " + \
    ratio("sum(middle) OVER p", "count(middle) OVER p", 2) + """ AS middle_step,
  min(eq_rows) OVER p AS min_eq, max(eq_rows) OVER p AS max_eq, """ + ", ".join(
    f"max(CASE WHEN rn * 100 <= n * {p} THEN eq_rows END) OVER p AS percentile_{p}" for p in (10, 25, 50, 75, 90, 99)) + """
  FROM d1 WINDOW p AS (PARTITION BY rowid)),
md AS (SELECT rowid, eq_rows AS mode FROM (SELECT DISTINCT rowid, eq_rows, same FROM d0) QUALIFY row_number() OVER (PARTITION BY rowid ORDER BY same DESC, eq_rows) = 1)"""


def _signed(num: str, den: str) -> str:
    """num / den to two places, half away from zero, for a signed whole num and positive whole den."""
    return (f"(sign({num}) * ((2 * abs(CAST({num} AS HUGEINT)) * 100 + CAST({den} AS HUGEINT)) // nullif(2 * CAST({den} AS HUGEINT), 0)) / 100.0)")


def _sym(m: str) -> str:
    h = f"CAST(round({m} * 100) AS BIGINT)"
    return f"CAST(CASE WHEN eq_rows + {m} > 0 THEN {_signed(f'((eq_rows * 100 - {h}) * 200)', f'(eq_rows * 100 + {h})')} ELSE 0 END AS DOUBLE)"


def _rel(m: str) -> str:
    h = f"CAST(round({m} * 100) AS BIGINT)"
    return f"CAST(CASE WHEN eq_rows > 0 THEN {_signed(f'((eq_rows * 100 - {h}) * 100)', '(eq_rows * 100)')} ELSE 0 END AS DOUBLE)"


_pct = ratio("eq_rows", "total", 2, 100)
CHART = """ch AS (SELECT rowid, max(eq_rows) AS vmax, CASE WHEN max(eq_rows) = min(eq_rows) THEN 1 ELSE max(eq_rows) - min(eq_rows) END AS spread, max(stepnumber) AS n,
  greatest(length(CAST(max(eq_rows) AS VARCHAR)), 5) AS width FROM hist GROUP BY rowid),
cy AS (SELECT ch.*, y FROM ch, (SELECT unnest(range(-1, 22)) AS y)),
cb AS (SELECT rowid, y, string_agg(CASE WHEN eq_rows * 20 // spread >= y THEN '###' ELSE '   ' END, ' ' ORDER BY stepnumber) AS bars,
  string_agg(lpad(CAST(stepnumber AS VARCHAR), 3, '0'), ' ' ORDER BY stepnumber) AS foot
  FROM cy JOIN (SELECT rowid, stepnumber, eq_rows FROM hist) hh USING (rowid) GROUP BY rowid, y)"""
GROW = """gd AS (SELECT rowid, CAST(t AS DATE) AS day, CAST(sum(eq_rows) AS BIGINT) AS eq_rows, min_by(avg_range_rows, stepnumber) AS avg_range_rows
  FROM hist JOIN stat USING (rowid) WHERE key_column_data_type = 'timestamp_ntz' AND current_number_of_rows > 100 AND t IS NOT NULL
    AND CAST(t AS DATE) BETWEEN DATE '1950-01-01' AND DATE '2050-01-01' GROUP BY rowid, CAST(t AS DATE)),
gs AS (SELECT *, lag(day) OVER (PARTITION BY rowid ORDER BY day) AS prev FROM gd),
ge AS (SELECT rowid, eq_rows, avg_range_rows, day AS hit, CAST(unnest(generate_series(CAST(coalesce(prev + 1, day) AS TIMESTAMP), CAST(day AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM gs),
gr AS (SELECT ge.rowid, ge.day, year(ge.day) AS y, CAST(CASE WHEN ge.day = hit THEN eq_rows ELSE avg_range_rows END AS DECIMAL(28,4)) AS est, CAST(as_of AS DATE) AS today,
  max(year(ge.day)) OVER (PARTITION BY ge.rowid) AS last_year FROM ge JOIN stat ON stat.rowid = ge.rowid),
gt AS (SELECT rowid, sum(est) AS total, count(DISTINCT y) AS years, coalesce(sum(est) FILTER (WHERE y = year(today)), 0) AS this_year,
  max(last_year) AS last_year_with_data, sum(est) FILTER (WHERE y = last_year) AS rows_last_year, count(*) FILTER (WHERE y = last_year) AS days_last_year,
  count(DISTINCT month(day)) FILTER (WHERE y = last_year) AS months_last_year, coalesce(sum(est) FILTER (WHERE day >= today - 365), 0) AS r12,
  coalesce(sum(est) FILTER (WHERE day >= today - 1825), 0) AS r60, coalesce(sum(est) FILTER (WHERE day >= today - 3650), 0) AS r120,
  min(day) AS min_date, max(day) AS max_date FROM gr GROUP BY rowid),
""" + ",\n".join(f"""gl{i} AS (SELECT rowid, string_agg(u || '=' || r, ';' ORDER BY u) AS list FROM (
  SELECT rowid, strftime(day, '{fmt}') AS u, CAST(round(sum(est)) AS BIGINT) AS r FROM gr GROUP BY ALL) GROUP BY rowid)""" for i, fmt in enumerate(["%Y", "%Y%m", "%Y%m%d"]))
_mb = ratio("(number_of_in_row_data_pages_on_table + number_of_lob_data_pages_on_table) * 8", "1024", 2)

ORACLES = {
    "chk15_skew": with_collected(f"""SELECT {N}, key_column_data_type, statistic_type, lt AS leading_column_type, current_number_of_rows, rows_sampled, steps, key_column_density,
      {UNIQ} AS unique_values, {ratio('current_number_of_rows', UNIQ, 2)} AS rows_per_value, user_seeks + user_scans + user_lookups AS number_of_reads,
      a.hi_text AS max_avg_hi_key, a.avg_range_rows AS max_avg_range_rows, {_btw('a')} AS max_avg_range, {_exp} AS distinct_values_by_distance,
      a.distinct_range_rows AS distinct_values, a.stepnumber AS max_avg_stepnumber,
      CASE WHEN {_exp} IS NOT NULL AND a.distinct_range_rows > 1 AND a.distinct_range_rows < {_exp} THEN 'Warning - The range ' || {_btw('a')} || ' has gaps: ' || a.distinct_range_rows || ' values' ELSE 'OK' END AS comment_1,
      CASE WHEN key_column_data_type <> 'double' THEN 'SELECT count(*) FROM ' || table_name || ' WHERE ' || key_column_name || ' = ' ||
        CASE WHEN key_column_data_type IN ('bigint', 'int') THEN CAST(a.l - 1 AS VARCHAR) WHEN key_column_data_type = 'timestamp_ntz' THEN '''' || strftime(a.t - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') || ''''
          ELSE '''<a value inside the range>''' END END AS sample_query,
      r.range_rows AS max_range_rows, sum_range_rows, {_rp} AS range_rows_percent_from_total, {_btw('r')} AS max_range_rows_range,
      coalesce(CASE WHEN steps > 1 AND {_rp} >= 5 THEN 'Warning - The range ' || {_btw('r')} || ' holds ' || r.range_rows || ' rows, a filtered statistic may help' ELSE 'OK' END, NULL) AS comment_2,
      e.hi_text AS max_eq_hi_key, e.eq_rows AS max_eq_rows, sum_eq_rows, {_ep} AS eq_rows_percent_from_total,
      CASE WHEN steps > 1 AND {_ep} >= 5 THEN 'Warning - The value [' || coalesce(e.hi_text, 'NULL') || '] holds ' || e.eq_rows || ' rows' ELSE 'OK' END AS comment_3,
      CASE WHEN steps > 1 AND {_ep} >= 10 AND e.hi_text IS NULL THEN 'Warning - Many rows are NULL, filter them out of the statistic' ELSE 'OK' END AS comment_4,
      CASE WHEN steps >= 190 OR {UNIQ} >= 1000 THEN 'Information - Worth a closer look at skew' ELSE 'OK' END AS comment_5
      FROM (SELECT stat.*, key_column_density FROM {LEAD}) z JOIN (SELECT rowid AS hr, leading_column_type AS lt FROM history WHERE history_number = 1) hh ON hr = z.rowid
      JOIN a ON a.rowid = z.rowid JOIN r ON r.rowid = z.rowid JOIN e ON e.rowid = z.rowid JOIN tt ON tt.rowid = z.rowid
      WHERE current_number_of_rows >= 1000 AND NOT is_unique""", HP, _top("avg_range_rows", "a"), _top("range_rows", "r"), _top("eq_rows", "e"), TT),
    "chk56_date_range": with_collected(f"""SELECT {N}, statistic_type, last_updated, current_number_of_rows, rows_sampled, statistic_percent_sampled, mn AS min_datetime, mx AS max_datetime,
      CAST(year(mx) - year(mn) AS BIGINT) AS years_cnt, emn AS estimated_rows_min_value, emx AS estimated_rows_max_value
      FROM stat JOIN (SELECT rowid, min(t) AS mn, max(t) AS mx, min_by(eq_rows, t) AS emn, max_by(eq_rows, t) AS emx FROM hist WHERE t IS NOT NULL GROUP BY rowid) USING (rowid)
      WHERE key_column_data_type = 'timestamp_ntz' AND current_number_of_rows >= {ROWS_LARGE}"""),
    "chk57_distribution": with_collected(f"""SELECT repeat('|', CAST(ceil({_pct}) AS INTEGER)) AS bar, {N}, statistic_type, current_number_of_rows, number_of_rows_at_time_stat_was_updated,
      CAST(rowid AS BIGINT) AS rowid, stepnumber, hi_text AS range_hi_key, eq_rows, {_pct} AS eq_rows_percent_from_total,
      {ratio('number_of_rows_at_time_stat_was_updated', UNIQ, 2)} AS rows_per_value, mean_avg, middle_step,
      {_sym('mean_avg')} AS percent_diff_from_avg, {_rel('mean_avg')} AS percent_change_from_avg, {_sym('middle_step')} AS percent_diff_from_middle, {_rel('middle_step')} AS percent_change_from_middle,
      min_eq, max_eq, mode, percentile_10, percentile_25, percentile_50, percentile_75, percentile_90, percentile_99
      FROM d2 JOIN md USING (rowid)""", DIST),
    "chk57_ascii": with_collected("""SELECT CAST(cy.rowid AS BIGINT) AS rowid, CAST(21 - cy.y AS BIGINT) AS line_number, stats_name,
      CASE WHEN cy.y IN (21, 0) THEN repeat('-', CAST(width AS INTEGER)) || '-+-' || repeat('-', CAST(n * 4 AS INTEGER))
        WHEN cy.y = -1 THEN rpad('Step', CAST(width AS INTEGER), ' ') || ' | ' || foot
        ELSE lpad(CAST(cy.y * vmax // 20 AS VARCHAR), CAST(width AS INTEGER), ' ') || ' | ' || bars END AS chart
      FROM cy JOIN cb ON cb.rowid = cy.rowid AND cb.y = cy.y JOIN stat ON stat.rowid = cy.rowid""", CHART),
    "chk58_growth": with_collected(f"""SELECT {N}, key_column_data_type, current_number_of_rows, rows_sampled, mb AS table_data_size_in_mb, last_updated, min_date, max_date,
      years AS number_of_years_on_range, CAST(last_year_with_data AS BIGINT) AS last_year_with_data, CAST(round(this_year) AS BIGINT) AS rows_current_year,
      CAST(round(rows_last_year) AS BIGINT) AS rows_last_year_with_data, pm AS avg_rows_per_month_last_year, CAST(round(rows_last_year / days_last_year) AS BIGINT) AS avg_rows_per_day_last_year,
      CAST(round(total / years) AS BIGINT) AS avg_rows_per_year, CAST(round(r12) AS BIGINT) AS rows_last_12_months, CAST(round(r60) AS BIGINT) AS rows_last_5_years,
      CAST(round(r120) AS BIGINT) AS rows_last_10_years, current_number_of_rows + pm * 12 AS estimated_rows_in_1_years, current_number_of_rows + pm * 60 AS estimated_rows_in_5_years,
      current_number_of_rows + pm * 120 AS estimated_rows_in_10_years, format('{{:,}}', current_number_of_rows + pm * 12) || '.00' AS estimated_rows_in_1_year_text,
      round(mb * pm / current_number_of_rows, 4) AS estimated_size_per_month_in_mb,
      round(mb + mb * pm / current_number_of_rows * 12, 3) AS estimated_size_in_mb_in_1_years, round(mb + mb * pm / current_number_of_rows * 60, 3) AS estimated_size_in_mb_in_5_years,
      round(mb + mb * pm / current_number_of_rows * 120, 3) AS estimated_size_in_mb_in_10_years, rows_per_year, rows_per_month, rows_per_day
      FROM (SELECT stat.*, gt.* EXCLUDE (rowid), gl0.list AS rows_per_year, gl1.list AS rows_per_month, gl2.list AS rows_per_day, {_mb} AS mb,
        CAST(round(round(rows_last_year / months_last_year, 2)) AS BIGINT) AS pm
        FROM stat JOIN gt ON gt.rowid = stat.rowid JOIN gl0 ON gl0.rowid = stat.rowid JOIN gl1 ON gl1.rowid = stat.rowid JOIN gl2 ON gl2.rowid = stat.rowid)""", GROW),
}
