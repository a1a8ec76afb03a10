"""DuckDB text that rebuilds the collected tables from the test tables, for use in front of each check's own query."""

from __future__ import annotations

from .fixture import STAT_DEFS, TABLE_DEFS

COLUMN_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderdate": "timestamp_ntz", "o_orderstatus": "string",
    "o_orderpriority": "string", "l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint",
    "l_shipdate": "timestamp_ntz", "l_returnflag": "string", "l_linestatus": "string", "l_quantity": "double",
    "l_discount": "double", "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
    "c_mktsegment": "string", "n_nationkey": "int", "text": "string", "lang": "string",
}
TABLE_BYTES = {  # fixed part, text columns
    "orders": (32, ["o_orderstatus", "o_orderpriority"]), "lineitem": (68, ["l_returnflag", "l_linestatus"]),
    "events": (32, ["event_type", "props"]), "customer": (20, ["c_name", "c_mktsegment"]), "nation": (8, ["n_name"]),
    "documents": (16, ["text", "lang", "source"]),
}
TABLE_COLUMNS = {"orders": 6, "lineitem": 11, "events": 6, "customer": 5, "nation": 3, "documents": 5}
SLOT = {"bigint": "l", "int": "l", "double": "f", "string": "s", "timestamp_ntz": "t"}
SIZE = {"bigint": "8", "int": "4", "double": "8", "timestamp_ntz": "8"}


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def ratio(a: str, b: str, digits: int, factor: int = 1) -> str:
    """a * factor / b rounded half up to ``digits`` places in whole numbers; a and b are whole and not negative."""
    ten = 10 ** digits
    return (f"(CASE WHEN ({b}) = 0 THEN NULL ELSE CAST((2 * CAST({a} AS HUGEINT) * {factor * ten} + CAST({b} AS HUGEINT)) "
            f"// NULLIF(2 * CAST({b} AS HUGEINT), 0) AS DOUBLE) / {ten}.0 END)")


def elapsed(a: str, b: str) -> str:
    m = f"date_diff('minute', {a}, {b})"
    return f"(CAST({m} // 1440 AS VARCHAR) || 'd ' || CAST({m} // 60 % 24 AS VARCHAR) || 'hr ' || CAST({m} % 60 AS VARCHAR) || 'min')"


def mtext(m: str) -> str:
    return f"(CAST({m} // 1440 AS VARCHAR) || 'd ' || CAST({m} // 60 % 24 AS VARCHAR) || 'hr ' || CAST({m} % 60 AS VARCHAR) || 'min')"


def tstext(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _defs() -> str:
    tables = {t.name: t for t in TABLE_DEFS}
    seen: dict[str, int] = {}
    rows = []
    for s in STAT_DEFS:
        t = tables[s.table]
        seen[s.table] = seen.get(s.table, 0) + 1
        rows.append("(" + ", ".join([
            q(s.rowid), q(t.database), q(s.table), q(s.name), q(seen[s.table]), q(",".join(s.columns)), q(",".join(s.stored)),
            q(s.columns[0]), q(COLUMN_TYPES[s.columns[0]]), q(s.kind), q(s.filter), q(s.persisted_sample_pct),
            q(s.no_recompute), q(s.is_incremental), q(s.with_histogram), q(t.is_partitioned), q(t.auto_update),
            q(t.auto_create), q(t.fixed_modifications), f"TIMESTAMP {q(t.cutoffs[0])}", f"TIMESTAMP {q(t.as_of)}",
            q(TABLE_COLUMNS[s.table]), q(len(s.columns)), q(t.ts_column is not None), q(len(t.cutoffs)),
        ]) + ")")
    return ("defs AS (SELECT * FROM (VALUES " + ",\n".join(rows) + ") v(rowid, database_name, table_name, stats_name, stats_id, "
            "stat_all_columns, stored_order, key_column_name, key_column_data_type, statistic_type, filter_definition, "
            "persisted_sample_percent, no_recompute, is_incremental, with_histogram, is_table_partitioned, "
            "is_auto_update_stats_on, is_auto_create_stats_on, fixed_modifications, last_updated, as_of, "
            "number_of_columns_in_this_table, n_columns, readable, n_cutoffs))")


def seen(t, h: int) -> str:
    if h > len(t.cutoffs):
        return "FALSE"
    return "TRUE" if t.ts_column is None else f"{t.ts_column} <= TIMESTAMP '{t.cutoffs[h - 1]}'"


def _now(t) -> str:
    return "TRUE" if t.ts_column is None else f"{t.ts_column} <= TIMESTAMP '{t.as_of}'"


def _vc() -> str:
    tables = {t.name: t for t in TABLE_DEFS}
    parts = []
    for s in STAT_DEFS:
        t = tables[s.table]
        smp = f"{s.sample_on} % 100 < {s.sample_pct}" if s.sample_pct else "TRUE"
        for n in range(1, len(s.columns) + 1):
            prefix = s.columns[:n]
            typ = COLUMN_TYPES[prefix[0]]
            slots = ", ".join(
                f"CAST({prefix[0] if n == 1 and SLOT[typ] == k else 'NULL'} AS {ty}) AS {k}"
                for k, ty in [("l", "BIGINT"), ("f", "DOUBLE"), ("s", "VARCHAR"), ("t", "TIMESTAMP")])
            tup = "CAST(NULL AS VARCHAR[])" if n == 1 else "[" + ", ".join(f"CAST({c} AS VARCHAR)" for c in prefix) + "]"
            size = " + ".join(SIZE.get(COLUMN_TYPES[c], f"strlen({c})") for c in prefix)
            counts = ", ".join(f"count(*) FILTER (WHERE ({seen(t, h)}) AND {smp}) AS s{h}" for h in (1, 2, 3, 4))
            counts += ", " + ", ".join(f"count(*) FILTER (WHERE {_now(t) if h == 0 else seen(t, h)}) AS f{h}" for h in range(5))
            parts.append(f"SELECT {s.rowid} AS rowid, {n} AS n, {slots}, {tup} AS tup, max({size}) AS kb, {counts} "
                         f"FROM {s.table} WHERE {s.filter or 'TRUE'} GROUP BY ALL")
    return "vc AS (" + "\nUNION ALL ".join(parts) + ")"


def _profile() -> str:
    parts = []
    for t in TABLE_DEFS:
        fixed, texts = TABLE_BYTES[t.name]
        row = f"{fixed}" + "".join(f" + CASE WHEN strlen({c}) <= 8000 THEN strlen({c}) ELSE 0 END" for c in texts)
        lob = "0" + "".join(f" + CASE WHEN strlen({c}) > 8000 THEN strlen({c}) ELSE 0 END" for c in texts)
        parts.append(
            f"SELECT '{t.name}' AS table_name, count(*) FILTER (WHERE {_now(t)}) AS current_rows, "
            + ", ".join(f"count(*) FILTER (WHERE {seen(t, h)}) AS rows{h}" for h in (1, 2, 3, 4))
            + f", CAST(sum({row}) FILTER (WHERE {_now(t)}) AS BIGINT) AS in_row_bytes, CAST(sum({lob}) FILTER (WHERE {_now(t)}) AS BIGINT) AS lob_bytes FROM {t.name}")
    return "profile AS (" + "\nUNION ALL ".join(parts) + ")"


_HIST = """
vl AS (SELECT rowid, unnest([1,2,3,4]) AS h, l, f, s, t, unnest([s1,s2,s3,s4]) AS cnt FROM vc WHERE n = 1),
nn AS (SELECT *, CAST(sum(cnt) OVER w AS BIGINT) AS cum, row_number() OVER w AS rn,
  CAST(sum(cnt) OVER p AS BIGINT) AS tot, count(*) OVER p AS keys FROM vl WHERE cnt > 0
  WINDOW w AS (PARTITION BY rowid, h ORDER BY l, f, s, t ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY rowid, h)),
bk AS (SELECT *, (cum * 99 + tot - 1) // tot AS bucket FROM nn),
nx AS (SELECT *, lead(bucket) OVER (PARTITION BY rowid, h ORDER BY rn) AS nb FROM bk),
hist_all AS (SELECT rowid, h, row_number() OVER w AS stepnumber, l, f, s, t,
  cum - cnt - coalesce(lag(cum) OVER w, 0) AS range_rows, cnt AS eq_rows,
  rn - 1 - coalesce(lag(rn) OVER w, 0) AS distinct_range_rows
  FROM nx WHERE rn = 1 OR keys <= 200 OR cnt * 99 >= tot OR nb IS NULL OR nb <> bucket
  WINDOW w AS (PARTITION BY rowid, h ORDER BY rn)),
hist AS (SELECT rowid, stepnumber, l, f, s, t, range_rows, eq_rows, distinct_range_rows,
  coalesce(CAST(l AS VARCHAR), CAST(f AS VARCHAR), s, strftime(t, '%Y-%m-%d %H:%M:%S')) AS hi_text,
  CASE WHEN distinct_range_rows = 0 THEN CAST(range_rows AS DOUBLE)
    ELSE CAST((2 * range_rows * 10000 + distinct_range_rows) // (2 * distinct_range_rows) AS DOUBLE) / 10000.0 END AS avg_range_rows
  FROM hist_all JOIN defs USING (rowid) WHERE h = 1 AND with_histogram)"""

_DENS = """
dens AS (SELECT rowid, n AS density_number, CAST(1.0 AS DOUBLE) / count(*) AS all_density, count(*) AS distinct_values,
  CAST(sum(kb * s1) AS DOUBLE) / CAST(sum(s1) AS DOUBLE) AS average_length, CAST(sum(s1) AS BIGINT) AS rows_sampled
  FROM vc WHERE s1 > 0 GROUP BY rowid, n)"""

_HISTORY = """
ext AS (SELECT rowid, """ + ", ".join(
    f"{a}({c}) FILTER (WHERE s{h} > 0) AS {a}_{c}{h}" for h in (2, 3, 4) for a in ("min", "max") for c in "lfst") + """
  FROM vc WHERE n = 1 GROUP BY rowid),
sides AS (SELECT rowid, """ + ", ".join(
    f"CAST(coalesce(sum(f{h} - f{h + 1}) FILTER (WHERE " + " OR ".join(f"{c} > max_{c}{h + 1}" for c in "lfst")
    + f"), 0) AS BIGINT) AS above{h}, CAST(coalesce(sum(f{h} - f{h + 1}) FILTER (WHERE "
    + " OR ".join(f"{c} < min_{c}{h + 1}" for c in "lfst") + f"), 0) AS BIGINT) AS below{h}" for h in (1, 2, 3)) + """
  , 0 AS above4, 0 AS below4, """ + ", ".join(
    f"count(*) FILTER (WHERE s{h} > 0) AS keys{h}, CAST(sum(f{h}) AS BIGINT) AS rows{h}" for h in (1, 2, 3, 4)) + """
  FROM vc JOIN ext USING (rowid) WHERE n = 1 GROUP BY rowid),
cut AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{t.name}', {i + 1}, TIMESTAMP '{c}')" for t in TABLE_DEFS for i, c in enumerate(t.cutoffs)) + """) v(table_name, history_number, updated)),
hl AS (SELECT rowid, unnest([1,2,3,4]) AS history_number, unnest([above1,above2,above3,above4]) AS above,
  unnest([below1,below2,below3,below4]) AS below, unnest([keys1,keys2,keys3,keys4]) AS keys,
  unnest([rows1-rows2,rows2-rows3,rows3-rows4,rows4]) AS ins FROM sides),
ns AS (SELECT rowid, h AS history_number, max(stepnumber) AS steps FROM hist_all GROUP BY ALL),
cards AS (SELECT table_name, unnest([1,2,3,4]) AS history_number, unnest([rows1,rows2,rows3,rows4]) AS table_cardinality FROM profile),
h0 AS (SELECT hl.rowid, hl.history_number, updated, table_cardinality, CASE WHEN with_histogram THEN ns.steps END AS steps,
  CASE WHEN keys > 0 THEN CAST(1.0 AS DOUBLE) / keys END AS density,
  CASE WHEN readable AND hl.history_number < n_cutoffs THEN above ELSE 0 END AS rows_above,
  CASE WHEN readable AND hl.history_number < n_cutoffs THEN below ELSE 0 END AS rows_below,
  CASE WHEN readable THEN ins ELSE 0 END AS inserts_since_last_update, 0 AS deletes_since_last_update,
  readable AND hl.history_number < n_cutoffs AS has_previous
  FROM hl JOIN defs ON defs.rowid = hl.rowid JOIN cut ON cut.table_name = defs.table_name AND cut.history_number = hl.history_number
  JOIN cards ON cards.table_name = defs.table_name AND cards.history_number = hl.history_number
  LEFT JOIN ns ON ns.rowid = hl.rowid AND ns.history_number = hl.history_number),
history AS (SELECT * EXCLUDE (has_previous), CASE WHEN NOT has_previous OR inserts_since_last_update = 0 THEN 'Unknown'
  WHEN rows_above * 10 >= inserts_since_last_update * 9 THEN 'Ascending'
  WHEN rows_below * 10 >= inserts_since_last_update * 9 THEN 'Descending' ELSE 'Stationary' END AS leading_column_type,
  inserts_since_last_update + deletes_since_last_update AS mods FROM h0)"""

_STAT = """
usage AS (SELECT CAST(event_id % """ + str(len(STAT_DEFS)) + """ + 1 AS INTEGER) AS rowid, count(*) FILTER (WHERE event_type = 'view') AS user_seeks,
  count(*) FILTER (WHERE event_type = 'click') AS user_scans, count(*) FILTER (WHERE event_type = 'purchase') AS user_lookups,
  count(*) FILTER (WHERE event_type = 'signup') AS user_updates, count(*) FILTER (WHERE event_type = 'error') AS wait_count,
  CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type = 'error'), 0) AS BIGINT) AS wait_ms,
  min(date_sub('second', ts, TIMESTAMP '2024-01-31')) FILTER (WHERE event_type = 'view') AS age_seek,
  min(date_sub('second', ts, TIMESTAMP '2024-01-31')) FILTER (WHERE event_type = 'click') AS age_scan,
  min(date_sub('second', ts, TIMESTAMP '2024-01-31')) FILTER (WHERE event_type = 'purchase') AS age_lookup
  FROM events GROUP BY 1),
sizes AS (SELECT rowid, CAST(sum(f1) AS BIGINT) AS rows_f, CAST(sum(s1) AS BIGINT) AS rows_s, CAST(sum(f0) AS BIGINT) AS rows_0,
  max(kb) AS max_kb, CAST(sum(kb * s1) AS DOUBLE) / CAST(sum(s1) AS DOUBLE) AS average_key_length FROM vc WHERE n = 1 GROUP BY rowid),
hs AS (SELECT rowid, max(stepnumber) AS steps FROM hist GROUP BY rowid),
fd AS (SELECT rowid, max_by(distinct_values, density_number) AS distinct_full, min_by(all_density, density_number) AS key_density FROM dens GROUP BY rowid),
s0 AS (SELECT defs.*, current_rows AS current_number_of_rows, profile.rows1 AS unfiltered_rows,
  (in_row_bytes + 8191) // 8192 AS number_of_in_row_data_pages_on_table, (lob_bytes + 8191) // 8192 AS number_of_lob_data_pages_on_table,
  rows_f AS number_of_rows_at_time_stat_was_updated, rows_s AS rows_sampled, average_key_length, key_density,
  CASE WHEN fixed_modifications > 0 THEN fixed_modifications ELSE rows_0 - rows_f END AS current_number_of_modified_rows_since_last_update,
  hs.steps AS steps, distinct_full = rows_s AS is_unique, max_kb > 8000 AS is_lob, filter_definition IS NOT NULL AS has_filter,
  CASE WHEN profile.rows1 >= 25001 THEN 'Dynamic' ELSE 'Static' END AS auto_update_threshold_type,
  CAST(CASE WHEN profile.rows1 >= 25001 THEN floor(sqrt(1000.0 * profile.rows1)) WHEN profile.rows1 <= 500 THEN 501 ELSE 500 + profile.rows1 // 5 END AS BIGINT) AS auto_update_threshold,
  count(*) OVER (PARTITION BY defs.table_name) AS number_of_statistics_in_this_table,
  database_name || '.' || defs.table_name || '.' || stats_name AS fqn_stats_name,
  user_seeks, user_scans, user_lookups, user_updates, wait_count, wait_ms,
  as_of - age_seek * INTERVAL 1 SECOND AS last_user_seek, as_of - age_scan * INTERVAL 1 SECOND AS last_user_scan,
  as_of - age_lookup * INTERVAL 1 SECOND AS last_user_lookup
  FROM defs JOIN profile USING (table_name) LEFT JOIN sizes USING (rowid) LEFT JOIN hs USING (rowid) LEFT JOIN fd USING (rowid)
  LEFT JOIN usage USING (rowid)),
stat AS (SELECT *, greatest(last_user_seek, last_user_scan, last_user_lookup) AS last_used, """ + \
    ratio("current_number_of_modified_rows_since_last_update", "auto_update_threshold", 2, 100) + """ AS percent_of_threshold, """ + \
    ratio("rows_sampled", "number_of_rows_at_time_stat_was_updated", 2, 100) + """ AS statistic_percent_sampled FROM s0)"""


def collected_ctes() -> str:
    return ",\n".join([_defs(), _vc(), _profile(), _HIST.strip(), _DENS.strip(), _HISTORY.strip(), _STAT.strip()])


def with_collected(sql: str, *more: str) -> str:
    """``sql`` behind the collected tables and any further CTEs."""
    return "WITH " + ",\n".join([collected_ctes(), *more]) + "\n" + sql
