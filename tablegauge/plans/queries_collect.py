"""Registered queries of sources, collection and accuracy, with their DuckDB counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import ntz
from ..functions.keys import key_text, native_key
from ..operators import accuracy as acc
from ..operators import profile as prof
from ..operators import sketches as sk
from ..operators.histogram import histogram
from ..operators.profile import sampled
from ..session import scratch_path, written
from ..sources.definitions import stat_columns
from ..sources.tables import collect_all, count_events, read_events, read_named
from .fixture import ACCESS_KINDS, STAT_DEFS, TABLE_DEFS, access_log, collected, names_of_stats
from .oracle_base import q, ratio, seen, with_collected

STALE = "2000-01-01"
#: Statistics whose accuracy is checked, the most used of all.
MOST_USED = 12


def src_union_counts(spark, sf):
    names = ["orders", "lineitem", "events", "customer", "documents"]
    def opened(n):
        return lambda: read_named(spark, sf, n).select(F.lit(1).alias("one"))
    sources = {n: opened(n) for n in [*names, "tempdb", "missing_table"]}
    return collect_all(sources, "*", exclude=["tempdb"]).groupBy("source_name").agg(F.count(F.lit(1)).alias("rows"))


def event_log(spark, sf):
    return read_named(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("event_name"), F.col("props").alias("text_data"),
        F.col("ts").alias("start_time"), F.concat(F.lit("db"), F.pmod("user_id", F.lit(3)).cast("string")).alias("database_name"))


def src_event_filter(spark, sf):
    return count_events(read_events(spark, event_log(spark, sf), ["error", "purchase"]))


def stat_catalog(spark, sf):
    stat = collected(spark, sf)["stat"]
    orders = stat_columns(stat)
    cols = ["rowid", "database_name", "table_name", "stats_name", "statistic_type", "key_column_name", "key_column_data_type",
            "current_number_of_rows", "number_of_rows_at_time_stat_was_updated", "unfiltered_rows", "rows_sampled",
            "statistic_percent_sampled", "current_number_of_modified_rows_since_last_update", "auto_update_threshold",
            "auto_update_threshold_type", "percent_of_threshold", "is_unique", "is_lob", "is_table_partitioned", "no_recompute",
            "last_updated", "number_of_in_row_data_pages_on_table", "number_of_lob_data_pages_on_table", "last_used", "fqn_stats_name"]
    return stat.select(*cols, F.col("steps").cast("long").alias("steps"), F.col("number_of_columns_in_this_table").cast("long").alias("number_of_columns_in_this_table"),
                       "number_of_statistics_in_this_table").join(orders, "rowid").withColumn("rowid", F.col("rowid").cast("long"))


def stat_header(spark, sf):
    return collected(spark, sf)["stat_header"].withColumns({c: F.col(c).cast("long") for c in ("rowid", "steps", "persisted_sample_percent")})


def stat_density(spark, sf):
    li = read_named(spark, sf, "lineitem").withColumn("l_shipmonth", F.month("l_shipdate"))
    return prof.density_vector(li, ["l_returnflag", "l_linestatus", "l_shipmonth"])


def _hist(table, key, where=None):
    def run(spark, sf):
        df = read_named(spark, sf, table)
        return histogram(df.filter(where) if where is not None else df, key).withColumns({
            "stepnumber": F.col("stepnumber").cast("long"), "avg_range_rows": F.col("avg_range_rows").cast("double")})
    return run


def stat_history(spark, sf):
    return collected(spark, sf)["stat_history"].withColumns(
        {c: F.col(c).cast("long") for c in ("rowid", "history_number", "steps")})


def stat_sampled(spark, sf):
    return prof.stat_header(read_named(spark, sf, "lineitem"), ["l_partkey"], sample_on="l_orderkey", sample_pct=20)


def stat_filtered(spark, sf):
    return prof.stat_header(read_named(spark, sf, "lineitem"), ["l_shipdate"], where="l_returnflag = 'R'")


def stat_partition_merge(spark, sf):
    orders = read_named(spark, sf, "orders")
    year = F.year("o_orderdate")
    counts = prof.partition_stats(orders, "o_custkey", year)
    changes = orders.filter(F.col("o_orderdate") > ntz("2001-01-01")).groupBy(year.cast("string").alias("part")).agg(F.count(F.lit(1)).alias("changes"))
    parts = prof.changed_partitions(counts, changes)
    whole = prof.merge_partitions(counts).agg(F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("distinct_values"))
    return parts.unionByName(whole.withColumn("part", F.lit("all")), allowMissingColumns=True)


def usage_rollup(spark, sf):
    log = access_log(spark, sf).withColumn("rowid", F.col("rowid").cast("long"))
    return prof.usage_rollup(log, ["rowid"], ACCESS_KINDS)


def usage_attach(spark, sf):
    o = read_named(spark, sf, "orders")
    on = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    usage = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("seeks"), on("F").alias("last_seek"), on("O").alias("last_scan"), on("P").alias("last_lookup"))
    return prof.attach_usage(read_named(spark, sf, "customer").select("c_custkey", "c_mktsegment"), usage, "c_custkey")


def stat_merged_histogram(spark, sf):
    """Counts of orders kept by year at an earlier time; only years with newer orders are counted again."""
    orders, part, path = read_named(spark, sf, "orders"), F.year("o_orderdate"), scratch_path(spark, "orders-by-year")
    newer = F.col("o_orderdate") > ntz(STALE)
    prof.write_partition_stats(prof.partition_stats(orders.filter(~newer), "o_custkey", part), path)
    changed = [r.part for r in orders.filter(newer).select(part.cast("string").alias("part")).distinct().collect()]  # years
    return prof.merged_histogram(prof.refresh_partitions(orders, "o_custkey", part, changed, path)).select(
        "stepnumber", "range_hi_key", "range_rows", "eq_rows", "distinct_range_rows", F.col("avg_range_rows").cast("double").alias("avg_range_rows"))


def stat_distinct_estimate(spark, sf):
    """Distinct values of columns from a fifth of the rows, beside the exact figure."""
    lines = read_named(spark, sf, "lineitem")
    sample = sampled(lines, "l_orderkey", 20)
    parts = []
    for key in ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"):
        exact = lines.agg(F.count(key).alias("rows"), F.count_distinct(key).alias("exact"))
        found = prof.distinct_from_sample(sample, key, F.lit(lines.filter(F.col(key).isNotNull()).count()))
        parts.append(found.crossJoin(exact).select(F.lit(key).alias("key_column_name"), "rows", *found.columns, "exact"))  # one row each
    return reduce(DataFrame.unionByName, parts)


#: Keys whose histogram is made from quantile sketches, and into how many shares.
SKETCHED, SHARES = ("l_partkey", "l_extendedprice", "l_shipdate", "l_linenumber"), 50


def stat_histogram_sketch(spark, sf):
    """Bounds of equal shares of the lines from a sketch per year, each with whether its real rank is within the error of the sketch."""
    lines = read_named(spark, sf, "lineitem")
    parts = []
    for key in SKETCHED:
        kept = written(sk.quantile_sketches(lines, key, F.year("l_shipdate")), "quantiles")
        bounds = written(sk.sketch_bounds(kept, lines.schema[key].dataType, SHARES), "bounds")
        audit = sk.rank_audit(lines, key, bounds)
        parts.append(audit.select(
            F.lit(key).alias("key_column_name"), F.col("share").cast("long").alias("share"), "target_rows", (F.col("rank_error") <= sk.rank_error()).alias("within"),
            F.when(F.col("share") == SHARES, F.col("rows_up_to")).alias("rows_up_to_last")))
    return reduce(DataFrame.unionByName, parts)


PREFIX = ["l_partkey", "l_suppkey", "l_shipdate"]


def stat_density_sketch(spark, sf):
    """Distinct values of prefixes from sketches per year, against the exact figures."""
    lines = read_named(spark, sf, "lineitem")
    merged = sk.merged_density(written(sk.prefix_sketches(lines, PREFIX, F.year("l_shipdate")), "prefixes"), PREFIX)
    exact = prof.density_vector(lines, PREFIX).select("density_number", F.col("distinct_values").alias("exact"))
    return merged.join(exact, "density_number").select(
        F.col("density_number").cast("long").alias("density_number"), "columns", "rows", "average_length", "exact",
        (F.abs(F.col("distinct_values") - F.col("exact")) <= F.ceil(F.col("exact") * sk.distinct_error())).alias("within"))


#: Keys whose most frequent values are asked for, with few and with many values, even and uneven.
HITTERS = {"lineitem": ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"), "events": ("event_type", "user_id"), "orders": ("o_custkey", "o_orderkey")}


def acc_heavy_hitters(spark, sf):
    """The ten most frequent values of keys of several types, by candidates; keys without a repeated value give no rows."""
    parts = [sk.heavy_hitters(read_named(spark, sf, t), k).select(F.lit(k).alias("key_column_name"), F.col("key_value").cast("string").alias("key_value"), "number_of_rows")
             for t, keys in HITTERS.items() for k in keys if k not in ("l_extendedprice", "l_shipdate")]
    dated = [sk.heavy_hitters(read_named(spark, sf, "lineitem"), k).select(
        F.lit(k).alias("key_column_name"), (F.date_format("key_value", "yyyy-MM-dd HH:mm:ss") if k == "l_shipdate" else F.round(F.col("key_value") * 100).cast("long").cast("string")).alias("key_value"),
        "number_of_rows") for k in ("l_extendedprice", "l_shipdate")]
    return reduce(DataFrame.unionByName, parts + dated)


def stat_snapshot_changes(spark, sf):
    """Lines before and after a night in which some were shipped late, some cancelled and some added."""
    lines = read_named(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    before = lines.filter(F.pmod(k, F.lit(7)) != 0)
    after = lines.filter(F.pmod(k, F.lit(11)) != 0).withColumn("l_quantity", F.when(F.pmod(k, F.lit(13)) == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return prof.snapshot_changes(before, after, ["l_orderkey", "l_linenumber", "l_returnflag"], "l_returnflag")


def auto_threshold(spark, sf):
    per_key = read_named(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    tables = {n: read_named(spark, sf, n).select(F.lit(n).alias("name")) for n in ("orders", "lineitem", "events", "nation")}
    per_table = collect_all(tables).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    return prof.thresholds(per_key.unionByName(per_table))


def plan_lists(spark, sf):
    """Plans with the statistics they use, one per order."""
    names = names_of_stats()
    arr = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    return read_named(spark, sf, "orders").selectExpr(
        "concat(o_orderpriority, '/', o_orderstatus) AS query_hash",
        f"concat({arr}[CAST(pmod(o_orderkey, {len(names) - 2}) AS INT)], ' , ', {arr}[CAST(pmod(o_custkey, 7) AS INT)]) AS stats_list")


def ref_count(spark, sf):
    return prof.reference_count(collected(spark, sf)["stat"], plan_lists(spark, sf)).withColumn("rowid", F.col("rowid").cast("long"))


def stale_report(spark, sf):
    """Orders against the histogram they had at an earlier cutoff."""
    orders = read_named(spark, sf, "orders")
    old = histogram(orders.filter(F.col("o_orderdate") <= ntz(STALE)), "o_custkey")
    return acc.accuracy(orders, "o_custkey", old)


def _stale_columns(*cols):
    return lambda spark, sf: stale_report(spark, sf).select("stepnumber", *cols)


def acc_top10(spark, sf):
    return acc.top_values(read_named(spark, sf, "orders"), "o_custkey")


def acc_topn(spark, sf):
    c = collected(spark, sf)
    tables = {t.name: read_named(spark, sf, t.name) for t in TABLE_DEFS}

    def hist_of(rowid, df, key):
        return c["histogram"].filter(F.col("rowid") == rowid).withColumn("range_hi_key", native_key(F.col("hi"), df.schema[key].dataType))

    return acc.accuracy_top(tables, c["stat"], hist_of, MOST_USED).select(
        "rowid", "table_name", "key_column_name", "stepnumber", "range_hi_key", "eq_rows", "actual_eq_rows", "range_rows",
        "actual_range_rows", "distinct_range_rows", "actual_distinct_range_rows", "value_with_biggest_diff", "actual_rows_for_value")


def acc_repro(spark, sf):
    return acc.repro_texts(stale_report(spark, sf), "orders", "o_custkey")


QUERIES = {
    "src_union_counts": src_union_counts, "src_event_filter": src_event_filter, "stat_catalog": stat_catalog,
    "stat_header": stat_header, "stat_density": stat_density,
    "stat_histogram_int": _hist("orders", "o_custkey"), "stat_histogram_date": _hist("lineitem", "l_shipdate"),
    "stat_histogram_decimal": _hist("lineitem", "l_extendedprice"),
    "stat_history": stat_history, "stat_sampled": stat_sampled, "stat_filtered": stat_filtered,
    "stat_partition_merge": stat_partition_merge, "stat_merged_histogram": stat_merged_histogram, "stat_distinct_estimate": stat_distinct_estimate,
    "stat_histogram_sketch": stat_histogram_sketch, "stat_density_sketch": stat_density_sketch, "acc_heavy_hitters": acc_heavy_hitters,
    "stat_snapshot_changes": stat_snapshot_changes, "usage_rollup": usage_rollup, "usage_attach": usage_attach,
    "auto_threshold": auto_threshold, "ref_count": ref_count,
    "acc_eq": _stale_columns("range_hi_key", "eq_rows", "actual_eq_rows"),
    "acc_range": _stale_columns("previous_range_hi_key", "range_hi_key", "range_rows", "actual_range_rows", "distinct_range_rows",
                                "actual_distinct_range_rows", "actual_avg_range_rows"),
    "acc_biggest_diff": _stale_columns("avg_range_rows", "value_with_biggest_diff", "actual_rows_for_value"),
    "acc_top10": acc_top10, "acc_report": stale_report, "acc_topn": acc_topn, "acc_repro": acc_repro,
}


def hist_cte(name: str, table: str, key: str, where: str = "TRUE") -> str:
    return f"""{name}_v AS (SELECT {key} AS k, count(*) AS cnt FROM {table} WHERE ({where}) AND {key} IS NOT NULL GROUP BY 1),
{name}_n AS (SELECT k, cnt, CAST(sum(cnt) OVER w AS BIGINT) AS cum, row_number() OVER w AS rn, CAST(sum(cnt) OVER () AS BIGINT) AS tot, count(*) OVER () AS keys
  FROM {name}_v WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)),
{name}_b AS (SELECT *, (cum * 99 + tot - 1) // tot AS b, lead((cum * 99 + tot - 1) // tot) OVER (ORDER BY k) AS nb FROM {name}_n),
{name} AS (SELECT row_number() OVER (ORDER BY k) AS stepnumber, k AS range_hi_key, lag(k) OVER (ORDER BY k) AS previous_range_hi_key,
  cum - cnt - coalesce(lag(cum) OVER (ORDER BY k), 0) AS range_rows, cnt AS eq_rows, rn - 1 - coalesce(lag(rn) OVER (ORDER BY k), 0) AS distinct_range_rows
  FROM {name}_b WHERE rn = 1 OR keys <= 200 OR cnt * 99 >= tot OR nb IS NULL OR nb <> b)"""


def avg_sql(r: str = "range_rows", d: str = "distinct_range_rows") -> str:
    return f"(CASE WHEN {d} = 0 THEN CAST({r} AS DOUBLE) ELSE {ratio(r, d, 4)} END)"


def acc_ctes(name: str, table: str, key: str) -> str:
    """Actual figures of the steps of histogram CTE ``name`` by a plain range join."""
    return f"""{name}_a AS (SELECT {key} AS k, count(*) AS cnt FROM {table} WHERE {key} IS NOT NULL GROUP BY 1),
{name}_r AS (SELECT h.stepnumber, a.k, a.cnt, {avg_sql()} AS avg_range_rows FROM {name} h JOIN {name}_a a ON a.k > h.previous_range_hi_key AND a.k < h.range_hi_key),
{name}_s AS (SELECT stepnumber, CAST(sum(cnt) AS BIGINT) AS arr, count(*) AS adr FROM {name}_r GROUP BY 1),
{name}_x AS (SELECT stepnumber, arg_min(k, row(cnt, k)) AS rk, min(cnt) AS rc, max(cnt) AS cc, any_value(avg_range_rows) AS av FROM {name}_r GROUP BY 1),
{name}_y AS (SELECT {name}_x.*, (SELECT min(k) FROM {name}_r r WHERE r.stepnumber = {name}_x.stepnumber AND r.cnt = {name}_x.cc) AS ck FROM {name}_x),
{name}_rep AS (SELECT h.stepnumber, range_hi_key, previous_range_hi_key, eq_rows, coalesce(a.cnt, 0) AS actual_eq_rows, range_rows, coalesce(arr, 0) AS actual_range_rows,
  distinct_range_rows, coalesce(adr, 0) AS actual_distinct_range_rows, {avg_sql()} AS avg_range_rows,
  CASE WHEN abs(av - cc) >= abs(av - rc) THEN ck ELSE rk END AS value_with_biggest_diff, CASE WHEN abs(av - cc) >= abs(av - rc) THEN cc ELSE rc END AS actual_rows_for_value
  FROM {name} h LEFT JOIN {name}_a a ON a.k = h.range_hi_key LEFT JOIN {name}_s s ON s.stepnumber = h.stepnumber LEFT JOIN {name}_y y ON y.stepnumber = h.stepnumber)"""


_stale = f"WITH {hist_cte('old', 'orders', 'o_custkey', f'o_orderdate <= TIMESTAMP {q(STALE)}')},\n{acc_ctes('old', 'orders', 'o_custkey')}\n"
_avga = ratio("actual_range_rows", "CASE WHEN actual_distinct_range_rows = 0 THEN 1 ELSE actual_distinct_range_rows END", 4)
_names = "[" + ", ".join(q(n) for n in names_of_stats()) + "]"
_n = len(names_of_stats())


def _fac(e: str, a: str) -> str:
    return f"CASE WHEN {a} > 0 AND {e} <> {a} THEN {ratio(e, a, 2)} ELSE 0.0 END"


def _header(table: str, key: str, size: str, keep: str, smp: str) -> str:
    return f"""SELECT *, {ratio('rows_sampled', 'greatest(rows, 1)', 2, 100)} AS percent_sampled, CAST(1.0 AS DOUBLE) / distinct_values AS density FROM (
      SELECT count(*) FILTER (WHERE {keep}) AS rows, count(*) FILTER (WHERE {keep} AND {smp}) AS rows_sampled,
      count(DISTINCT CASE WHEN {keep} AND {smp} THEN {key} END) AS distinct_values, CAST({size} AS DOUBLE) AS average_key_length, count(*) AS unfiltered_rows FROM {table})"""


def _density_row(n: int, cols: str, size: str) -> str:
    return f"""SELECT {n} AS density_number, CAST(1.0 AS DOUBLE) / count(DISTINCT ({cols})) AS all_density, count(DISTINCT ({cols})) AS distinct_values, avg({size}) AS average_length,
      {q(cols.replace('row(', '').replace(')', '').replace(' ', ''))} AS columns, {ratio('count(*)', f'count(DISTINCT ({cols}))', 4)} AS rows_per_value FROM lm"""


def _hist_select(table: str, key: str) -> str:
    return f"WITH {hist_cte('h', table, key)} SELECT stepnumber, range_hi_key, range_rows, eq_rows, distinct_range_rows, {avg_sql()} AS avg_range_rows FROM h"


def _estimate(key: str) -> str:
    return f"""SELECT '{key}' AS key_column_name, n AS rows, r AS rows_sampled, d AS distinct_in_sample, f AS seen_once,
      round(sqrt(CAST(n AS DOUBLE) / r) * f + (d - f), 4) AS estimate, d AS at_least, least(CAST(ceil(CAST(n AS DOUBLE) / r * f + (d - f)) AS BIGINT), n) AS at_most, exact FROM
      (SELECT count({key}) AS n, count(DISTINCT {key}) AS exact FROM lineitem), (SELECT CAST(sum(c) AS BIGINT) AS r, count(*) AS d, count(*) FILTER (WHERE c = 1) AS f FROM
      (SELECT {key}, count(*) AS c FROM lineitem WHERE l_orderkey % 100 < 20 AND {key} IS NOT NULL GROUP BY 1))"""


def _hitters(table: str, key: str) -> str:
    text = {"l_shipdate": f"strftime({key}, '%Y-%m-%d %H:%M:%S')", "l_extendedprice": f"CAST(CAST(round({key} * 100) AS BIGINT) AS VARCHAR)"}.get(key, f"CAST({key} AS VARCHAR)")
    return f"""SELECT * FROM (SELECT '{key}' AS key_column_name, {text} AS key_value, n AS number_of_rows FROM
      (SELECT {key}, count(*) AS n FROM {table} GROUP BY 1 ORDER BY n DESC, 1 NULLS FIRST LIMIT 10) WHERE n > 1)"""


def _topn() -> str:
    tables = {t.name: t for t in TABLE_DEFS}
    ctes, parts = [], []
    for d in STAT_DEFS:
        if not d.with_histogram:
            continue
        k, n, sample = d.columns[0], f"k{d.rowid}", f"{d.sample_on} % 100 < {d.sample_pct}" if d.sample_pct else "TRUE"
        ctes += [hist_cte(n, d.table, k, f"({seen(tables[d.table], 1)}) AND ({d.filter or 'TRUE'}) AND {sample}"), acc_ctes(n, d.table, k)]
        hi, value = "CAST(range_hi_key AS VARCHAR)", "CAST(value_with_biggest_diff AS VARCHAR)"
        parts.append(f"""SELECT {d.rowid}::BIGINT AS rowid, '{d.table}' AS table_name, '{k}' AS key_column_name, stepnumber, {hi} AS range_hi_key, eq_rows, actual_eq_rows, range_rows,
          actual_range_rows, distinct_range_rows, actual_distinct_range_rows, {value} AS value_with_biggest_diff, actual_rows_for_value FROM {n}_rep""")
    pick = f"(SELECT rowid FROM stat ORDER BY coalesce(user_seeks, 0) + coalesce(user_lookups, 0) DESC, current_number_of_rows DESC, rowid LIMIT {MOST_USED})"
    return with_collected(f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rowid IN {pick}", *ctes)


def _tail(e: str, a: str) -> str:
    return f"'; -- estimated ' || greatest({e}, 1) || ', actual ' || {a}"


ORACLES = {
    "src_union_counts": " UNION ALL ".join(f"SELECT '{t}' AS source_name, count(*) AS rows FROM {t}" for t in ("orders", "lineitem", "events", "customer", "documents")),
    "src_event_filter": "SELECT event_type AS event_name, count(*) AS events FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1",
    "stat_catalog": with_collected("""SELECT CAST(rowid AS BIGINT) AS rowid, database_name, table_name, stats_name, statistic_type, key_column_name, key_column_data_type, current_number_of_rows,
      number_of_rows_at_time_stat_was_updated, unfiltered_rows, rows_sampled, statistic_percent_sampled, current_number_of_modified_rows_since_last_update, auto_update_threshold,
      auto_update_threshold_type, percent_of_threshold, is_unique, is_lob, is_table_partitioned, no_recompute, last_updated, number_of_in_row_data_pages_on_table,
      number_of_lob_data_pages_on_table, last_used, fqn_stats_name, steps, CAST(number_of_columns_in_this_table AS BIGINT) AS number_of_columns_in_this_table,
      number_of_statistics_in_this_table, stat_all_columns AS key_order, stored_order FROM stat"""),
    "stat_header": with_collected("""SELECT CAST(rowid AS BIGINT) AS rowid, last_updated AS updated, number_of_rows_at_time_stat_was_updated AS rows, rows_sampled, steps, key_density AS density,
      average_key_length, filter_definition AS filter_expression, unfiltered_rows, CAST(persisted_sample_percent AS BIGINT) AS persisted_sample_percent FROM stat"""),
    "stat_density": "WITH lm AS (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem) " + " UNION ALL ".join([
        _density_row(1, "l_returnflag", "strlen(l_returnflag)"), _density_row(2, "row(l_returnflag, l_linestatus)", "strlen(l_returnflag) + strlen(l_linestatus)"),
        _density_row(3, "row(l_returnflag, l_linestatus, l_shipmonth)", "strlen(l_returnflag) + strlen(l_linestatus) + 4")]),
    "stat_histogram_int": _hist_select("orders", "o_custkey"), "stat_histogram_date": _hist_select("lineitem", "l_shipdate"),
    "stat_histogram_decimal": _hist_select("lineitem", "l_extendedprice"),
    "stat_merged_histogram": _hist_select("orders", "o_custkey"),
    "stat_distinct_estimate": " UNION ALL ".join(_estimate(k) for k in ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")),
    "stat_histogram_sketch": " UNION ALL ".join(f"""SELECT '{k}' AS key_column_name, i AS share, (count({k}) * i + {SHARES - 1}) // {SHARES} AS target_rows, TRUE AS within,
      CASE WHEN i = {SHARES} THEN count({k}) END AS rows_up_to_last FROM lineitem, (SELECT unnest(range(1, {SHARES + 1})) AS i) GROUP BY i""" for k in SKETCHED),
    "stat_density_sketch": " UNION ALL ".join(f"""SELECT {n} AS density_number, '{','.join(PREFIX[:n])}' AS columns, count(*) AS rows, CAST({8 * n} AS DOUBLE) AS average_length,
      count(DISTINCT row({', '.join(PREFIX[:n])})) AS exact, TRUE AS within FROM lineitem""" for n in (1, 2, 3)),
    "acc_heavy_hitters": " UNION ALL ".join(_hitters(t, k) for t, keys in HITTERS.items() for k in keys),
    "stat_snapshot_changes": """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity AS q, l_shipdate, l_orderkey + l_linenumber AS k FROM lineitem),
      b AS (SELECT l_orderkey, l_linenumber, l_returnflag, q, l_shipdate, count(*) AS n FROM l WHERE k % 7 <> 0 GROUP BY ALL),
      a AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN k % 13 = 0 THEN q + 1 ELSE q END AS q, l_shipdate, count(*) AS n FROM l WHERE k % 11 <> 0 GROUP BY ALL),
      j AS (SELECT l_orderkey, l_linenumber, l_returnflag, coalesce(b.n, 0) AS x, coalesce(a.n, 0) AS y FROM b FULL JOIN a USING (l_orderkey, l_linenumber, l_returnflag, q, l_shipdate)),
      g AS (SELECT l_returnflag, sum(greatest(x - y, 0)) AS gone, sum(greatest(y - x, 0)) AS come, sum(least(x, y)) AS same FROM j GROUP BY l_orderkey, l_linenumber, l_returnflag)
      SELECT l_returnflag, CAST(sum(come - least(gone, come)) AS BIGINT) AS inserts, CAST(sum(gone - least(gone, come)) AS BIGINT) AS deletes,
        CAST(sum(least(gone, come)) AS BIGINT) AS updates, CAST(sum(same) AS BIGINT) AS unchanged FROM g GROUP BY 1""",
    "stat_history": with_collected("""SELECT CAST(rowid AS BIGINT) AS rowid, CAST(history_number AS BIGINT) AS history_number, updated, table_cardinality, steps, density, rows_above, rows_below,
      inserts_since_last_update, CAST(deletes_since_last_update AS BIGINT) AS deletes_since_last_update, leading_column_type FROM history"""),
    "stat_sampled": _header("lineitem", "l_partkey", "8", "TRUE", "l_orderkey % 100 < 20"),
    "stat_filtered": _header("lineitem", "l_shipdate", "8", "l_returnflag = 'R'", "TRUE"),
    "stat_partition_merge": """WITH v AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS part, o_custkey AS k, count(*) AS cnt, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2001-01-01') AS ch FROM orders GROUP BY ALL),
      p AS (SELECT part, CAST(sum(cnt) AS BIGINT) AS rows, count(*) AS distinct_values, CAST(sum(ch) AS BIGINT) AS changes FROM v GROUP BY part),
      t AS (SELECT *, CASE WHEN rows <= 500 THEN 501 ELSE 500 + rows // 5 END AS threshold FROM p)
      SELECT *, changes >= threshold AS needs_rebuild FROM t UNION ALL SELECT 'all', count(*), count(DISTINCT o_custkey), NULL, NULL, NULL FROM orders""",
    "usage_rollup": f"""SELECT *, CASE WHEN waits > 0 THEN {ratio('wait_ms', 'waits', 2)} ELSE 0.0 END AS avg_wait_ms,
      (wait_ms // 1000 // 86400) || ':' || lpad(CAST(wait_ms // 1000 // 3600 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(wait_ms // 1000 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(wait_ms // 1000 % 60 AS VARCHAR), 2, '0') AS wait_time
      FROM (SELECT event_id % {_n} + 1 AS rowid, count(*) FILTER (WHERE event_type = 'view') AS seeks, count(*) FILTER (WHERE event_type = 'click') AS scans,
      count(*) FILTER (WHERE event_type = 'purchase') AS lookups, count(*) FILTER (WHERE event_type = 'signup') AS changes, count(*) FILTER (WHERE event_type = 'error') AS waits,
      CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type = 'error'), 0) AS BIGINT) AS wait_ms FROM events GROUP BY 1)""",
    "usage_attach": """SELECT c_custkey, c_mktsegment, seeks, last_seek, last_scan, last_lookup, greatest(last_seek, last_scan, last_lookup) AS last_used FROM customer
      LEFT JOIN (SELECT o_custkey, count(*) AS seeks, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_seek, max(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS last_scan,
      max(o_orderdate) FILTER (WHERE o_orderstatus = 'P') AS last_lookup FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "auto_threshold": """SELECT name, rows, CASE WHEN rows >= 25001 THEN 'Dynamic' ELSE 'Static' END AS threshold_type,
      CASE WHEN rows >= 25001 THEN CAST(floor(sqrt(1000.0 * rows)) AS BIGINT) WHEN rows <= 500 THEN 501 ELSE 500 + rows // 5 END AS threshold,
      CASE WHEN rows <= 500 THEN 501 ELSE 500 + rows // 5 END AS static_threshold FROM (
      SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS rows FROM orders GROUP BY 1""" + "".join(f" UNION ALL SELECT '{t}', count(*) FROM {t}" for t in ("orders", "lineitem", "events", "nation")) + ")",
    "ref_count": with_collected(f"""SELECT CAST(rowid AS BIGINT) AS rowid, fqn_stats_name, n AS plan_reference_count, l AS query_hashes FROM stat LEFT JOIN (
      SELECT nm, count(*) AS n, string_agg(qh, ',' ORDER BY qh) AS l FROM (
        SELECT o_orderpriority || '/' || o_orderstatus AS qh, {_names}[o_orderkey % {_n - 2} + 1] AS nm FROM orders
        UNION SELECT o_orderpriority || '/' || o_orderstatus, {_names}[o_custkey % 7 + 1] FROM orders) GROUP BY nm) ON nm = fqn_stats_name"""),
    "acc_eq": _stale + "SELECT stepnumber, range_hi_key, eq_rows, actual_eq_rows FROM old_rep",
    "acc_range": _stale + f"SELECT stepnumber, previous_range_hi_key, range_hi_key, range_rows, actual_range_rows, distinct_range_rows, actual_distinct_range_rows, {_avga} AS actual_avg_range_rows FROM old_rep",
    "acc_biggest_diff": _stale + "SELECT stepnumber, avg_range_rows, value_with_biggest_diff, actual_rows_for_value FROM old_rep",
    "acc_top10": "SELECT o_custkey AS key_value, count(*) AS number_of_rows FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "acc_report": _stale + f"""SELECT *, abs(eq_rows - actual_eq_rows) AS eq_rows_diff, {_fac('eq_rows', 'actual_eq_rows')} AS eq_rows_factor_diff, abs(range_rows - actual_range_rows) AS range_rows_diff,
      {_fac('range_rows', 'actual_range_rows')} AS range_rows_factor_diff, abs(distinct_range_rows - actual_distinct_range_rows) AS distinct_range_rows_diff, {_avga} AS actual_avg_range_rows,
      round(abs(avg_range_rows - {_avga}), 4) AS avg_range_rows_diff,
      CASE WHEN actual_rows_for_value > 0 THEN {ratio('actual_rows_for_value * 10000', 'CASE WHEN avg_range_rows = 0 THEN 10000 ELSE CAST(round(avg_range_rows * 10000) AS BIGINT) END', 2)} ELSE 0.0 END AS factor_of_value FROM old_rep""",
    "acc_topn": _topn(),
    "acc_repro": _stale + f"""SELECT stepnumber, CASE WHEN eq_rows <> actual_eq_rows THEN 'SELECT count(*) FROM orders WHERE o_custkey = ''' || range_hi_key || '''' || {_tail('eq_rows', 'actual_eq_rows')} ELSE '' END AS eq_query,
      CASE WHEN range_rows <> actual_range_rows THEN 'SELECT count(*) FROM orders WHERE o_custkey > ''' || previous_range_hi_key || ''' AND o_custkey < ''' || range_hi_key || '''' || {_tail('range_rows', 'actual_range_rows')} ELSE '' END AS range_query,
      CASE WHEN value_with_biggest_diff IS NOT NULL AND CAST(floor(avg_range_rows) AS BIGINT) <> actual_rows_for_value THEN 'SELECT count(*) FROM orders WHERE o_custkey = ''' || value_with_biggest_diff || '''' || {_tail('CAST(floor(avg_range_rows) AS BIGINT)', 'actual_rows_for_value')} ELSE '' END AS value_query FROM old_rep""",
}
