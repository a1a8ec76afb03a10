"""Registered queries of the query log and of plan documents, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plandoc as pd
from ..operators import querylog as ql
from ..session import spread
from ..sources.tables import read_named
from .oracle_base import ratio
from .plan_fixture import plan_documents


def query_log(spark, sf):
    """Events read as executions."""
    k = F.get_json_object("props", "$.k").cast("long")
    return read_named(spark, sf, "events").select(
        F.col("event_type").alias("query_hash"), F.pmod("user_id", F.lit(5)).cast("string").alias("plan_hash"),
        F.col("user_id").alias("plan_handle"), F.col("event_id").alias("id"), F.col("ts").alias("execution_time"),
        F.timestamp_add("SECOND", -(F.pmod("event_id", F.lit(7)) * 600).cast("int"), F.col("ts")).alias("creation_time"),
        F.floor(F.col("value") * 1000).cast("long").alias("cpu"), F.floor(F.col("value") * 1200).cast("long").alias("elapsed"),
        k.alias("reads"), F.pmod("user_id", F.lit(10)).alias("writes"), (k * 3 + 1).alias("rows"),
    )


def valid_log(spark, sf):
    stubs = read_named(spark, sf, "customer").filter(F.pmod("c_custkey", F.lit(50)) == 3).select(F.col("c_custkey").alias("plan_handle"))
    return ql.valid_executions(query_log(spark, sf), stubs)


def by_user(valid):
    """The same log with one hash per user, for queries that need many hashes."""
    return valid.withColumn("query_hash", F.concat(F.lit("u"), F.col("plan_handle").cast("string")))


def log_delta(spark, sf):
    log = query_log(spark, sf)
    at = lambda t: log.filter(F.col("execution_time") <= F.lit(t).cast("timestamp_ntz")).groupBy("plan_handle").agg(F.count(F.lit(1)).alias("execution_count"))
    return ql.counter_delta(at("2024-01-03"), at("2024-01-29"), "plan_handle", "execution_count")


def log_counter_growth(spark, sf):
    """Readings of a counter per session that falls back to nothing every hour."""
    readings = read_named(spark, sf, "events").withColumn("reading", F.minute("ts") * 60 + F.second("ts"))
    return ql.counter_growth(readings, "user_id", "ts", "reading").withColumnRenamed("key", "user_id")


def row_rollup(spark, sf):
    """Lines per supplier and year read as the rows of one execution."""
    runs = read_named(spark, sf, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y"), "l_linenumber").agg(F.count(F.lit(1)).alias("rows"))
    g = runs.groupBy(F.col("l_suppkey").alias("query_hash")).agg(
        F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"), F.sum("rows").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("query_hash", "min_rows", "max_rows", F.call_function("div", "s", "n").alias("avg_rows"))


def log_size_band(spark, sf):
    mb = F.col("n_chars") / 1000.0
    return read_named(spark, sf, "documents").select("doc_id", ql.size_band(mb).alias("plan_size_status"))


def text_clean(spark, sf):
    raw = F.translate("text", "\n ", "\x07\x1e")
    start = (F.pmod("doc_id", F.lit(50)) * 2).cast("long")
    end = F.when(F.pmod("doc_id", F.lit(4)) == 0, start - 10).when(F.pmod("doc_id", F.lit(4)) == 1, start + 400_000).otherwise(start + 80)
    d = spread(read_named(spark, sf, "documents")).select("doc_id", ql.clean_text(raw).alias("clean"), start.alias("a"), end.alias("b"))
    return d.select("doc_id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("clean_chars"),
                    F.md5(ql.cut_statement(F.col("clean"), F.col("a"), F.col("b"))).alias("statement_md5"))


def log_asof_forward(spark, sf):
    ev = read_named(spark, sf, "events")
    plans = ev.filter("event_type = 'error'").select(
        F.col("event_id").alias("plan_id"), F.col("ts").alias("start_time"), F.floor(F.col("value") * 100_000).cast("long").alias("compile_ms"),
        F.concat(F.lit("plan uses stat_"), F.pmod("user_id", F.lit(3)).cast("string")).alias("plan_text"))
    updates = ev.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("update_id"), F.concat(F.lit("stat_"), F.pmod("user_id", F.lit(3)).cast("string")).alias("name"), F.col("ts").alias("updated"))
    return ql.slow_with_update(plans, updates)


def log_call_rate(spark, sf):
    plans = query_log(spark, sf).filter("query_hash = 'signup'").groupBy("plan_hash").agg(
        F.count(F.lit(1)).alias("execution_count"), F.min("creation_time").alias("creation_time"), F.max("execution_time").alias("last_execution_time"))
    return ql.call_rate(plans)


QUERIES = {
    "log_totals": lambda s, sf: ql.log_totals(valid_log(s, sf)),
    "log_rollup": lambda s, sf: ql.log_rollup(valid_log(s, sf)),
    "log_metrics": lambda s, sf: ql.log_metrics(by_user(valid_log(s, sf))),
    "log_top": lambda s, sf: ql.log_top(ql.log_metrics(by_user(valid_log(s, sf))), 20).select("query_hash", "query_impact", "executions"),
    "log_delta": log_delta,
    "log_counter_growth": log_counter_growth,
    "log_variance": lambda s, sf: ql.row_variance(row_rollup(s, sf), rows=10),
    "log_size_band": log_size_band,
    "text_clean": text_clean,
    "log_asof_forward": log_asof_forward,
    "log_call_rate": log_call_rate,
    "plan_scalars": lambda s, sf: pd.plan_scalars(plan_documents(s, sf)),
    "plan_flags": lambda s, sf: pd.plan_flags(plan_documents(s, sf)),
    "plan_list": lambda s, sf: pd.plan_stats(plan_documents(s, sf)),
    "plan_lookup": lambda s, sf: pd.lookup_comments(plan_documents(s, sf)),
    "plan_distinct": lambda s, sf: pd.plans_with_distinct(plan_documents(s, sf)),
    "plan_many_refs": lambda s, sf: pd.many_stats(plan_documents(s, sf), 4),
    "plan_stale_refs": lambda s, sf: pd.stale_refs(plan_documents(s, sf), 1000),
}

LOG = """lg AS (SELECT event_type AS query_hash, CAST(user_id % 5 AS VARCHAR) AS plan_hash, user_id AS plan_handle, event_id AS id, ts AS execution_time,
  ts - (event_id % 7 * 600) * INTERVAL 1 SECOND AS creation_time, CAST(floor(value * 1000) AS BIGINT) AS cpu, CAST(floor(value * 1200) AS BIGINT) AS elapsed,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS reads, user_id % 10 AS writes, CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 + 1 AS rows FROM events),
valid AS (SELECT * FROM lg WHERE cpu > 0 AND plan_hash <> '0' AND plan_handle NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 3))"""
M = ["cpu", "elapsed", "reads", "writes", "rows"]


def _roll(hash_: str) -> str:
    sums = ", ".join(f"CAST(sum({m}) AS BIGINT) AS total_{m}, min({m}) AS min_{m}, max({m}) AS max_{m}" for m in M)
    last = ", ".join(f"{m} AS last_{m}" for m in M)
    return f"""vh AS (SELECT * REPLACE ({hash_} AS query_hash) FROM valid),
ro AS (SELECT query_hash, count(DISTINCT plan_hash) AS plan_count, count(*) AS executions, {sums} FROM vh GROUP BY 1),
la AS (SELECT query_hash, plan_hash AS last_plan_hash, creation_time, execution_time AS last_execution_time, {last} FROM vh
  QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY execution_time DESC, id DESC) = 1),
roll AS (SELECT * FROM ro JOIN la USING (query_hash)),
tot AS (SELECT count(*) AS t_executions, {', '.join(f'CAST(sum({m}) AS BIGINT) AS t_{m}' for m in M)} FROM valid)"""


def _metrics() -> str:
    sec = lambda c: ratio(c, "1000000", 4)
    gb = lambda c: ratio(f"({c}) * 8", "1048576", 4)
    share = lambda a, t: f"CASE WHEN {t} = 0 THEN 0.0 ELSE {ratio(a, t, 2, 100)} END"
    mins = "date_diff('minute', creation_time, last_execution_time)"
    cols = ["query_hash", "plan_count", "creation_time", "last_execution_time", "round(ln(total_cpu * 3 + total_reads + total_writes), 2) AS query_impact", "executions",
            f"{share('executions', 't_executions')} AS executions_percent", f"executions // (CASE WHEN {mins} = 0 THEN 1 ELSE {mins} END) AS executions_per_minute",
            "CASE WHEN executions = 1 THEN date_sub('millisecond', creation_time, last_execution_time) END AS compile_ms"]
    for m in ("elapsed", "cpu"):
        cols += [f"{sec(f'total_{m}')} AS total_{m}_sec", f"{share(f'total_{m}', f't_{m}')} AS {m}_percent", f"{sec(f'total_{m} // executions')} AS avg_{m}_sec",
                 f"{sec(f'min_{m}')} AS min_{m}_sec", f"{sec(f'max_{m}')} AS max_{m}_sec", f"{sec(f'last_{m}')} AS last_{m}_sec"]
    for m in ("reads", "writes"):
        cols += [f"total_{m}", f"{share(f'total_{m}', f't_{m}')} AS {m}_percent", f"total_{m} // executions AS avg_{m}", f"min_{m}", f"max_{m}", f"last_{m}",
                 f"{gb(f'total_{m}')} AS total_{m}_gb", f"{gb(f'total_{m} // executions')} AS avg_{m}_gb"]
    return "SELECT " + ", ".join(cols) + ", total_rows, total_rows // executions AS avg_rows, min_rows, max_rows, last_rows FROM roll, tot"


_user = "'u' || CAST(plan_handle AS VARCHAR)"
O = """o AS (SELECT *, o_orderkey AS k, o_custkey AS c, o_orderkey % 97 <> 0 AS good FROM orders)"""
_op = "['Hash Match', 'Sort', 'Merge Join', 'Table Spool', 'Index Spool', 'Remote Query', 'Table Scan'][k % 7 + 1]"
_maxrows = "greatest(c % 10, k % 1000, k % 300)"
_mods = "(c % 5 + 1) * (c % 1000)"


def _g(expr: str) -> str:
    return f"CASE WHEN good THEN {expr} END"


FLAG_SQL = {
    "has_nested_loop_join": "TRUE", "has_merge_join": "k % 7 = 2", "has_hash_join": "k % 7 = 0", "has_spilling_operators": "k % 7 <= 1",
    "has_remote_operators": "k % 7 = 5", "has_spool_operators": "k % 7 IN (3, 4)", "has_index_spool_operators": "k % 7 = 4", "has_table_scan_on_heap": "k % 7 = 6",
    "has_table_valued_functions": "FALSE", "has_serial_ordered_backward_scan": "c % 6 = 0", "has_implicit_conversion_warning": "k % 6 = 0",
    "has_no_join_predicate_warning": "c % 8 = 0", "has_many_to_many_merge_join": "k % 7 = 2 AND c % 2 = 1", "has_join_residual_predicate": "k % 7 = 0 AND c % 3 = 0",
    "has_index_seek_residual_predicate": "k % 11 = 0", "has_key_or_rid_lookup": "o_orderstatus = 'F'", "has_user_defined_function": "c % 12 = 0",
    "has_partitioned_tables": "k % 13 = 0", "has_min_max_agg": "c % 10 <= 1", "is_prefetch_enabled": "c % 3 = 1", "is_parameterized": "c % 4 = 0", "is_parallel": "c % 2 = 1",
    "is_using_table_variable": "FALSE",
}

ORACLES = {
    "log_totals": f"WITH {LOG} SELECT count(*) AS executions, {', '.join(f'CAST(sum({m}) AS BIGINT) AS total_{m}' for m in M)} FROM valid",
    "log_rollup": f"WITH {LOG}, {_roll('query_hash')} SELECT * FROM roll",
    "log_metrics": f"WITH {LOG}, {_roll(_user)} {_metrics()}",
    "log_top": f"WITH {LOG}, {_roll(_user)} SELECT query_hash, round(ln(total_cpu * 3 + total_reads + total_writes), 2) AS query_impact, executions FROM roll ORDER BY 2 DESC, 1 LIMIT 20",
    "log_delta": f"""WITH {LOG} SELECT plan_handle, count(*) FILTER (WHERE execution_time <= TIMESTAMP '2024-01-03') AS before, count(*) AS after,
      count(*) - count(*) FILTER (WHERE execution_time <= TIMESTAMP '2024-01-03') AS delta FROM lg WHERE execution_time <= TIMESTAMP '2024-01-29' GROUP BY 1""",
    "log_counter_growth": """WITH o AS (SELECT user_id, ts, c, lag(c) OVER (PARTITION BY user_id ORDER BY ts, c) AS old FROM
      (SELECT user_id, ts, minute(ts) * 60 + second(ts) AS c FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL))
      SELECT user_id, max(ts) AS last_ts, max_by(c, row(ts, c)) AS last, count(*) AS readings, count(*) FILTER (WHERE c < old) AS resets,
        CAST(sum(CASE WHEN old IS NULL OR c < old THEN c ELSE c - old END) AS BIGINT) AS grown FROM o GROUP BY 1""",
    "log_variance": """SELECT *, (min_rows + max_rows) // 2 >= 10 AND (min_rows * 100 < avg_rows * 70 OR max_rows * 100 > avg_rows * 130) AS has_unstable_rows FROM (
      SELECT l_suppkey AS query_hash, min(n) AS min_rows, max(n) AS max_rows, CAST(sum(n) // count(*) AS BIGINT) AS avg_rows FROM (
      SELECT l_suppkey, year(l_shipdate) AS y, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1)""",
    "log_size_band": """SELECT doc_id, CASE WHEN n_chars >= 20000 THEN 'Gigantic plan (20MB or more)' WHEN n_chars >= 15000 THEN 'Enormous plan (15MB or more)'
      WHEN n_chars >= 10000 THEN 'Colossal plan (10MB or more)' WHEN n_chars >= 5000 THEN 'Huge plan (5MB or more)' WHEN n_chars >= 2000 THEN 'Big plan (2MB or more)'
      ELSE 'Normal plan (less than 2MB)' END AS plan_size_status FROM documents""",
    "text_clean": """WITH t AS (SELECT doc_id, regexp_replace(replace(translate(text, chr(10) || ' ', chr(7) || chr(30)), chr(0), ''), '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '?', 'g') AS clean,
        doc_id % 50 * 2 AS a, CASE doc_id % 4 WHEN 0 THEN doc_id % 50 * 2 - 10 WHEN 1 THEN doc_id % 50 * 2 + 400000 ELSE doc_id % 50 * 2 + 80 END AS b FROM documents)
      SELECT doc_id, md5(clean) AS clean_md5, length(clean) AS clean_chars, md5(coalesce(nullif(substring(clean, a // 2 + 1, CASE WHEN b < a THEN 0 ELSE (b - a) // 2 END + 2), ''), clean)) AS statement_md5 FROM t""",
    "log_asof_forward": """WITH p AS (SELECT event_id AS plan_id, ts AS start_time, CAST(floor(value * 100000) AS BIGINT) AS compile_ms, 'plan uses stat_' || user_id % 3 AS plan_text FROM events WHERE event_type = 'error'),
      u AS (SELECT event_id AS update_id, 'stat_' || user_id % 3 AS name, ts AS updated FROM events WHERE event_type = 'purchase'),
      j AS (SELECT p.*, u.* FROM p ASOF JOIN u ON p.start_time <= u.updated WHERE compile_ms >= 200)
      SELECT plan_id, start_time, compile_ms, name AS associated_stats_name, updated AS associated_update FROM j
      WHERE updated <= start_time + (compile_ms + 50) * INTERVAL 1 MILLISECOND AND contains(plan_text, name)""",
    "log_call_rate": f"""WITH {LOG}, g AS (SELECT plan_hash, count(*) AS n, min(creation_time) AS a, max(execution_time) AS b FROM lg WHERE query_hash = 'signup' GROUP BY 1)
      SELECT max(n) AS total_execution_count, {ratio('max(n)', "date_diff('minute', min(a), max(b))", 2)} AS executions_per_minute FROM g""",
    "plan_scalars": f"""WITH {O} SELECT k AS plan_id, o_orderpriority || '/' || o_orderstatus AS query_hash, good AS is_readable, {_g("CASE WHEN k % 4 = 0 THEN 'COND' ELSE 'SELECT' END")} AS statement_type,
      {_g('70 + c % 2 * 80')} AS ce_model_version, {_g("CASE WHEN k % 5 = 0 THEN 'TimeOut' END")} AS early_abort_reason, {_g('CAST(c % 100 AS DOUBLE) + 0.5')} AS query_plan_cost,
      {_g('round(CAST(c % 512 AS DOUBLE) / 1024, 4)')} AS statement_cached_plan_size_mb, {_g('round(CAST(k % 400 AS DOUBLE) / 1000, 4)')} AS compile_time_sec,
      {_g('round(CAST(k % 50 AS DOUBLE) / 1000, 4)')} AS compile_cpu_sec, {_g('round(CAST(c % 2048 AS DOUBLE) / 1024, 4)')} AS serial_desired_memory_mb,
      {_g('round(CAST(k % 128 AS DOUBLE) / 1024, 4)')} AS compile_memory_mb, {_g('round(CAST(c % 512 AS DOUBLE) / 1024, 4)')} AS serial_required_memory_mb,
      {_g('CASE WHEN k % 9 = 0 THEN 2 ELSE 0 END')} AS missing_index_count, {_g('CASE WHEN k % 6 = 0 THEN 2 ELSE 0 END')} AS warning_count,
      {_g(f'CAST({_maxrows} AS DOUBLE)')} AS operator_max_estimated_rows, {_g(f'CAST({_mods} AS DOUBLE)')} AS sum_modification_count FROM o""",
    "plan_flags": f"WITH {O} SELECT k AS plan_id, {', '.join(f'{_g(v)} AS {n}' for n, v in FLAG_SQL.items())} FROM o",
    "plan_list": f"""WITH {O} SELECT k AS plan_id, o_orderpriority || '/' || o_orderstatus AS query_hash,
      {_g("array_to_string(list_transform(range(0, c % 5 + 1), lambda i: 'd''b.dbo.t' || i || '.s>' || c % 7), ',')")} AS stats_list, CASE WHEN good THEN c % 5 + 1 ELSE 0 END AS number_of_referenced_stats,
      {_g("'db.dbo.t1.ix_' || k % 3 || CASE WHEN o_orderstatus = 'F' THEN ',db.dbo.t1.pk' ELSE '' END")} AS index_list,
      CASE WHEN NOT good THEN 0 WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS number_of_referenced_indexes FROM o""",
    "plan_lookup": f"""WITH {O} SELECT k AS plan_id, CASE WHEN c % 2 = 0 THEN 'Row lookup on t1' ELSE 'Key lookup on t1.pk' END || ' because column(s) (a) are missing on index t1.ix_' || k % 3 AS lookup_comment
      FROM o WHERE good AND o_orderstatus = 'F'""",
    "plan_distinct": f"""WITH {O} SELECT k AS plan_id, round(ln(o_totalprice), 2) AS query_impact, CASE WHEN k % 7 = 0 THEN 'h1' ELSE array_to_string(list_transform(range(1, c % 4 + 2), lambda i: 'c' || i), ', ') END AS referenced_columns,
      CASE WHEN k % 7 = 0 THEN 1 ELSE c % 4 + 1 END AS cnt_referenced_columns FROM o WHERE good AND k % 7 <= 1 AND c % 3 = 0""",
    "plan_many_refs": f"WITH {O} SELECT k AS plan_id, c % 5 + 1 AS number_of_referenced_stats FROM o WHERE good AND c % 5 + 1 >= 4",
    "plan_stale_refs": f"WITH {O} SELECT k AS plan_id, CAST({_mods} AS DOUBLE) AS sum_modification_count FROM o WHERE good AND {_mods} >= 1000",
}
