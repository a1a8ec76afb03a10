"""Registered queries on events and texts, the report and the streams, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks_events as ev
from ..operators import report as rep
from ..operators import texts as tx
from ..session import scratch_path, spread
from ..sources.tables import read_named
from ..streaming.rates import file_stream, hourly_updates, modification_rate, run_counter_growth, run_to_table
from . import queries_catalogue, queries_collect, queries_histogram, queries_history, queries_log
from .fixture import STAT_DEFS, collected
from .oracle_base import with_collected
from .queries_catalogue import N
from .queries_collect import event_log

CLOCK = "2024-01-31 00:00:00"
COLLECTED_AT = "2024-01-31 02:00:00"
KINDS = ["click", "error", "purchase", "signup", "view"]
OBJECTS = ["license", "the", "que"]


def chk04_nearest_event(spark, sf):
    events = event_log(spark, sf).filter("event_name = 'error'").withColumn("start_time", F.date_trunc("hour", "start_time").cast("timestamp_ntz"))
    return ev.check_nearest_event(collected(spark, sf), events, rows=1000)


def chk39_events(spark, sf):
    return ev.check_events(event_log(spark, sf), "error", ["db0"], ['{"k": 1}'], "9")


def chk22_phrase(spark, sf):
    return tx.texts_with_phrase(spread(read_named(spark, sf, "documents")), "text", "LICENSE").select("doc_id", "lang", "source")


def chk17_name_without_word(spark, sf):
    names = spark.createDataFrame([(n,) for n in OBJECTS], "keyword string")
    return tx.names_without_word(spread(read_named(spark, sf, "documents")), "doc_id", "text", names, "and")


def chk43_keyword_2hop(spark, sf):
    docs = spread(read_named(spark, sf, "documents"))
    talk = spread(read_named(spark, sf, "conversations")).withColumn("place", F.concat_ws("/", "conv_id", "turn"))
    first_word = F.regexp_extract(F.lower("text"), "([a-z]{4,})", 1)
    return tx.keyword_two_hops(docs, "doc_id", "text", first_word, ["license", "copyright"], talk, "place", "text")


def chk51_busy_window(spark, sf):
    return ev.busy_window(read_named(spark, sf, "events"), "ts", CLOCK)


def rep_after_window(spark, sf):
    return rep.collected_after_window(chk51_busy_window(spark, sf), COLLECTED_AT)


def prim_pivot(spark, sf):
    return ev.pivot_counts(read_named(spark, sf, "events"), "user_id", "event_type", KINDS)


def _checks(spark, sf):
    """The results the summary counts on."""
    every = {**queries_collect.QUERIES, **queries_catalogue.QUERIES, **queries_history.QUERIES, **queries_histogram.QUERIES, **queries_log.QUERIES, **QUERIES}
    out = {k: (lambda k=k: every[k](spark, sf)) for k in dict.fromkeys(m.check for m in rep.METRICS)}
    out["stat"] = lambda: collected(spark, sf)["stat"]
    out["chk51_busy_window"] = lambda: rep_after_window(spark, sf)
    return out


def rep_summary(spark, sf):
    stat = collected(spark, sf)["stat"]  # once, before checks that share it run side by side
    if gone := {s.rowid: s.name for s in STAT_DEFS if s.rowid not in {r.rowid for r in stat.select("rowid").collect()}}:
        raise rep.ChecksFailed(f"statistics not collected: {', '.join(gone.values())}")
    results, _ = rep.run_all(_checks(spark, sf), scratch_path(spark, "checks"))
    return rep.summary(results)


def rep_priority(spark, sf):
    return rep.priority_counts(rep_summary(spark, sf))


def stream_mod_rate(spark, sf):
    return run_to_table(modification_rate(file_stream(spark, sf, "events"), "ts", "event_type"), "mod-rate")


def stream_busy_hours(spark, sf):
    return run_to_table(hourly_updates(file_stream(spark, sf, "events"), "ts"), "busy-hours")


def stream_counter_growth(spark, sf):
    """Readings of a counter per user that starts anew every day."""
    readings = file_stream(spark, sf, "events").withColumn("counter", F.hour("ts") * 60 + F.minute("ts"))
    return run_counter_growth(readings, "user_id", "ts", "counter", "counter-growth").withColumnRenamed("key", "user_id")


QUERIES = {
    "chk04_nearest_event": chk04_nearest_event, "chk39_events": chk39_events, "chk22_phrase": chk22_phrase,
    "chk17_name_without_word": chk17_name_without_word, "chk43_keyword_2hop": chk43_keyword_2hop, "chk51_busy_window": chk51_busy_window,
    "rep_after_window": rep_after_window, "prim_pivot": prim_pivot, "rep_summary": rep_summary, "rep_priority": rep_priority,
    "stream_mod_rate": stream_mod_rate, "stream_busy_hours": stream_busy_hours,
    "stream_counter_growth": stream_counter_growth,
}

BUSY = """h AS (SELECT date_trunc('hour', ts) AS t, count(*) AS cnt FROM events WHERE ts >= TIMESTAMP '2023-12-31' AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1 HAVING count(*) > 5),
r AS (SELECT t, cnt, row_number() OVER (ORDER BY t) AS rn, CAST(sum(cnt) OVER () AS BIGINT) // count(*) OVER () AS mean FROM h),
f AS (SELECT *, rn - row_number() OVER (ORDER BY t) AS run FROM r WHERE cnt > mean),
bw AS (SELECT min(t) AS start_datetime, max(t) AS end_datetime, date_diff('hour', min(t), max(t)) + 1 AS number_of_hours, CAST(sum(cnt) AS BIGINT) AS number_of_updates,
  (SELECT max(t) FROM f) AS max_end_datetime FROM f GROUP BY run ORDER BY 4 DESC, 1 LIMIT 1)"""
_after = f"WITH {BUSY} SELECT max_end_datetime, date_sub('hour', max_end_datetime, TIMESTAMP '{COLLECTED_AT}') AS hours_after_window, date_sub('hour', max_end_datetime, TIMESTAMP '{COLLECTED_AT}') <= 4 AS after_window FROM bw"
_diff = "date_diff('millisecond', st, last_updated)"
_objs = ", ".join(f"('{o}')" for o in OBJECTS)

ORACLES = {
    "chk04_nearest_event": with_collected(f"""SELECT {N}, number_of_rows_at_time_stat_was_updated, number_of_statistic_data_available, last_updated, st AS closest_event, {_diff} AS diff_in_ms,
      CASE WHEN {_diff} BETWEEN 0 AND 10 THEN 'Event was VERY CLOSE (10 ms or less), most likely caused by the refresh' WHEN {_diff} BETWEEN 11 AND 50 THEN 'Event was CLOSE (11 to 50 ms), likely caused by the refresh'
        WHEN {_diff} BETWEEN 51 AND 100 THEN 'Event was CLOSE (51 to 100 ms), likely caused by the refresh' WHEN {_diff} BETWEEN 101 AND 500 THEN 'Event was NEAR (101 to 500 ms), likely caused by the refresh'
        WHEN number_of_rows_at_time_stat_was_updated >= 1000000 AND {_diff} BETWEEN 501 AND 20000 THEN 'Event was not close (501 to 20000 ms), but the table is large and may be the cause'
        ELSE 'Unlikely to be caused by the refresh' END AS comment_1,
      CASE WHEN cnt > 1 THEN 'Found ' || cnt || ' events at that time, the refresh may have run in parallel' END AS comment_2
      FROM (SELECT * FROM stat JOIN (SELECT rowid, count(*) AS number_of_statistic_data_available FROM history GROUP BY 1) USING (rowid)) s
      JOIN LATERAL (SELECT st, cnt FROM pt WHERE st <= s.last_updated ORDER BY st DESC LIMIT 1) ON TRUE WHERE number_of_rows_at_time_stat_was_updated >= 1000 OR is_lob""",
        "pt AS (SELECT date_trunc('hour', ts) AS st, count(*) AS cnt FROM events WHERE event_type = 'error' GROUP BY 1)"),
    "chk39_events": """SELECT user_id AS session_id, event_type AS event_name, 'db' || user_id % 3 AS database_name, props AS text_data, ts AS start_time FROM events
      WHERE event_type = 'error' AND user_id % 3 <> 0 AND props <> '{"k": 1}' AND props NOT LIKE '%9%'""",
    "chk22_phrase": "SELECT doc_id, lang, source FROM documents WHERE lower(text) LIKE '%license%'",
    "chk17_name_without_word": f"""SELECT doc_id, object_name, contains(lower(text), 'and') AS has_word, CASE WHEN contains(lower(text), 'and') THEN 'Information - The word and is there, check that it is in force'
      ELSE 'Warning - The object is named without and' END AS comment FROM documents JOIN (VALUES {_objs}) v(object_name) ON contains(lower(text), object_name)""",
    "chk43_keyword_2hop": """WITH k AS (SELECT unnest(['license', 'copyright']) AS kw), n AS (SELECT DISTINCT regexp_extract(lower(text), '([a-z]{4,})', 1) AS kw FROM documents JOIN k ON contains(lower(text), kw)),
      a AS (SELECT kw FROM k UNION SELECT kw FROM n WHERE kw <> '')
      SELECT conv_id || '/' || turn AS found_in, kw AS command_found, 'OK' AS comment FROM conversations JOIN a ON contains(lower(text), kw)""",
    "chk51_busy_window": f"WITH {BUSY} SELECT * FROM bw",
    "rep_after_window": _after,
    "prim_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1",
    "stream_mod_rate": "SELECT date_trunc('minute', ts) AS window_start, event_type AS key, count(*) AS changes FROM events GROUP BY ALL",
    "stream_counter_growth": """WITH r AS (SELECT user_id, ts, hour(ts) * 60 + minute(ts) AS c FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      o AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY ts, c) AS old FROM r)
      SELECT user_id, max(ts) AS last_ts, max_by(c, row(ts, c)) AS last, count(*) AS readings, count(*) FILTER (WHERE c < old) AS resets,
        CAST(sum(CASE WHEN old IS NULL OR c < old THEN c ELSE c - old END) AS BIGINT) AS grown, 0 AS late FROM o GROUP BY 1""",
    "stream_busy_hours": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS updates FROM events GROUP BY ALL",
}


def _summary_sql() -> str:
    every = {**queries_collect.ORACLES, **queries_catalogue.ORACLES, **queries_history.ORACLES, **queries_histogram.ORACLES, **queries_log.ORACLES, **ORACLES,
             "stat": with_collected("SELECT * FROM stat"), "chk51_busy_window": _after}
    parts = []
    for check in dict.fromkeys(m.check for m in rep.METRICS):
        mine = [m for m in rep.METRICS if m.check == check]
        figures = ", ".join(f"{rep.metric_sql(m)} AS m{i}" for i, m in enumerate(mine))
        names = [[m.info, m.priority, rep.check_label(m.check), m.fix] for m in mine]
        col = lambda j: "[" + ", ".join("'" + n[j] + "'" for n in names) + "]"
        parts.append(f"SELECT unnest({col(0)}) AS info, unnest([{', '.join(f'm{i}' for i in range(len(mine)))}]) AS result, unnest({col(1)}) AS priority, "
                     f"unnest({col(2)}) AS more_info, unnest({col(3)}) AS quick_fix FROM (SELECT {figures} FROM ({_behind(every[check])}))")
    return with_collected(" UNION ALL ".join(parts))


def _behind(sql: str) -> str:
    """A query without the collected tables in front of it, for use where they are already named."""
    head = with_collected("")[:-1]
    if not sql.startswith(head):
        return sql
    rest = sql[len(head):]
    return "WITH " + rest[2:] if rest.startswith(",\n") else rest


ORACLES["rep_summary"] = _summary_sql()
ORACLES["rep_priority"] = with_collected(f"SELECT priority, count(*) AS metrics FROM ({_behind(ORACLES['rep_summary'])}) WHERE priority <> 'NA' GROUP BY 1")
