"""Steps that must hold little per task, read little or search little, whatever the size of the tables."""

import itertools
import re

from pyspark.sql import functions as F

from tablegauge.llm import mixing
from tablegauge.operators import accuracy, collect, histogram, plandoc, sketches, texts
from tablegauge.sources.definitions import StatDef, TableDef


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_value_counts_are_dealt_by_their_number(spark, monkeypatch):
    df = spark.range(6000).select((F.col("id") % 5000).alias("k"))
    whole = histogram.histogram(df, "k").collect()
    monkeypatch.setattr(histogram, "KEYS_AT_ONCE", 500)
    counts = histogram.written_counts(histogram.value_counts(df, "k").selectExpr("0 AS rowid", f"{histogram.key_sql('key', df.schema['k'].dataType)} AS hi", "cnt AS s1"), ["hi"])
    held = [r.n for r in counts.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(held) == 10 and max(held) < 2000
    assert histogram.histogram(df, "k").collect() == whole


def test_rows_are_counted_before_they_are_multiplied(spark):
    table = TableDef("t", "db", "2024-01-09", ("2024-01-05", "2024-01-03"), "ts")
    stats = [StatDef(1, "t", "a", ("k",), "User_Created"), StatDef(2, "t", "b", ("k", "v"), "User_Created", filter="v > 1"),
             StatDef(3, "t", "c", ("k",), "User_Created", sample_pct=50), StatDef(4, "t", "d", ("v",), "User_Created")]
    df = spark.sql("""SELECT * FROM VALUES (1L, 1.0D, TIMESTAMP_NTZ'2024-01-01'), (1L, 2.0D, TIMESTAMP_NTZ'2024-01-04'), (1L, 2.0D, TIMESTAMP_NTZ'2024-01-08'),
        (70L, 1.0D, NULL), (NULL, NULL, TIMESTAMP_NTZ'2024-01-02') AS t(k, v, ts)""")
    found = collect.key_counts(df, table, stats)
    plan = _plan(found)
    assert plan.index("Generate") < plan.index("Aggregate") and "Generate" not in plan[plan.rindex("Aggregate"):]
    got = {(r.rowid, r.hi.l, r.hi.f): (r.s1, r.s2, r.f0, r.f1, r.f2, r.key_bytes) for r in found.collect()}
    assert got == {
        (1, 1, None): (2, 1, 3, 2, 1, 8), (1, 70, None): (1, 1, 1, 1, 1, 8), (1, None, None): (1, 1, 1, 1, 1, 0),
        (2, 1, None): (1, 0, 2, 1, 0, 8),
        (3, 1, None): (2, 1, 3, 2, 1, 8), (3, 70, None): (0, 0, 1, 1, 1, 8), (3, None, None): (0, 0, 1, 1, 1, 0),
        (4, None, 1.0): (2, 2, 2, 2, 2, 8), (4, None, 2.0): (1, 0, 2, 1, 0, 8), (4, None, None): (1, 1, 1, 1, 1, 0)}
    sizes = collect.prefix_sizes(df, table, stats)
    assert "Generate" not in _plan(sizes)
    assert [(r.rowid, r.n, r.distinct_values, r.average_length, r.rows_sampled) for r in sizes.collect()] == [(2, 2, 1, 16.0, 1)]


def test_a_full_count_is_dealt_out_without_frequent_values(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") + 10).alias("k")).unionByName(spark.range(9_000).select(F.lit(1).cast("long").alias("k"))).unionByName(
        spark.range(700).select(F.lit(None).cast("long").alias("k")))
    seen, plain = [], sketches.value_counts
    monkeypatch.setattr(sketches, "value_counts", lambda d, k: seen.append(d) or plain(d, k))
    monkeypatch.setattr(sketches, "ROWS_AT_ONCE", 2_000, raising=False)
    assert sketches.heavy_hitters(df, "k", 10, 500).collect() == accuracy.top_values(df, "k", 10).collect()
    others = seen[1]
    assert others.filter("key = 1 OR key IS NULL").count() == 0
    assert others.rdd.getNumPartitions() == -(-others.count() // 2_000) > 5


def test_few_keywords_need_no_letter_groups(spark):
    body = spark.createDataFrame([(1, "a license here"), (2, None), (3, "copyright, licensed"), (4, "none")], "id int, body string")
    few = spark.createDataFrame([("License",), ("copyright",), ("",)], "keyword string")
    found = texts._with_keywords(body, few)
    assert "regexp_extract_all" not in _plan(found)
    assert sorted((r.id, r.keyword) for r in found.collect()) == [(1, "license"), (3, "copyright"), (3, "license")]


def test_second_corpus_is_searched_once(spark):
    a = spark.createDataFrame([(1, "license of alpha"), (2, "beta")], "id int, text string")
    found = texts.keyword_two_hops(a, "id", "text", F.regexp_extract("text", "(alpha|beta)", 1), ["license"], a, "id", "text")
    assert "contains(" not in _plan(found).lower()
    assert sorted((r.found_in, r.command_found) for r in found.collect()) == [("1", "alpha"), ("1", "license")]


def _distinct(op: str) -> str:
    return f"<p><RelOp {op}><Sort><OrderBy><OrderByColumn><ColumnReference Column='c'/></OrderByColumn></OrderBy></Sort></RelOp></p>"


def test_only_documents_that_may_hold_the_operator_are_read(spark):
    ops = ['LogicalOp="Distinct Sort"', "LogicalOp='Distinct&#32;Sort'", "LogicalOp = 'D&#x69;stinct\nSort'", 'LogicalOp="Sort" Note="Distinct Sort"', 'LogicalOp="Flow Distinct"']
    plans = spark.createDataFrame([(i, float(-i), _distinct(op)) for i, op in enumerate(ops)] + [(8, 0.0, None), (9, 0.0, _distinct(ops[0]) + "<broken")], "plan_id int, query_impact double, plan_doc string")
    found = plandoc.plans_with_distinct(plans)
    assert "rlike" in _plan(found).lower()
    assert [(r.plan_id, r.referenced_columns) for r in found.collect()] == [(0, "c"), (1, "c"), (2, "c"), (4, "")]


def test_reader_keeps_what_is_looked_at():
    doc = "<a x='1' y='2'><b><c x='3'/></b><c x='4' z='5'/></a>"
    reader = plandoc._Reader(frozenset({"a", "c"}), frozenset({"x"}))
    reader.read(doc)
    reader.read("<a><c></a>")
    rows = reader.array().to_pylist()
    assert [(n["name"], n["parent"], n["last"], n["attrs"]) for n in rows[0]] == [("a", -1, 2, [("x", "1")]), ("c", -1, 1, [("x", "3")]), ("c", 0, 2, [("x", "4")])]
    assert rows[1] is None


def test_single_figures_leave_the_reader_without_elements(spark):
    docs = [
        "<S><StmtSimple StatementType='' StatementSubTreeCost='1.5'><QueryPlan CachedPlanSize='1e3' CompileTime='x'/><QueryPlan CachedPlanSize='24' CompileTime='nan'/></StmtSimple>"
        "<StmtSimple StatementType='SECOND' StatementOptmEarlyAbortReason='TimeOut'/><StmtCond StatementType='COND' StatementSubTreeCost='7'/></S>",
        "<S><StmtSimple/><T><StmtSimple StatementType='ELSEWHERE'/></T></S>",
        "<Warnings><a/></Warnings><QueryPlan><Warnings><b><c/></b><RelOp EstimateRows='5'/></Warnings><Warnings/><d><Warnings><e/></Warnings></d></QueryPlan>",
        "<OptimizerStatsUsage><StatisticsInfo ModificationCount='6e+02'/><x><StatisticsInfo ModificationCount='9'/></x></OptimizerStatsUsage>"
        "<MissingIndexGroup/><!-- <RelOp EstimateRows='99'/> --><RelOp EstimateRows=' 3 '/><RelOp EstimateRows='NaN'/><StatisticsInfo ModificationCount='9'/>",
        "<RelOp EstimateRows='1'/><QueryPlan CompileTime='8'><MissingIndexGroup/>", None]
    found = plandoc.plan_scalars(spark.createDataFrame([(i, "h", d) for i, d in enumerate(docs)], "plan_id int, query_hash string, plan_doc string").coalesce(1))
    assert "nodes" not in _plan(found) and "plandoc_root" not in _plan(found)
    rows = [r.asDict() for r in found.orderBy("plan_id").collect()]
    assert [(r["statement_type"], r["query_plan_cost"], r["early_abort_reason"]) for r in rows] == [("COND", 1.5, None), ("ELSEWHERE", None, None), *[(None, None, None)] * 4]
    assert (rows[0]["statement_cached_plan_size_mb"], rows[0]["compile_time_sec"]) == (1.0, 0.0)
    assert [(r["warning_count"], r["missing_index_count"], r["operator_max_estimated_rows"], r["sum_modification_count"]) for r in rows] == [
        (0, 0, None, 0.0), (0, 0, None, 0.0), (2, 0, 5.0, 0.0), (0, 1, 3.0, 600.0), *[(None, None, None, None)] * 2]
    assert [r["is_readable"] for r in rows] == [True, True, True, True, False, False]


def _used(inside: str, name: str = "OptimizerStatsUsage") -> str:
    return f"<{name}>{inside}</{name}>"


def _info(n, text: str = "") -> str:
    return f'<StatisticsInfo Table="t{n}" Statistics="s" ModificationCount="{n}">{text}</StatisticsInfo>'


def test_statistics_of_plans_leave_the_reader_as_figures(spark):
    a, b, c = _info(400), _info("6e2"), _info(5)
    docs = [
        f"<P>{_used(a + b)}<RelOp/>{_used(c)}</P>", _used(a + _used(b) + c), f"<P>{_used(a)}<x>{b}</x></P>", _used(a + f"<x>{b}</x>"),
        f"<P><!-- {_used(b)} -->{_used(a)}</P>", _used(a + f"<![CDATA[</OptimizerStatsUsage>{b}]]>" + c + b), f"<OptimizerStatsUsage/><P>{_used(a + b, 'OptimizerStatsUsageOf')}{_used(c)}</P>",
        f"<OptimizerStatsUsage>{a}{_used(c)}{b}<OptimizerStatsUsage/>{b}</OptimizerStatsUsage>", f"<P>{_used(a + b)}</Q>", f"<P>{_used(a + b)}", None, _used(_info("&#49;e3") + a + a),
        "<?xml version='1.0'?>" + _used(_info("nan") + _info("x") + b + b)]
    plans = spark.createDataFrame([(i, "h", d) for i, d in enumerate(docs)], "plan_id int, query_hash string, plan_doc string").coalesce(1)
    stale = {0: 1005.0, 1: 1005.0, 5: 1005.0, 7: 1605.0, 11: 1800.0, 12: 1200.0}
    assert {r.plan_id: r.sum_modification_count for r in plandoc.stale_refs(plans, 1000).collect()} == stale
    every = {**stale, 2: 400.0, 3: 400.0, 4: 400.0, 6: 5.0}
    assert {r.plan_id: r.sum_modification_count for r in plandoc.stale_refs(plans, 0).collect()} == every
    names = {0: 3, 1: 3, 2: 1, 3: 2, 4: 1, 5: 3, 6: 1, 7: 3, 8: 0, 9: 0, 10: 0, 11: 2, 12: 3}
    for n in (0, 1, 3):
        assert {r.plan_id: r.number_of_referenced_stats for r in plandoc.many_stats(plans, n).collect()} == {i: k for i, k in names.items() if k >= n}
    # no lists of elements, and a document that is made is made once
    made = plans.withColumn("plan_doc", F.concat("plan_doc", F.lit("<made/>")))
    for found in (plandoc.stale_refs(made), plandoc.many_stats(made)):
        assert "nodes" not in _plan(found) and _plan(found).count("<made/>") == 1


def test_topics_are_plain_texts(spark):
    texts_of = ["License", "licenCe", "LICENSE", "a | b", "a|b", "x@y", "Copyright!!", "copyrigh", "lice\nnse", "Hi!!", ""]
    df = spark.createDataFrame([(t,) for t in texts_of], "t string")
    named = df.select("t", mixing.topic_of(F.col("t")).alias("topic"))
    assert "rlike" not in _plan(named).lower()
    want = {t: next((n for n, p in mixing.TOPICS.items() if re.search(p, t)), "prose") for t in texts_of}
    assert {r.t: r.topic for r in named.collect()} == want
    for p in mixing.TOPICS.values():
        parts = mixing.written_out(p)
        assert len(parts) == len(set(parts)) and all(re.fullmatch(p, s) for s in itertools.chain(parts))
