import datetime
import random

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import plandoc
from tablegauge.operators.accuracy import accuracy_top
from tablegauge.operators.asof import asof_join
from tablegauge.operators.checks_catalogue import check_missing_multicol, reference_frame
from tablegauge.operators.checks_events import check_nearest_event
from tablegauge.operators.checks_history import check_cadence, check_hidden_ascending, check_steps_changed
from tablegauge.operators.collect import leading_type
from tablegauge.operators.histogram import histogram
from tablegauge.operators.profile import (
    distinct_from_sample,
    merge_sketches,
    merged_histogram,
    partition_stats,
    refresh_partitions,
    sketch_partitions,
    snapshot_changes,
    stat_header,
    usage_rollup,
    write_partition_stats,
)
from tablegauge.operators.querylog import counter_delta, log_top
from tablegauge.operators.report import ChecksFailed, Metric, check_label, natural_order, priority_counts, run_all, summary
from tablegauge.operators.texts import _with_keywords, filed, keyword_hits, keyword_two_hops
from tablegauge.plans import queries_report
from tablegauge.sources.definitions import Reference, TableDef
from tablegauge.sources.store import append_results, cleanup, export_plans, load, save, write_results
from tablegauge.sources.tables import collect_all, read_events

T0 = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_against_brute_force(spark, direction):
    rnd = random.Random(3)
    # many rows share a time, a third of the right side has one time
    at = lambda: T0 + datetime.timedelta(seconds=rnd.choice([10, 10, rnd.randint(0, 60)]))
    left = [(i, at()) for i in range(80)] + [(999, None)]
    right = [(i, at()) for i in range(60)]
    got = {r.lid: r.match.rid if r.match else None for r in asof_join(
        spark.createDataFrame(left, "lid long, lt timestamp_ntz"), spark.createDataFrame(right, "rid long, rt timestamp_ntz"),
        "lt", "rt", "lid", "rid", direction).collect()}
    for i, t in left:
        if t is None:
            want = None
        elif direction == "backward":
            want = max(((rt, r) for r, rt in right if rt <= t), default=(None, None))[1]
        else:
            want = min(((rt, r) for r, rt in right if rt >= t), default=(None, None))[1]
        assert got[i] == want, (i, t)


def test_leading_type(spark):
    df = spark.createDataFrame([(True, 100, 90, 0), (True, 100, 0, 90), (True, 100, 89, 0), (False, 100, 100, 0), (True, 0, 0, 0)], "p boolean, i long, a long, b long")
    got = [r[0] for r in df.select(leading_type(F.col("p"), F.col("i"), F.col("a"), F.col("b"))).collect()]
    assert got == ["Ascending", "Descending", "Stationary", "Unknown", "Unknown"]


STAT = dict(rowid=1, database_name="d", table_name="t", stats_name="s", key_column_name="k", statistic_type="Auto_Created", is_lob=False,
            current_number_of_rows=2_000_000, number_of_rows_at_time_stat_was_updated=2_000_000, unfiltered_rows=2_000_000,
            current_number_of_modified_rows_since_last_update=10, auto_update_threshold=44721, auto_update_threshold_type="Dynamic",
            percent_of_threshold=0.02, statistic_percent_sampled=20.0, rows_sampled=100, steps=50, stat_columns=["a", "b"],
            last_updated=T0, as_of=T0 + datetime.timedelta(hours=1))


def tables(spark, stats, history):
    return {
        "stat": spark.createDataFrame(stats, "rowid int, database_name string, table_name string, stats_name string, key_column_name string, statistic_type string, is_lob boolean, "
                                      "current_number_of_rows long, number_of_rows_at_time_stat_was_updated long, unfiltered_rows long, "
                                      "current_number_of_modified_rows_since_last_update long, auto_update_threshold long, auto_update_threshold_type string, "
                                      "percent_of_threshold double, statistic_percent_sampled double, rows_sampled long, steps int, stat_columns array<string>, "
                                      "last_updated timestamp_ntz, as_of timestamp_ntz"),
        "stat_history": spark.createDataFrame(history, "rowid int, history_number int, updated timestamp_ntz, table_cardinality long, steps int, density double, rows_above long, "
                                              "rows_below long, inserts_since_last_update long, deletes_since_last_update long, leading_column_type string"),
    }


def hist(n, minutes, inserts, steps=60, above=0, below=0, kind="Stationary"):
    return (1, n, T0 - datetime.timedelta(minutes=minutes), 2_000_000, steps, 0.1, above, below, inserts, 0, kind)


def test_cadence_comments(spark):
    c = tables(spark, [tuple(STAT.values())], [hist(1, 0, 5), hist(2, 60, 0), hist(3, 75, 7), hist(4, 90, 9)])
    r = check_cadence(c).first()
    assert (r.minutes_between_1_and_2, r.minutes_between_2_and_3, r.minutes_between_3_and_4, r.avg_minutes_between_updates) == (60, 15, 15, 30)
    assert [r.comment_1[:7], r.comment_2[:7], r.comment_3, r.comment_4[:7]] == ["Warning", "Warning", "OK", "Warning"]
    slow = tables(spark, [tuple(STAT.values())], [hist(1, 0, 5), hist(2, 100, 4), hist(3, 1600, 7), hist(4, 1800, 9)])
    r = check_cadence(slow).first()
    assert [r.comment_1, r.comment_2, r.comment_3[:7], r.comment_4] == ["OK", "OK", "Warning", "OK"]
    assert check_cadence(tables(spark, [tuple(STAT.values())], [hist(1, 0, None)])).first().avg_minutes_between_updates is None


def test_steps_changed_warns_below_ninety_percent(spark):
    c = tables(spark, [tuple(STAT.values())], [hist(1, 0, 5, 50), hist(2, 60, 0, 60)])
    r = check_steps_changed(c).first()
    assert (r.steps_diff_pct, r.comment[:7]) == (83.33, "Warning")
    c = tables(spark, [tuple(STAT.values())], [hist(1, 0, 5, 50), hist(2, 60, 0, 52)])
    assert check_steps_changed(c).first().comment == "OK"
    assert check_steps_changed(tables(spark, [tuple(STAT.values())], [hist(1, 0, 5), hist(2, 60, 0, 50)])).count() == 0


def test_hidden_ascending(spark):
    c = tables(spark, [tuple(STAT.values())], [hist(1, 0, 10, above=4)])
    assert check_hidden_ascending(c).first().percent_of_modifications == 40.0
    assert check_hidden_ascending(tables(spark, [tuple(STAT.values())], [hist(1, 0, 10, above=4, below=1)])).count() == 0


@pytest.mark.parametrize("ms, word", [(5, "VERY CLOSE"), (30, "CLOSE (11"), (80, "CLOSE (51"), (300, "NEAR"), (9000, "not close"), (30000, "Unlikely")])
def test_nearest_event_classes(spark, ms, word):
    c = tables(spark, [tuple(STAT.values())], [hist(1, 0, 10)])
    ev = spark.createDataFrame([(T0 - datetime.timedelta(milliseconds=ms),)] * 2, "start_time timestamp_ntz")
    r = check_nearest_event(c, ev).first()
    assert word in r.comment_1 and r.diff_in_ms == ms and "Found 2" in r.comment_2


def test_missing_multicol_says_ok_when_none(spark):
    c = {"stat": spark.createDataFrame([("d", "t", ["a", "b"])], "database_name string, table_name string, stat_columns array<string>")}
    ref = lambda cols: reference_frame(spark, [Reference("fk", "d", "t", cols, "r", cols)])
    assert [r.comment for r in check_missing_multicol(c, ref(("a", "b"))).collect()] == ["OK"]
    assert check_missing_multicol(c, ref(("a", "c"))).first().create_stat_command == "CREATE STATISTICS Stats_fk ON d.t (a,c)"


def test_keywords_both_ways(spark):
    rnd = random.Random(5)
    words = ["stat", "update", "a", "é", "statistic", "zz top", "of", "ofa"]
    texts = [(i, " ".join(rnd.choice(words + ["noise", "UPDATE", "quota"]) for _ in range(rnd.randint(0, 12)))) for i in range(60)] + [(60, ""), (61, None)]
    df = spark.createDataFrame(texts, "id long, text string")
    kw = spark.createDataFrame([(w,) for w in words + ["Update", ""]], "keyword string")
    want = {(i, w) for i, t in texts if t for w in words if w in t.lower()}
    assert sorted(tuple(r) for r in keyword_hits(df, "id", "text", kw).collect()) == sorted(want)


def test_keywords_of_texts_with_one_id(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (1, "beta"), (1, "beta"), (None, "alpha")], "id long, text string")
    kw = spark.createDataFrame([("alpha",), ("beta",)], "keyword string")
    assert sorted((r.id or 0, r.keyword) for r in keyword_hits(df, "id", "text", kw).collect()) == [(0, "alpha"), (1, "alpha"), (1, "beta"), (1, "beta"), (1, "beta")]


@pytest.mark.parametrize("most", [20, 20_000])
def test_keywords_of_any_letters_in_any_number_of_passes(spark, most):
    rnd = random.Random(7)
    letters = "ab.*[(\\^$ \n-]é漢😀"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(60)] + ["#", "\\\\e", "a-b", "x" * 50]
    texts = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) + rnd.choice(words)) for i in range(40)]
    df = spark.createDataFrame(texts, "id long, body string")
    kw = spark.createDataFrame([(w,) for w in words * 2], "keyword string")
    want = {(i, w) for i, t in texts for w in words if w in t}
    assert sorted((r.id, r.keyword) for r in _with_keywords(df, kw, most).collect()) == sorted(want)


def test_keywords_are_filed_under_rare_letters():
    index = filed(["statistics", "statement", "state", "ab"])
    assert sorted(k for own in index.values() for k in own) == ["ab", "state", "statement", "statistics"]
    assert all(g in k for g, own in index.items() for k in own) and index["ab"] == ["ab"]
    assert "sta" not in index or index["sta"] == ["state"]


def test_long_text_costs_in_proportion(spark):
    """A text of 4 million letters; the groups of letters that no keyword has are never built."""
    df = spark.createDataFrame([(1, "noise word " * 400_000 + "needle")], "id long, text string")
    kw = spark.createDataFrame([("needle",), ("absent",)], "keyword string")
    assert [tuple(r) for r in keyword_hits(df, "id", "text", kw).collect()] == [(1, "needle")]


def test_plan_documents_beyond_plain_names(spark):
    doc = """<P><StmtSimple StatementType="SELECT"><QueryPlan CachedPlanSize="2e+03"><MemoryGrantInfo SerialDesiredMemory="1024" SerialRequiredMemory="512"/>
      <OptimizerStatsUsage><StatisticsInfo Database="d" Table="O'Brien" Statistics="a>b" ModificationCount="6e+02"/><StatisticsInfo Statistics='x Table="y"' Table="t&#65;" ModificationCount="5e+02"/></OptimizerStatsUsage>
      <StatisticsInfo Statistics="elsewhere"/>
      <RelOp NodeId="0" PhysicalOp="x" EstimateRows="3"><NestedLoops><RelOp
        NodeId="1" EstimateRows="2e+06"><OutputList><ColumnReference Database="d" Column="outer_only"/></OutputList><IndexScan><Object Database="a" Table="t" Index="i"/><ColumnReference Database="d" Column="a"/></IndexScan></RelOp>
      <RelOp NodeId="2" EstimateRows="9e+06"><IndexScan Lookup="1"><Object Database="b" Table="t" Index="i" IndexKind="Clustered"/><ColumnReference Database="d" Column="z"/></IndexScan></RelOp></NestedLoops></RelOp>
      <RelOp NodeId="3"><IndexScan><Object Table="outside" Index="o"/></IndexScan></RelOp></QueryPlan></StmtSimple></P>"""
    plans = spark.createDataFrame([(1, "h", doc, 1.0), (2, "h", "<a>", 1.0), (3, "h", None, 1.0)], "plan_id long, query_hash string, plan_doc string, query_impact double")
    scalars = plandoc.plan_scalars(plans).orderBy("plan_id").first()
    assert (scalars.operator_max_estimated_rows, scalars.sum_modification_count, scalars.statement_cached_plan_size_mb) == (9e6, 1100.0, 1.9531)
    assert scalars.serial_required_memory_mb == 0.5
    lists = plandoc.plan_stats(plans).orderBy("plan_id").first()
    assert lists.stats_list == """d.O'Brien.a>b,tA.x Table="y\"""" and lists.number_of_referenced_stats == 2
    assert lists.index_list == "a.t.i,b.t.i,outside.o" and lists.number_of_referenced_indexes == 3
    assert [tuple(r) for r in plandoc.lookup_comments(plans).collect()] == [(1, "Key lookup on t.i because column(s) (a) are missing on index t.i")]
    assert [r.plan_id for r in plandoc.stale_refs(plans, 1000).collect()] == [1]


def test_two_hops_nothing_found(spark):
    a = spark.createDataFrame([(1, "nothing here")], "id long, text string")
    assert [r.comment for r in keyword_two_hops(a, "id", "text", F.lit("name"), ["absent"], a, "id", "text").collect()] == ["Warning - Nothing found, check by hand"]


def test_malformed_documents_get_null(spark):
    docs = ["<A/>", "<A><B></A>", "<A/><broken", None, "", "x", "<A>&nbsp;</A>", "</plandoc_root><plandoc_root>", "<A>\x01</A>",
            '<?xml version="1.0"?><S xmlns="u:x"><StmtSimple StatementType="INSERT"/><RelOp EstimateRows="7"/><RelOp EstimateRows="12.5"/></S>']
    df = spark.createDataFrame([(i, "h", d, 1.0) for i, d in enumerate(docs)], "plan_id int, query_hash string, plan_doc string, query_impact double")
    rows = {r.plan_id: r for r in plandoc.plan_scalars(df).collect()}
    assert [rows[i].is_readable for i in range(len(docs))] == [True, False, False, False, True, True, False, False, False, True]
    assert (rows[9].statement_type, rows[9].operator_max_estimated_rows, rows[9].sum_modification_count) == ("INSERT", 12.5, 0.0)
    assert all(r.has_merge_join is None for r in plandoc.plan_flags(df).collect() if not rows[r.plan_id].is_readable)


def test_stats_list_decodes_and_ignores_comments(spark):
    doc = '<P><!-- <StatisticsInfo Table="no"/> --><OptimizerStatsUsage><StatisticsInfo Table="a&amp;b" Statistics="s"/><StatisticsInfo Table="a&amp;b" Statistics="s"/></OptimizerStatsUsage></P>'
    df = spark.createDataFrame([(1, "h", doc)], "plan_id int, query_hash string, plan_doc string")
    r = plandoc.plan_stats(df).first()
    assert (r.stats_list, r.number_of_referenced_stats, r.number_of_referenced_indexes) == ("a&b.s", 1, 0)


def test_sources_skip_what_fails(spark):
    def broken():
        return spark.read.parquet("/nowhere/at/all")
    df = collect_all({"a": spark.range(2), "broken": broken, "master": spark.range(9), "b": spark.range(1)}, exclude=["master"])
    assert {(r.source_name, r["count"]) for r in df.groupBy("source_name").count().collect()} == {("a", 2), ("b", 1)}
    assert collect_all({"ax": spark.range(2), "b": spark.range(1)}, "a*").count() == 2
    assert read_events(spark, None, ["x"]).columns == ["session_id", "event_name", "text_data", "start_time", "database_name"]


def test_stores(spark, tmp_path):
    p = str(tmp_path)
    assert load(spark, ["x"], p) is None
    assert save({"x": spark.range(3)}, p)["x"].count() == 3
    assert save({"x": spark.range(5)}, p)["x"].count() == 3
    assert save({"x": spark.range(5)}, p, refresh=True)["x"].count() == 5
    assert write_results({"full": spark.range(2), "none": spark.range(0)}, p) == {"full": 2, "none": 0}
    assert spark.read.parquet(f"{p}/none").first().result == "No rows"
    append_results(spark.range(2), f"{p}/acc")
    assert append_results(spark.range(3), f"{p}/acc").count() == 5
    assert append_results(spark.range(3), f"{p}/acc", cleanup=True).count() == 3
    export_plans(spark.createDataFrame([("h1", "<a/>"), ("h2", "<b/>")], "query_hash string, plan_doc string"), f"{p}/plans")
    assert spark.read.text(f"{p}/plans/query_hash=h1").first().value == "<a/>"
    export_plans(spark.createDataFrame([("h", f"<a>{k % 3}\n</a>") for k in range(9)] + [("h", None)], "query_hash string, plan_doc string"), f"{p}/more")
    files = [r.value for r in spark.read.text(f"{p}/more/query_hash=h", wholetext=True).select("value").collect()]
    assert sorted(f.rstrip("\n") for f in files) == ["<a>0\n</a>", "<a>1\n</a>", "<a>2\n</a>"]


def test_cleanup_drops_by_prefix(spark):
    spark.range(1).createOrReplaceTempView("tg_one")
    spark.range(1).createOrReplaceTempView("keep_me")
    assert cleanup(spark, "TG_") == ["tg_one"]
    assert [t.name for t in spark.catalog.listTables() if t.name == "keep_me"] == ["keep_me"]
    spark.catalog.dropTempView("keep_me")


def test_partition_statistics_replace_only_changed(spark, tmp_path):
    p = str(tmp_path / "parts")
    df = spark.createDataFrame([(1, 2020), (1, 2020), (2, 2021)], "k long, y int")
    write_partition_stats(partition_stats(df, "k", F.col("y")), p)
    write_partition_stats(partition_stats(spark.createDataFrame([(9, 2021)], "k long, y int"), "k", F.col("y")), p)
    assert {(r.part, r.key, r.cnt) for r in spark.read.parquet(p).collect()} == {(2020, 1, 2), (2021, 9, 1)}
    merged = merge_sketches(sketch_partitions(df, "k", F.col("y"))).first()
    assert (merged.rows, merged.distinct_values) == (3, 2)


def test_histogram_is_merged_and_reads_changed_partitions_only(spark, tmp_path):
    """The files of an unchanged year are gone, so a run that read them would fail."""
    rnd = random.Random(3)
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    rows = [(rnd.choice([None, *range(300)]), 2000 + k % 4) for k in range(5000)]
    old = spark.createDataFrame([r for r in rows if r[1] != 2003 or rnd.random() < 0.5] + [(7, 1999)], "k long, y int")
    write_partition_stats(partition_stats(old, "k", F.col("y")), state)
    spark.createDataFrame(rows, "k long, y int").write.partitionBy("y").parquet(table)
    now = spark.read.parquet(table)
    for f in (tmp_path / "table" / "y=2001").glob("*.parquet"):
        f.write_bytes(b"not a table")
    got = merged_histogram(refresh_partitions(now, "k", F.col("y"), ["1999", "2003"], state)).collect()
    want = histogram(spark.createDataFrame(rows, "k long, y int"), "k").collect()
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_changes_between_snapshots(spark):
    schema = "k int, part string, v string"
    before = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", None), (4, "b", "y"), (5, "b", "z"), (5, "b", "z"), (None, "b", "n")], schema)
    after = spark.createDataFrame([(1, "a", "x"), (2, "a", "new"), (3, "b", None), (5, "b", "z"), (6, "a", "x"), (6, "a", "x"), (None, "b", "n")], schema)
    got = {r.part: (r.inserts, r.deletes, r.updates, r.unchanged) for r in snapshot_changes(before, after, ["k", "part"], "part").collect()}
    assert got == {"a": (2, 0, 1, 1), "b": (0, 2, 0, 3)}
    assert tuple(snapshot_changes(before, after, ["k", "part"]).first()) == (2, 2, 1, 4)
    assert tuple(snapshot_changes(before.limit(0), after.limit(0), ["k"]).first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        snapshot_changes(before, after.drop("v"), ["k"])


@pytest.mark.parametrize("values", [50, 2000, 40_000])
def test_distinct_values_from_a_sample(spark, values):
    """The exact figure lies within the bounds, and the estimate within the root of the sampling ratio."""
    df = spark.range(40_000).select((F.pmod(F.xxhash64("id"), F.lit(values))).alias("k"), "id")
    exact = df.select("k").distinct().count()
    r = distinct_from_sample(df.filter("id % 10 = 3"), "k", 40_000).first()
    assert r.at_least <= exact <= r.at_most and 1 / 3.2 <= r.estimate / exact <= 3.2
    none = distinct_from_sample(df.limit(0), "k", 0).first()
    assert (none.estimate, none.at_least, none.rows_sampled) == (0.0, 0, 0)


def test_checks_run_side_by_side(spark, tmp_path):
    """A check that fails while its job runs leaves the others."""
    bad = spark.range(10).selectExpr("raise_error('no') AS x")
    results, seconds = run_all({f"chk{k}": (lambda k=k: bad if k == 5 else spark.range(k)) for k in range(1, 9)}, str(tmp_path))
    assert {n: df.count() for n, df in results.items()} == {f"chk{k}": k for k in range(1, 9) if k != 5} and len(seconds) == 8


def test_header_filter_and_sample(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("f"))
    r = stat_header(df, ["k"], where="f = 0", sample_on="k", sample_pct=10).first()
    assert (r.rows, r.rows_sampled, r.percent_sampled, r.unfiltered_rows) == (500, 50, 10.0, 1000)
    assert stat_header(df, ["k"], approx=True).first().distinct_values == pytest.approx(1000, rel=0.1)


def test_table_def_rejects_bad_cutoffs():
    with pytest.raises(ValueError):
        TableDef("t", "d", "2024-01-01", ("2020-01-01", "2021-01-01"))
    with pytest.raises(ValueError):
        TableDef("t", "d", "2024-01-01", ())


def test_report(spark, tmp_path):
    def bad():
        raise ValueError("no")
    results, seconds = run_all({"chk10_x": lambda: spark.range(4), "chk2_y": bad, "chk1_z": lambda: spark.range(1)}, str(tmp_path))
    assert list(seconds) == ["chk1_z", "chk2_y", "chk10_x"] and set(results) == {"chk1_z", "chk10_x"}
    assert natural_order(["chk10", "chk9", "chk1"]) == ["chk1", "chk9", "chk10"]
    metrics = [Metric("chk10_x", "big ids", "id >= 2", "Low"), Metric("chk10_x", "share", "id >= 2", kind="percent"),
               Metric("chk1_z", "any", "id > 5", kind="any"), Metric("absent", "gone")]
    s = summary(results, metrics)
    assert [(r.info, r.result, r.priority, r.more_info) for r in s.collect()] == [
        ("big ids", "2", "Low", "Check10"), ("share", "50", "High", "Check10"), ("any", "0", "High", "Check1")]
    assert {tuple(r) for r in priority_counts(s).collect()} == {("Low", 1), ("High", 2)}
    assert check_label("stat") == "NA"


def _raises(kind, *text):
    def check():
        raise kind(*text)
    return check


def test_a_failed_check_is_no_result(spark, tmp_path, monkeypatch):
    metrics = [Metric("chk1_a", "ids"), Metric("chk2_b", "lost"), Metric("chk3_c", "lost while it ran")]
    checks = {"chk1_a": lambda: spark.range(3), "chk2_b": _raises(KeyError), "chk3_c": lambda: spark.range(9).selectExpr("raise_error('no') AS x")}
    results, _ = run_all(checks, str(tmp_path))
    assert set(results) == {"chk1_a"} and set(results.failed) == {"chk2_b", "chk3_c"} and results.failed["chk2_b"] == "KeyError"
    with pytest.raises(ChecksFailed, match="2 checks failed: chk2_b: KeyError; chk3_c"):
        summary(results, metrics)
    assert [r.result for r in summary(results, metrics[:1]).collect()] == ["3"]
    # the registered queries do not count on a part either: no failed check, no statistic that was not collected
    stat = spark.createDataFrame([(s.rowid,) for s in queries_report.STAT_DEFS], "rowid int")
    monkeypatch.setattr(queries_report, "_checks", lambda *_: {"chk05_unused": _raises(ValueError, "gone")})
    monkeypatch.setattr(queries_report, "collected", lambda *_: {"stat": stat})
    with pytest.raises(ChecksFailed, match="chk05_unused: gone"):
        queries_report.rep_priority(spark, "")
    monkeypatch.setattr(queries_report, "collected", lambda *_: {"stat": stat.filter("rowid <> 4")})
    with pytest.raises(ChecksFailed, match="us_orderdate"):
        queries_report.rep_summary(spark, "")


def test_counters_and_top(spark):
    a = spark.createDataFrame([("x", 3)], "k string, n long")
    b = spark.createDataFrame([("x", 5), ("y", 2)], "k string, n long")
    assert {tuple(r) for r in counter_delta(a, b, "k", "n").collect()} == {("x", 3, 5, 2), ("y", 0, 2, 2)}
    c = spark.createDataFrame([("x", 1), ("y", 9)], "k string, n long")
    assert {tuple(r) for r in counter_delta(b, c, "k", "n").collect()} == {("x", 5, 1, 1), ("y", 2, 9, 7)}
    m = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "query_hash string, query_impact double")
    assert [r.query_hash for r in log_top(m, 2).collect()] == ["c", "a"]
    assert log_top(m, skip=True).count() == 0


def test_accuracy_goes_on_after_a_key_that_fails_while_it_runs(spark):
    rows = spark.range(40).selectExpr("id % 7 AS good", "CAST(id AS string) AS word")
    bad = rows.withColumn("bad", F.expr("IF(word = '9', CAST(raise_error('no value') AS bigint), 1L)"))
    stat = spark.createDataFrame([(1, "t", "bad", 9, 0, 40), (2, "t", "good", 5, 0, 40), (3, "gone", "k", 4, 0, 40)],
                                 "rowid long, table_name string, key_column_name string, user_seeks long, user_lookups long, current_number_of_rows long")
    of_good = histogram(rows, "good")
    found = accuracy_top({"t": bad}, stat, lambda rowid, df, key: of_good)
    assert [r[0] for r in found.select("rowid").distinct().collect()] == [2]
    assert found.agg(F.sum("actual_eq_rows") + F.sum("actual_range_rows")).first()[0] == 40


def test_usage_counters_are_named_by_the_caller(spark):
    log = spark.createDataFrame([(1, "latch", 1500), (1, "latch", None), (1, "range", 7), (2, "range", 7)], "rowid long, kind string, wait_ms long")
    got = {r.rowid: (r.range_scans, r.latch_waits, r.wait_ms, r.avg_wait_ms) for r in usage_rollup(
        log, ["rowid"], {"range_scans": "range", "latch_waits": "latch"}, "latch_waits").collect()}
    assert got == {1: (1, 2, 1500, 750.0), 2: (1, 0, 0, 0.0)}
