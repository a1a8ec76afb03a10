import datetime
import decimal
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablegauge.operators.accuracy import accuracy, repro_texts, top_values, top_values_text
from tablegauge.operators.histogram import histogram


def brute(values, max_steps=200):
    """The histogram rule in plain Python."""
    counts = sorted(Counter(v for v in values if v is not None).items())
    total, keys, heavy = sum(c for _, c in counts), len(counts), (max_steps - 1) // 2
    cum, rows, buckets = 0, [], []
    for k, c in counts:
        cum += c
        rows.append((k, c, cum))
        buckets.append((cum * heavy + total - 1) // total)
    out, prev_cum, prev_rn = [], 0, 0
    for i, (k, c, cum) in enumerate(rows):
        if i == 0 or keys <= max_steps or c * heavy >= total or i == keys - 1 or buckets[i] != buckets[i + 1]:
            out.append((k, cum - c - prev_cum, c, i - prev_rn))
            prev_cum, prev_rn = cum, i + 1
    nulls = sum(v is None for v in values)
    return ([(None, 0, nulls, 0)] if nulls else []) + out


def found(df, key, **kw):
    return [(r.range_hi_key, r.range_rows, r.eq_rows, r.distinct_range_rows)
            for r in histogram(df, key, **kw).orderBy("stepnumber").collect()]


def skewed():
    # a third of all rows on one key, NULLs, and many rare keys
    return [77] * 3000 + [i * 7 % 1009 for i in range(5000)] + [None] * 500 + list(range(2000, 2500))


@pytest.mark.parametrize("cast", ["long", "int", "double", "string", "decimal(12,2)"])
def test_against_brute_force(spark, cast):
    conv = {"long": int, "int": int, "double": float, "string": str, "decimal(12,2)": lambda v: decimal.Decimal(v).quantize(decimal.Decimal("0.01"))}[cast]
    values = [None if v is None else conv(v) for v in skewed()]
    df = spark.createDataFrame([(v,) for v in values], f"k {cast}")
    got = found(df, "k")
    assert got == brute(values)
    assert len(got) <= 201
    assert sum(r + e for _, r, e, _ in got) == len(values)


@pytest.mark.parametrize("max_steps", [3, 10, 50])
def test_few_steps(spark, max_steps):
    df = spark.createDataFrame([(v,) for v in skewed()], "k long")
    got = found(df, "k", max_steps=max_steps)
    assert got == brute(skewed(), max_steps)


def test_dates_and_unique_keys(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.expr("TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(CAST(id % 900 AS INT))").alias("t"))
    assert found(df, "k") == brute(list(range(5000)))
    base = datetime.datetime(2020, 1, 1)
    assert found(df, "t") == brute([base + datetime.timedelta(days=i % 900) for i in range(5000)])


def test_all_null_and_empty(spark):
    df = spark.createDataFrame([(None,)] * 4, "k long")
    assert found(df, "k") == [(None, 0, 4, 0)]
    assert found(df.filter("false"), "k") == []


def test_heavy_key_has_its_own_step(spark):
    df = spark.createDataFrame([(v,) for v in skewed()], "k long")
    assert (77, 3007) in {(k, e) for k, _, e, _ in found(df, "k")} or any(k == 77 and e >= 3000 for k, _, e, _ in found(df, "k"))


def test_exact_histogram_has_no_error(spark):
    df = spark.createDataFrame([(v,) for v in skewed()], "k long")
    rep = accuracy(df, "k", histogram(df, "k"))
    bad = rep.filter("eq_rows_diff <> 0 OR range_rows_diff <> 0 OR distinct_range_rows_diff <> 0 OR avg_range_rows_diff > 0.0001")
    assert bad.count() == 0
    assert repro_texts(rep, "t", "k").filter("eq_query <> '' OR range_query <> ''").count() == 0


def test_stale_histogram_and_strings_with_quotes(spark):
    old = spark.createDataFrame([(v,) for v in ["a'b", "c", "c", "x\\y"]], "k string")
    new = old.union(spark.createDataFrame([(v,) for v in ["b", "b", "bb", "c", "zz", None]], "k string"))
    rows = {r.range_hi_key: r for r in accuracy(new, "k", histogram(old, "k")).collect()}
    assert (rows["c"].actual_eq_rows, rows["c"].actual_range_rows, rows["c"].actual_distinct_range_rows) == (3, 3, 2)
    assert (rows["c"].value_with_biggest_diff, rows["c"].actual_rows_for_value) == ("b", 2)
    assert rows["x\\y"].actual_eq_rows == 1


def test_top_values(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 1, 2, 2, 3]], "k long")
    assert [tuple(r) for r in top_values(df, "k", 2).collect()] == [(1, 3), (2, 2)]
    assert top_values(spark.range(20).withColumnRenamed("id", "k"), "k").count() == 0
    assert top_values_text(df, "k", 1).first()[0] == '[{"number_of_rows":3,"key_value":1}]'


def test_no_window_over_one_partition(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    plan = histogram(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("SinglePartition, ENSURE_REQUIREMENTS, [plan_id=0]", "")
