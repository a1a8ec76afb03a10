import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import sketches as sk
from tablegauge.operators.accuracy import top_values
from tablegauge.operators.collect import collect
from tablegauge.operators.querylog import counter_growth
from tablegauge.sources.definitions import StatDef, TableDef
from tablegauge.streaming.rates import run_counter_growth

T0 = datetime.datetime(2024, 1, 1)


def _hot(spark, rows=60_000):
    """A third of all rows has one key; the others are uneven, with NULLs, negative ones and both zeros."""
    k = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.pmod(F.hash("id"), F.lit(5000)) - 2500)
    return spark.range(rows).select(k.cast("long").alias("k"), (F.col("id") % 12).alias("part"))


@pytest.mark.parametrize("kind", ["long", "double", "date", "timestamp_ntz", "decimal(12,2)"])
def test_bounds_of_shares_are_within_the_error(spark, kind):
    as_kind = {"date": F.date_from_unix_date(F.col("k").cast("int")), "timestamp_ntz": F.timestamp_seconds("k").cast("timestamp_ntz")}
    df = _hot(spark).withColumn("k", as_kind.get(kind, F.col("k").cast(kind)))
    kept = sk.quantile_sketches(df, "k", F.col("part"))
    assert kept.count() == 12
    bounds = sk.sketch_bounds(kept, df.schema["k"].dataType, 40)
    audit = sk.rank_audit(df, "k", bounds).collect()
    assert len(audit) == 40 and max(r.rank_error for r in audit) <= sk.rank_error()
    assert audit[-1].range_hi_key == df.agg(F.max("k")).first()[0]


def test_steps_of_a_hot_key_are_one(spark):
    df = _hot(spark)
    steps = sk.sketched_histogram(sk.quantile_sketches(df, "k", F.col("part")), df.schema["k"].dataType, 30).collect()
    hot = [r for r in steps if r.range_hi_key == 7]
    assert len(hot) == 1 and hot[0].estimated_rows > 18_000
    assert sum(r.estimated_rows for r in steps) == df.filter("k IS NOT NULL").count()


def test_sketches_of_no_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "k long, part int")
    kept = sk.quantile_sketches(df, "k", F.col("part"))
    bounds = sk.sketch_bounds(kept, df.schema["k"].dataType, 5)
    assert bounds.count() == 0 and sk.rank_audit(df, "k", bounds).count() == 0
    assert sk.heavy_hitters(df.limit(0), "k").count() == 0
    with pytest.raises(TypeError):
        sk.quantile_sketches(df.withColumn("k", F.lit("x")), "k", F.col("part"))


def test_changed_partitions_are_sketched_anew(spark):
    df = _hot(spark)
    kept = sk.prefix_sketches(df, ["part", "k"], F.col("part"))
    changed = df.unionByName(spark.range(900).select((F.col("id") + 10_000).alias("k"), F.lit(3).cast("long").alias("part")))
    anew = kept.filter("part <> '3'").unionByName(sk.prefix_sketches(changed.filter("part = 3"), ["part", "k"], F.col("part")))
    got = {r.density_number: r.distinct_values for r in sk.merged_density(anew, ["part", "k"]).collect()}
    want = changed.select("part", "k").distinct().count()
    assert got[1] == 12 and abs(got[2] - want) <= want * sk.distinct_error()


def test_nulls_of_prefixes_are_told_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), (None, None), ("", "a"), ("aa", "")], "a string, b string")
    got = sk.merged_density(sk.prefix_sketches(df, ["a", "b"], F.lit(1)), ["a", "b"]).orderBy("density_number").collect()
    assert [r.distinct_values for r in got] == [4, 6]


@pytest.mark.parametrize("tracked", [10, 200, 10_000])
def test_most_frequent_values_are_exact(spark, tracked):
    df = _hot(spark)
    for n in (1, 5, 10):
        assert sk.heavy_hitters(df, "k", n, tracked).collect() == top_values(df, "k", n).collect()
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (-0.0,), (1.0,), (1.0,), (None,), (None,)], "k double")
    assert sk.heavy_hitters(zeros, "k", 10, tracked).collect() == top_values(zeros, "k", 10).collect()


def test_few_heavy_values_need_no_count_of_all(spark, monkeypatch):
    rare = spark.range(30_000).select((F.col("id") + 100).alias("k"))
    df = rare.unionByName(spark.range(60_000).select((F.col("id") % 5).alias("k")))
    seen = []
    plain = sk.value_counts
    monkeypatch.setattr(sk, "value_counts", lambda d, k: seen.append(1) or plain(d, k))
    assert [(r.key_value, r.number_of_rows) for r in sk.heavy_hitters(df, "k", 5, 500).collect()] == [(i, 12_000) for i in range(5)]
    assert len(seen) == 1  # the candidates only


def _readings(rows):
    return [(k, T0 + datetime.timedelta(hours=h), c) for k, h, c in rows]


def _plain_growth(rows):
    out = {}
    for k, t, c in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1], r[2])):
        last, n, resets, grown = out.get(k, (None, 0, 0, 0))
        fell = last is not None and c < last
        out[k] = (c, n + 1, resets + fell, grown + (c if last is None or fell else c - last))
    return out


SCHEMA = "k string, ts timestamp_ntz, c long"


def test_counter_growth_with_resets(spark):
    rnd = random.Random(5)
    rows = _readings([(rnd.choice("abc"), rnd.randrange(300), rnd.randrange(50)) for _ in range(900)]) + [(None, T0, 3), ("a", None, 3), ("a", T0, None)]
    got = {r.key: (r.last, r.readings, r.resets, r.grown) for r in counter_growth(spark.createDataFrame(rows, SCHEMA), "k", "ts", "c").collect()}
    assert got == _plain_growth(rows)
    assert counter_growth(spark.createDataFrame([], SCHEMA), "k", "ts", "c").count() == 0


def test_counter_growth_as_a_stream_over_batches(spark, tmp_path):
    rnd = random.Random(6)
    rows = _readings(sorted([(rnd.choice("abcd") if h > 100 else "a", h, rnd.randrange(40)) for h in rnd.sample(range(400), 300)], key=lambda r: r[1]))
    late = [("a", T0 - datetime.timedelta(days=1), 1000)] * 2
    for i, part in enumerate([rows[:100], rows[100:101], rows[101:], late]):
        path = str(tmp_path / f"in/{i}.parquet")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        spark.createDataFrame(part, SCHEMA).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(path)
        os.utime(path, (1_700_000_000 + 60 * i,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = run_counter_growth(stream, "k", "ts", "c", "growth").collect()
    assert {r.key: (r.last, r.readings, r.resets, r.grown) for r in done} == _plain_growth(rows)
    assert {r.key: r.late for r in done} == {"a": 2, "b": 0, "c": 0, "d": 0}


def _tables(spark):
    good = spark.range(3000).select((F.col("id") % 40).alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    bad = spark.range(300).select(F.raise_error(F.lit("broken while it is read")).cast("long").alias("a"), F.lit("x").alias("b"))
    defs = [TableDef(n, "db", "2024-02-01 00:00:00", ("2024-01-01 00:00:00",)) for n in ("good", "bad", "gone")]
    stats = [StatDef(i, n, f"s{i}", ("a", "b"), "User_Created") for i, n in enumerate(("good", "bad", "gone"), 1)]
    return {"good": good, "bad": bad}, defs, stats


def test_collect_skips_a_table_that_fails_while_it_is_read(spark, tmp_path):
    frames, defs, stats = _tables(spark)
    out = collect(spark, frames, defs, stats, str(tmp_path / "all"))
    assert [r.table_name for r in out["stat"].collect()] == ["good"]
    with pytest.raises(Exception, match="broken"):
        collect(spark, {"bad": frames["bad"]}, defs, stats, str(tmp_path / "none"))


def test_collect_with_sketched_prefixes(spark, tmp_path):
    frames, defs, stats = _tables(spark)
    plain, sketched = (collect(spark, {"good": frames["good"]}, defs[:1], stats[:1], str(tmp_path / str(s)), sketched=s)["density"].orderBy("density_number").collect() for s in (False, True))
    assert [r.average_length for r in plain] == [r.average_length for r in sketched]
    assert [abs(a.distinct_values - b.distinct_values) <= a.distinct_values * sk.distinct_error() for a, b in zip(plain, sketched)] == [True, True]
