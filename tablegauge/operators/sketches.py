"""Statistics from mergeable sketches: histograms, distinct values of prefixes, and the most frequent values.

A sketch has a fixed size, whatever the number of rows and keys that it stands for. Sketches are made per partition of a table and kept, so
that only changed partitions are read again, and no step shuffles rows by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.numbers import value_bytes
from ..session import written
from .accuracy import step_of
from .histogram import MAX_STEPS, value_counts

#: Size of a quantile sketch, about 70 KB for whole numbers.
QUANTILE_SIZE = 4000
#: Values whose counts a sketch of frequent values keeps.
TRACKED = 10_000
#: Registers of a distinct-count sketch, as a power of two.
DISTINCT_BITS = 14
#: Groups of tasks whose sketches are merged side by side before they meet in one task.
MERGE_GROUPS = 64
#: Rows that one task counts where all values are counted.
ROWS_AT_ONCE = 1_000_000


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """How far a quantile may lie from its rank, as a share of the rows: four times the error that 99 of 100 quantiles keep."""
    return 4 * 2.296 / size ** 0.9021


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """How far a distinct count may be off, as a share of it: four standard errors."""
    return 4 * 1.04 / 2 ** (bits / 2)


def _ordered(key: str, dtype: T.DataType) -> tuple[str, Column]:
    """Kind of the sketch for a type, and the key as a number in the same order."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint", F.col(key).cast("long")
    if isinstance(dtype, T.DateType):
        return "bigint", F.unix_date(F.col(key)).cast("long")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "bigint", F.unix_micros(F.col(key).cast("timestamp"))
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double", F.col(key).cast("double")
    raise TypeError(f"no quantile sketch for {dtype.simpleString()}")


def _native(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(value.cast("int"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(value).cast(dtype)
    return value.cast(dtype)


def quantile_sketches(df: DataFrame, key: str, part: Column, size: int = QUANTILE_SIZE) -> DataFrame:
    """Per partition its rows with and without a key, and a quantile sketch of the keys."""
    kind, value = _ordered(key, df.schema[key].dataType)
    return df.groupBy(part.cast("string").alias("part")).agg(
        F.count(key).alias("rows"), F.count_if(F.col(key).isNull()).alias("null_rows"),
        F.call_function(f"kll_sketch_agg_{kind}", value, F.lit(size)).alias("sketch"))


def sketch_bounds(sketches: DataFrame, dtype: T.DataType, steps: int = MAX_STEPS) -> DataFrame:
    """The upper bound of each of ``steps`` equal shares of the rows, from the sketches of all partitions.

    Columns: share (1 to steps), range_hi_key in the type of the key, target_rows (rows that should be up to it), rows. The last bound is the
    largest key. Without any key there are no rows.
    """
    kind, _ = _ordered("key", dtype)
    merged = sketches.filter("rows > 0").agg(F.sum("rows").alias("rows"), F.call_function(f"kll_merge_agg_{kind}", "sketch").alias("sketch"))
    shares = F.array(*[F.lit(i / steps) for i in range(1, steps + 1)])
    found = merged.filter("rows > 0").select("rows", F.posexplode(F.call_function(f"kll_sketch_get_quantile_{kind}", "sketch", shares)).alias("at", "bound"))
    share = F.col("at") + 1
    return found.select(
        share.alias("share"), _native(F.col("bound"), dtype).alias("range_hi_key"),
        F.call_function("div", F.col("rows") * share + (steps - 1), F.lit(steps).cast("long")).alias("target_rows"), "rows")


def sketched_histogram(sketches: DataFrame, dtype: T.DataType, steps: int = MAX_STEPS) -> DataFrame:
    """Steps with about equally many rows: stepnumber, range_hi_key, estimated_rows (above the bound before, up to this one).

    A bound that several shares have in common is one step, with the rows of all of them.
    """
    bounds = sketch_bounds(sketches, dtype, steps).groupBy("range_hi_key").agg(F.max("target_rows").alias("up_to"))
    order = Window.partitionBy(F.lit(0)).orderBy("range_hi_key")  # at most ``steps`` rows
    return bounds.select(
        F.row_number().over(order).alias("stepnumber"), "range_hi_key", (F.col("up_to") - F.coalesce(F.lag("up_to").over(order), F.lit(0))).alias("estimated_rows"))


def rank_audit(df: DataFrame, key: str, bounds: DataFrame) -> DataFrame:
    """Real rows below and up to each bound of ``sketch_bounds``, and how far its share is from them (rank_error, a share of all rows).

    The table is read once; a key finds its place among the bounds by a binary search in the expression, and only counts per place are shuffled.
    """
    dtype = df.schema[key].dataType
    rows = bounds.orderBy("share").collect()  # one per step
    bounds = df.sparkSession.createDataFrame(rows, bounds.schema)  # these very bounds: a sketch that is made again may give others
    values = sorted({r.range_hi_key for r in rows})
    if not values:
        return bounds.select("share", "range_hi_key", "target_rows", *[F.lit(0).cast("long").alias(c) for c in ("rows_below", "rows_up_to")], F.lit(0.0).alias("rank_error"))
    counted = df.filter(F.col(key).isNotNull()).select(F.expr(step_of(f"`{key}`", values, dtype)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("cnt"))
    places = df.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(values)], T.StructType([T.StructField("place", T.IntegerType()), T.StructField("range_hi_key", dtype)]))
    per_place = counted.filter("code <> 0").groupBy(F.abs("code").alias("place")).agg(F.sum("cnt").alias("cnt"), F.sum(F.when(F.col("code") > 0, F.col("cnt")).otherwise(0)).alias("eq"))
    order = Window.partitionBy(F.lit(0)).orderBy("place")  # a row per bound
    ranks = places.join(per_place, "place", "left").select("range_hi_key", F.coalesce("eq", F.lit(0)).alias("eq"), F.sum(F.coalesce("cnt", F.lit(0))).over(order).alias("rows_up_to"))
    j = bounds.join(F.broadcast(ranks), "range_hi_key")
    below = F.col("rows_up_to") - F.col("eq")
    off = F.greatest(F.col("target_rows") - F.col("rows_up_to"), below - F.col("target_rows"), F.lit(0).cast("long"))
    return j.select("share", "range_hi_key", "target_rows", below.alias("rows_below"), "rows_up_to", (off / F.col("rows")).alias("rank_error"))


def tuple_hash(columns: Sequence[str]) -> Column:
    """A hash of several values that tells a NULL in one place from a NULL in another."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def prefix_sketches(df: DataFrame, columns: Sequence[str], part: Column, bits: int = DISTINCT_BITS) -> DataFrame:
    """Per partition its rows, and for every prefix of ``columns`` its bytes and a distinct-count sketch. No shuffle by value."""
    types = {f.name: f.dataType for f in df.schema}
    prefixes = [list(columns[:n]) for n in range(1, len(columns) + 1)]
    return df.groupBy(part.cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.hll_sketch_agg(tuple_hash(p), bits).alias(f"sketch{len(p)}") for p in prefixes],
        *[F.expr(f"sum({' + '.join(value_bytes(c, types[c]) for c in p)}) AS bytes{len(p)}") for p in prefixes])


def merged_density(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The density vector of a table from the sketches of its partitions; distinct values are within ``distinct_error``. A NULL counts as a value."""
    n = len(columns)
    one = sketches.agg(
        F.sum("rows").alias("rows"), *[F.hll_sketch_estimate(F.hll_union_agg(f"sketch{i}")).alias(f"d{i}") for i in range(1, n + 1)],
        *[(F.sum(f"bytes{i}") / F.sum("rows")).alias(f"len{i}") for i in range(1, n + 1)])
    stacked = ", ".join(f"{i}, d{i}, len{i}, '{','.join(columns[:i])}'" for i in range(1, n + 1))
    return one.selectExpr("rows", f"stack({n}, {stacked}) AS (density_number, distinct_values, average_length, columns)").select(
        "density_number", F.try_divide(F.lit(1.0), F.col("distinct_values")).alias("all_density"), "distinct_values", "average_length", "columns", "rows")


def frequent_error(rows: int, tracked: int = TRACKED) -> float:
    """A value with more rows than this is in a sketch of frequent values for certain: twice its error, 3.5 rows a slot of its table."""
    slots = 1 << (-(-4 * tracked // 3) - 1).bit_length()
    return 7.0 * rows / slots


def heavy_hitters(df: DataFrame, key: str, n: int = 10, tracked: int = TRACKED) -> DataFrame:
    """The ``n`` most frequent values of a key with their exact rows (key_value, number_of_rows), ties by value; as ``top_values``.

    A first pass keeps candidates in sketches of a fixed size, a second one counts the candidates, so neither shuffles all keys. No value that
    is missing among the candidates can have more rows than the sketch's error, nor more than the rows that are not counted: where the n-th candidate
    has more than that, the result is proven. Where it has not, because nearly all values are as rare as each other, all
    other values are counted too.
    """
    if not 0 < n <= tracked:
        raise ValueError("n must be between 1 and the number of tracked values")
    dtype = df.schema[key].dataType
    value = F.col(key) + F.lit(0).cast(dtype) if isinstance(dtype, (T.FloatType, T.DoubleType)) else F.col(key)  # no negative zero
    keys = df.select(value.alias("key"))
    partial = keys.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(key, {tracked}) FILTER (WHERE key IS NOT NULL) AS sketch"), F.count("key").alias("rows"), F.count(F.lit(1)).alias("every"))
    found = written(partial.groupBy(F.lit("all").alias("part")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked}) AS sketch"), F.sum("rows").alias("rows"), F.sum("every").alias("every")).select(
        F.expr(f"approx_top_k_estimate(sketch, {tracked}).item AS items"), "rows", "every"), "candidates")
    rows, every = found.select("rows", "every").first() or (0, 0)  # no row for an empty table
    items = found.select(F.explode("items").alias("key")).filter("key IS NOT NULL")  # at most ``tracked``
    counted = written(value_counts(keys.join(F.broadcast(items), "key", "left_semi"), "key"), "candidate-counts")
    top = counted.orderBy(F.desc("cnt"), "key").limit(n).collect()
    rest = rows - (counted.agg(F.sum("cnt")).first()[0] or 0)
    least = top[-1].cnt if len(top) == n else 0
    nulls = df.sparkSession.range(1 if every > rows else 0).select(F.lit(None).cast(dtype).alias("key"), F.lit(every - rows).cast("long").alias("cnt"))
    whole = counted.unionByName(nulls)
    if rest and least <= min(rest, frequent_error(rows, tracked)):
        # none of the values left has more rows than the sketch's error, so they are dealt out evenly and a task holds few of them
        others = keys.filter("key IS NOT NULL").join(F.broadcast(items), "key", "left_anti")
        whole = whole.unionByName(value_counts(others.repartition(-(-rest // ROWS_AT_ONCE), "key"), "key"))
    return whole.orderBy(F.desc("cnt"), "key").limit(n).filter("cnt > 1").select(F.col("key").alias("key_value"), F.col("cnt").alias("number_of_rows"))
