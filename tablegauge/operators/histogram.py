"""Step histograms from value counts.

Every statistic of every table goes through the same distributed steps at once:

1. ``value counts``: one row per (statistic, key) with a count for each snapshot, written to the shared folder in key
   order together with the number of the range partition it fell in. The written number never changes, also when an
   executor is lost and files are read again.
2. Totals per (statistic, range partition), a few rows, give each partition its starting offset.
3. Running counts inside a partition plus its offset are running counts over the whole key order, so no window ever
   sees more than one range partition.
4. Only the keys that end a step survive (200 at most); range rows and range values are differences between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import key_is_null, key_sql, native_key
from ..session import written

MAX_STEPS = 200
#: Value counts that a range partition holds on average, however many there are in all.
KEYS_AT_ONCE = 250_000


def written_counts(counts: DataFrame, order: list[str]) -> DataFrame:
    """Value counts in the shared folder, range partitioned and numbered (``pid``)."""
    kept = written(counts, "unordered-counts")  # counted once, however often they are read to find and fill the ranges
    ranges = -(-kept.count() // KEYS_AT_ONCE) or 1
    return written(kept.repartitionByRange(ranges, *order).withColumn("pid", F.spark_partition_id()), "value-counts")


def _offsets(counts: DataFrame, snaps: list[int]) -> DataFrame:
    """Per (rowid, pid): rows and keys before this partition, and totals of the statistic, for each snapshot."""
    sums = counts.groupBy("rowid", "pid").agg(
        *[F.sum(f"s{h}").alias(f"n{h}") for h in snaps], *[F.expr(f"count_if(s{h} > 0) AS d{h}") for h in snaps])
    before = "OVER (PARTITION BY rowid ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = "OVER (PARTITION BY rowid)"
    return sums.selectExpr("rowid", "pid", *[
        text for h in snaps for text in (
            f"coalesce(sum(n{h}) {before}, 0) AS off{h}", f"coalesce(sum(d{h}) {before}, 0) AS rnoff{h}",
            f"sum(n{h}) {whole} AS total{h}", f"sum(d{h}) {whole} AS keys{h}")
    ])


def histogram_steps(counts: DataFrame, snaps: list[int], max_steps: int = MAX_STEPS) -> DataFrame:
    """Steps of every statistic and snapshot.

    ``counts`` has rowid, hi (key struct), pid and s1..sn (rows of the key in snapshot 1..n). The result has rowid, snap,
    stepnumber, hi, range_rows, eq_rows, distinct_range_rows, avg_range_rows.
    """
    if not 3 <= max_steps <= 10000:
        raise ValueError("max_steps must be between 3 and 10000")
    heavy = (max_steps - 1) // 2
    keyed = counts.filter(~key_is_null())

    # as many tasks as range partitions; the rows that a window holds are narrow, totals come after it
    ranges = (counts.agg(F.max("pid")).first()[0] or 0) + 1
    order = "OVER (PARTITION BY rowid, pid ORDER BY hi"
    narrow = keyed.select("rowid", "hi", "pid", *[f"s{h}" for h in snaps])
    local = (narrow.repartition(ranges, "rowid", "pid") if ranges > 1 else narrow).selectExpr("*", *[
        text for h in snaps for text in (
            f"sum(s{h}) {order} ROWS UNBOUNDED PRECEDING) AS up_to{h}", f"count_if(s{h} > 0) {order} ROWS UNBOUNDED PRECEDING) AS place{h}",
            f"lead(IF(s{h} > 0, s{h}, NULL)) IGNORE NULLS {order}) AS after{h}")])
    figures = [f"named_struct('snap', {h}, 'cnt', s{h}, 'up_to', up_to{h}, 'place', place{h}, 'after', after{h})" for h in snaps]
    here = local.selectExpr("rowid", "pid", "hi", f"explode(array({', '.join(figures)})) AS x").select("rowid", "pid", "hi", "x.*").filter("cnt > 0")
    # the offsets have one row per statistic, range partition that holds a part of it, and snapshot
    before = [f"named_struct('snap', {h}, 'off', off{h}, 'rnoff', rnoff{h}, 'total', total{h}, 'keys', keys{h})" for h in snaps]
    offsets = _offsets(keyed, snaps).selectExpr("rowid", "pid", f"explode(array({', '.join(before)})) AS x").select("rowid", "pid", "x.*")
    running = here.join(F.broadcast(offsets), ["rowid", "pid", "snap"]).selectExpr(
        "rowid", "snap", "hi", "cnt", "off + up_to AS cum", "rnoff + place AS rn", "after", "total", "keys")
    # A key ends a step when it stands alone or the next key is in another bucket. The last key of a range partition does
    # not see the next one; it stays a candidate and is settled below, among a few rows.
    candidates = running.selectExpr(
        "rowid", "snap", "hi", "cnt", "cum", "rn", f"(cum * {heavy} + total - 1) div total AS bucket",
        f"((cum + after) * {heavy} + total - 1) div total AS next_bucket", f"(rn = 1 OR keys <= {max_steps} OR cnt * {heavy} >= total) AS alone",
    ).filter("alone OR next_bucket IS NULL OR next_bucket <> bucket")
    last = F.max("rn").over(Window.partitionBy("rowid", "snap", "bucket"))
    ends = candidates.withColumn("last_of_bucket", last).filter("alone OR rn = last_of_bucket")
    by_step = Window.partitionBy("rowid", "snap").orderBy("rn")
    steps = ends.select(
        "rowid", "snap", F.row_number().over(by_step).alias("stepnumber"), "hi",
        (F.col("cum") - F.col("cnt") - F.coalesce(F.lag("cum").over(by_step), F.lit(0))).alias("range_rows"),
        F.col("cnt").alias("eq_rows"),
        (F.col("rn") - 1 - F.coalesce(F.lag("rn").over(by_step), F.lit(0))).alias("distinct_range_rows"),
    )

    pairs = ", ".join(f"named_struct('snap', {h}, 'eq_rows', s{h})" for h in snaps)
    nulls = counts.filter(key_is_null()).selectExpr("rowid", "hi", f"explode(array({pairs})) AS x").selectExpr(
        "rowid", "x.snap", "0 AS stepnumber", "hi", "0L AS range_rows", "x.eq_rows", "0L AS distinct_range_rows",
    ).filter("eq_rows > 0")
    renumber = Window.partitionBy("rowid", "snap").orderBy("stepnumber")
    return steps.unionByName(nulls).select(
        "rowid", "snap", F.row_number().over(renumber).alias("stepnumber"), "hi", "range_rows", "eq_rows",
        "distinct_range_rows",
        F.when(F.col("distinct_range_rows") == 0, F.col("range_rows").cast("decimal(28,4)"))
        .otherwise((F.col("range_rows").cast("decimal(20,0)") / F.col("distinct_range_rows").cast("decimal(20,0)")).cast("decimal(28,4)"))
        .alias("avg_range_rows"),
    )


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key value. Partial counts are made before the shuffle, so a hot key costs no more than a cold one."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("cnt"))


def histogram(df: DataFrame, key: str, max_steps: int = MAX_STEPS) -> DataFrame:
    """Step histogram of one column, with ``range_hi_key`` in the type of the column."""
    return histogram_of_counts(value_counts(df, key), max_steps)


def histogram_of_counts(vc: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Step histogram of values (``key``) that come with their rows (``cnt``)."""
    dtype = vc.schema["key"].dataType
    counts = written_counts(
        vc.selectExpr("0 AS rowid", f"{key_sql('key', dtype)} AS hi", "cnt AS s1"),
        ["hi"],
    )
    return histogram_steps(counts, [1], max_steps).select(
        "stepnumber", native_key(F.col("hi"), dtype).alias("range_hi_key"), "range_rows", "eq_rows",
        "distinct_range_rows", "avg_range_rows",
    )
