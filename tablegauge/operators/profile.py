"""Single statistics computed straight from a table: header, density vector, partition statistics, usage, references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import seconds_text
from ..functions.numbers import auto_threshold, ratio, threshold_type, value_bytes
from ..sources.definitions import in_sample
from .histogram import MAX_STEPS, histogram_of_counts


def sampled(df: DataFrame, on: str, pct: int) -> DataFrame:
    return df.filter(in_sample(on, df.schema[on].dataType, pct))


def stat_header(df: DataFrame, columns: Sequence[str], where: str | None = None, sample_on: str | None = None,
                sample_pct: int | None = None, approx: bool = False) -> DataFrame:
    """Rows, sampled rows, density and key size of one statistic in one pass."""
    types = {f.name: f.dataType for f in df.schema}
    key = columns[0]
    keep = f"coalesce({where}, false)" if where else "true"
    smp = in_sample(sample_on or key, types[sample_on or key], sample_pct) if sample_pct is not None else "true"
    one = F.when(F.expr(f"{keep} AND {smp}"), F.struct(F.col(key).alias("k")))
    distinct = F.approx_count_distinct(one) if approx else F.count_distinct(one)
    return df.agg(
        F.expr(f"count_if({keep}) AS rows"), F.expr(f"count_if({keep} AND {smp}) AS rows_sampled"),
        distinct.alias("distinct_values"),
        F.expr(f"avg(IF({keep} AND {smp}, {value_bytes(key, types[key])}, NULL)) AS average_key_length"),
        F.count(F.lit(1)).alias("unfiltered_rows"),
    ).select(
        "rows", "rows_sampled", ratio(F.col("rows_sampled"), F.greatest("rows", F.lit(1)), 2, 100).alias("percent_sampled"),
        "distinct_values", F.try_divide(F.lit(1.0), F.col("distinct_values")).alias("density"), "average_key_length",
        "unfiltered_rows",
    )


def distinct_from_sample(sample: DataFrame, key: str, rows: int | Column) -> DataFrame:
    """Distinct values of a whole table from a sample of its rows, with the bounds between which they lie.

    A value that the sample has once stands for one to rows / sample rows values, one that it has more often for itself; the estimate takes
    the geometric mean for the former, whose error is within the root of that ratio (the guaranteed-error estimator).
    """
    seen = sample.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    one = seen.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("rows_sampled"), F.count(F.lit(1)).alias("distinct_in_sample"), F.count_if(F.col("times") == 1).alias("seen_once"))
    total = rows if isinstance(rows, Column) else F.lit(rows).cast("long")
    once, scale = F.col("seen_once"), F.try_divide(total, F.col("rows_sampled"))
    often = F.col("distinct_in_sample") - once
    return one.select(
        "rows_sampled", "distinct_in_sample", "seen_once", F.round(F.coalesce(F.sqrt(scale) * once + often, F.lit(0.0)), 4).alias("estimate"),
        F.col("distinct_in_sample").alias("at_least"), F.least(F.ceil(F.coalesce(scale * once + often, F.lit(0.0))), total).alias("at_most"))


def snapshot_changes(before: DataFrame, after: DataFrame, key: Sequence[str], by: str | None = None) -> DataFrame:
    """Rows inserted, deleted and updated between two snapshots: a row is known by its key and compared by a hash of its other columns.

    Keys may repeat: rows of one key that are in both snapshots with equal columns are unchanged, of the others as many as both have count as updated.
    With ``by``, a column of the key, there is a row for each of its values. Both sides meet in one aggregation, without a join.
    """
    rest = [c for c in before.columns if c not in key]
    if set(before.columns) != set(after.columns):
        raise ValueError("snapshots differ in their columns")

    def side(df: DataFrame, old: int) -> DataFrame:
        return df.select(*key, F.xxhash64(*rest).alias("row_hash"), F.lit(old).alias("is_old"))

    both = side(before, 1).unionByName(side(after, 0)).groupBy(*key, "row_hash").agg(F.sum("is_old").alias("old"), F.sum(1 - F.col("is_old")).alias("new"))
    gone, come = F.greatest(F.col("old") - F.col("new"), F.lit(0).cast("long")), F.greatest(F.col("new") - F.col("old"), F.lit(0).cast("long"))
    per_key = both.groupBy(*key).agg(F.sum(gone).alias("gone"), F.sum(come).alias("come"), F.sum(F.least("old", "new")).alias("unchanged"))
    updated = F.least("gone", "come")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(name)
    return (per_key.groupBy(by) if by else per_key.groupBy()).agg(
        total(F.col("come") - updated, "inserts"), total(F.col("gone") - updated, "deletes"), total(updated, "updates"), total(F.col("unchanged"), "unchanged"))


def density_vector(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Density of each column prefix. All prefixes are counted in one aggregation."""
    types = {f.name: f.dataType for f in df.schema}
    count = F.approx_count_distinct if approx else F.count_distinct
    prefixes = [list(columns[:n]) for n in range(1, len(columns) + 1)]
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[count(F.struct(*p)).alias(f"d{len(p)}") for p in prefixes],
        *[F.expr(f"avg({' + '.join(value_bytes(c, types[c]) for c in p)}) AS len{len(p)}") for p in prefixes],
    )
    stacked = ", ".join(f"{len(p)}, d{len(p)}, len{len(p)}, '{','.join(p)}'" for p in prefixes)
    return one.selectExpr("rows", f"stack({len(prefixes)}, {stacked}) AS (density_number, distinct_values, average_length, columns)").select(
        "density_number", F.try_divide(F.lit(1.0), F.col("distinct_values")).alias("all_density"), "distinct_values", "average_length", "columns",
        ratio(F.col("rows"), F.col("distinct_values"), 4).alias("rows_per_value"),
    )


def partition_stats(df: DataFrame, key: str, part: Column) -> DataFrame:
    """Value counts kept per partition, the state from which table statistics are merged."""
    return df.groupBy(part.cast("string").alias("part"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("cnt"))


def write_partition_stats(counts: DataFrame, path: str) -> None:
    """Replace only the partitions present in ``counts``; the others stay as written before."""
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def merge_partitions(counts: DataFrame) -> DataFrame:
    """Value counts of the whole table from those of its partitions."""
    return counts.groupBy("key").agg(F.sum("cnt").alias("cnt"))


def refresh_partitions(df: DataFrame, key: str, part: Column, changed: Sequence[str], path: str) -> DataFrame:
    """Rebuild the stored value counts of the ``changed`` partitions from ``df`` and return those of all partitions.

    Of ``df`` only rows of changed partitions are read, whole files of others are left out where it is stored by ``part``; a partition
    that has no rows any more loses its counts.
    """
    counts = partition_stats(df.filter(part.cast("string").isin(*changed)), key, part)
    write_partition_stats(counts, path)
    kept = df.sparkSession.read.schema(counts.schema).parquet(path)
    found = {r.part for r in counts.select("part").distinct().collect()}  # no more than ``changed``
    return kept.filter(~F.col("part").isin(*[c for c in changed if c not in found])) if found != {*changed} else kept


def merged_histogram(counts: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """The histogram of a whole table from the value counts of its partitions, without reading the table."""
    return histogram_of_counts(merge_partitions(counts), max_steps)


def changed_partitions(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Per partition: rows, values, changes, and whether the changes pass the refresh threshold of that partition."""
    size = counts.groupBy("part").agg(F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("distinct_values"))
    return size.join(changes, "part", "left").select(
        "part", "rows", "distinct_values", F.coalesce("changes", F.lit(0)).alias("changes"),
        auto_threshold(F.col("rows"), False).alias("threshold"),
        (F.coalesce("changes", F.lit(0)) >= auto_threshold(F.col("rows"), False)).alias("needs_rebuild"),
    )


def sketch_partitions(df: DataFrame, key: str, part: Column) -> DataFrame:
    """A distinct-count sketch per partition; ``merge_sketches`` joins them without reading the table again."""
    return df.groupBy(part.cast("string").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(key).alias("sketch"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def usage_rollup(log: DataFrame, by: Sequence[str], counters: dict[str, str], waits: str = "waits") -> DataFrame:
    """Usage counters summed over partitions, and the time of waits: its sum, average and text.

    ``counters`` maps the name of a counter to the ``kind`` of access that it counts, such as range scans, lookups, latch waits or leaf
    changes; ``waits`` is the one of them whose ``wait_ms`` is summed.
    """
    counted = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    ms = F.coalesce(F.sum(F.when(F.col("kind") == counters[waits], F.col("wait_ms"))), F.lit(0))
    g = log.groupBy(*by).agg(*[counted(kind).alias(name) for name, kind in counters.items()], ms.alias("wait_ms"))
    return g.select(
        *by, *counters, "wait_ms",
        F.when(F.col(waits) > 0, ratio(F.col("wait_ms"), F.col(waits), 2)).otherwise(0.0).alias("avg_wait_ms"),
        seconds_text(F.call_function("div", F.col("wait_ms"), F.lit(1000).cast("long"))).alias("wait_time"),
    )


def attach_usage(objects: DataFrame, usage: DataFrame, on: str) -> DataFrame:
    """Usage of each object, also of those never used; the last use is the newest of three times."""
    return objects.join(usage, on, "left").withColumn("last_used", F.greatest("last_seek", "last_scan", "last_lookup"))


def thresholds(counts: DataFrame) -> DataFrame:
    """Refresh thresholds for frames with ``name`` and ``rows``."""
    return counts.select(
        "name", "rows", threshold_type(F.col("rows")).alias("threshold_type"),
        auto_threshold(F.col("rows")).alias("threshold"), auto_threshold(F.col("rows"), False).alias("static_threshold"))


def reference_pairs(stat: DataFrame, plans: DataFrame) -> DataFrame:
    """Which query hash uses which statistic: ``plans`` has query_hash and a comma separated ``stats_list``."""
    named = plans.filter("stats_list <> ''").select(
        "query_hash", F.explode(F.split("stats_list", ",")).alias("n")).select("query_hash", F.trim("n").alias("fqn_stats_name")).distinct()
    return stat.select("rowid", "fqn_stats_name").join(named, "fqn_stats_name")


def reference_count(stat: DataFrame, plans: DataFrame) -> DataFrame:
    """Number of query hashes that use each statistic and their list; both NULL when there is none.

    The list is as long as the number of distinct hashes; pass plans cut to the heaviest ones (``log_top``).
    """
    used = reference_pairs(stat, plans).groupBy("rowid").agg(
        F.count(F.lit(1)).alias("plan_reference_count"), F.array_join(F.array_sort(F.collect_list("query_hash")), ",").alias("query_hashes"))
    return stat.select("rowid", "fqn_stats_name").join(used, "rowid", "left")
