"""What to profile: tables with their clock, and statistics declared on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableDef:
    name: str
    database: str
    as_of: str
    cutoffs: tuple[str, ...]  # refresh times, newest first, four at most
    ts_column: str | None = None  # append time of a row; without one every row counts as old
    fixed_modifications: int = 0  # change counter where no append time exists
    is_partitioned: bool = False
    auto_update: bool = True
    auto_create: bool = True
    dynamic_threshold: bool = True

    def __post_init__(self):
        if not 1 <= len(self.cutoffs) <= 4:
            raise ValueError(f"{self.name}: one to four cutoffs are kept")
        if list(self.cutoffs) != sorted(self.cutoffs, reverse=True):
            raise ValueError(f"{self.name}: cutoffs go from newest to oldest")


@dataclass(frozen=True)
class StatDef:
    rowid: int
    table: str
    name: str
    columns: tuple[str, ...]
    kind: str  # Index_Statistic | User_Created | Auto_Created
    stored_columns: tuple[str, ...] = ()
    filter: str | None = None
    sample_pct: int | None = None
    sample_on: str | None = None
    persisted_sample_pct: int = 0
    no_recompute: bool = False
    is_incremental: bool = False
    with_histogram: bool = True

    @property
    def stored(self) -> tuple[str, ...]:
        return self.stored_columns or self.columns


@dataclass(frozen=True)
class Reference:
    """A declared reference from columns of one table to columns of another."""
    name: str
    database: str
    table: str
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]


STAT_DEF_SCHEMA = T.StructType([
    T.StructField("rowid", T.IntegerType()),
    T.StructField("database_name", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("stats_name", T.StringType()),
    T.StructField("stats_id", T.IntegerType()),
    T.StructField("stat_columns", T.ArrayType(T.StringType())),
    T.StructField("stored_columns", T.ArrayType(T.StringType())),
    T.StructField("key_column_name", T.StringType()),
    T.StructField("key_column_data_type", T.StringType()),
    T.StructField("statistic_type", T.StringType()),
    T.StructField("filter_definition", T.StringType()),
    T.StructField("persisted_sample_percent", T.IntegerType()),
    T.StructField("no_recompute", T.BooleanType()),
    T.StructField("is_incremental", T.BooleanType()),
    T.StructField("with_histogram", T.BooleanType()),
    T.StructField("is_table_partitioned", T.BooleanType()),
    T.StructField("is_auto_update_stats_on", T.BooleanType()),
    T.StructField("is_auto_create_stats_on", T.BooleanType()),
    T.StructField("dynamic_threshold", T.BooleanType()),
    T.StructField("fixed_modifications", T.LongType()),
    T.StructField("last_updated", T.StringType()),
    T.StructField("as_of", T.StringType()),
    T.StructField("number_of_columns_in_this_table", T.IntegerType()),
])


def stat_def_frame(spark: SparkSession, frames: dict[str, DataFrame], tables: list[TableDef], stats: list[StatDef]) -> DataFrame:
    """The declarations as a frame: one row per statistic, with facts of the table schema."""
    by_name = {t.name: t for t in tables}
    position: dict[str, int] = {}
    rows = []
    for s in sorted(stats, key=lambda s: s.rowid):
        t, schema = by_name[s.table], frames[s.table].schema
        position[s.table] = position.get(s.table, 0) + 1
        rows.append((
            s.rowid, t.database, s.table, s.name, position[s.table], list(s.columns), list(s.stored), s.columns[0],
            schema[s.columns[0]].dataType.simpleString(), s.kind, s.filter, s.persisted_sample_pct, s.no_recompute,
            s.is_incremental, s.with_histogram, t.is_partitioned, t.auto_update, t.auto_create, t.dynamic_threshold,
            t.fixed_modifications, t.cutoffs[0], t.as_of, len(schema),
        ))
    df = spark.createDataFrame(rows, STAT_DEF_SCHEMA)
    return (
        df.withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))
        .withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))
    )


def stat_columns(stat_def: DataFrame) -> DataFrame:
    """Column lists of each statistic in key order and in stored order, as text."""
    return stat_def.select(
        "rowid",
        F.array_join("stat_columns", ",").alias("key_order"),
        F.array_join("stored_columns", ",").alias("stored_order"),
    )


def in_sample(name: str, dtype: T.DataType, pct: int) -> str:
    """SQL text of a repeatable sample: the same key is always in or always out."""
    whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number = f"`{name}`" if whole else f"xxhash64(`{name}`)"
    return f"coalesce(pmod({number}, 100) < {pct}, false)"
