"""Declarations on the driver's test tables, and logs and plan documents that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.collect import collect
from ..session import shared_folder
from ..sources.definitions import Reference, StatDef, TableDef
from ..sources.tables import read_named

ORDER_CUTOFFS = ("2001-01-01", "2000-01-01", "1999-01-01", "1998-01-01")
EVENT_CUTOFFS = ("2024-01-29", "2024-01-22", "2024-01-15", "2024-01-08")

TABLE_DEFS = [
    TableDef("orders", "sales", "2001-08-02", ORDER_CUTOFFS, "o_orderdate", is_partitioned=True),
    TableDef("lineitem", "sales", "2001-11-05", ORDER_CUTOFFS, "l_shipdate", is_partitioned=True),
    TableDef("events", "web", "2024-01-31", EVENT_CUTOFFS, "ts"),
    TableDef("customer", "sales", "2001-08-02", ("2001-07-25",), fixed_modifications=3),
    TableDef("nation", "sales", "2001-08-02", ("2001-07-25",), fixed_modifications=3),
    TableDef("documents", "text", "2001-08-02", ("2001-07-25",), fixed_modifications=3, auto_update=False),
]

INDEX, AUTO, USER = "Index_Statistic", "Auto_Created", "User_Created"
STAT_DEFS = [
    StatDef(1, "orders", "ix_orderkey", ("o_orderkey",), INDEX),
    StatDef(2, "orders", "ix_cust_date", ("o_custkey", "o_orderdate"), INDEX),
    StatDef(3, "orders", "wa_custkey", ("o_custkey",), AUTO),
    StatDef(4, "orders", "us_orderdate", ("o_orderdate",), USER, is_incremental=True),
    StatDef(5, "orders", "us_status_prio", ("o_orderstatus", "o_orderpriority"), USER),
    StatDef(6, "orders", "wa_prio", ("o_orderpriority",), AUTO),
    StatDef(7, "lineitem", "ix_order_line", ("l_orderkey", "l_linenumber"), INDEX),
    StatDef(8, "lineitem", "wa_partkey", ("l_partkey",), AUTO, sample_pct=20, sample_on="l_orderkey"),
    StatDef(9, "lineitem", "us_shipdate", ("l_shipdate",), USER, no_recompute=True),
    StatDef(10, "lineitem", "wa_flags", ("l_returnflag", "l_linestatus"), AUTO),
    StatDef(11, "lineitem", "us_ship_r", ("l_shipdate",), USER, filter="l_returnflag = 'R'"),
    StatDef(12, "lineitem", "us_qty", ("l_quantity", "l_discount"), USER, stored_columns=("l_discount", "l_quantity"),
            persisted_sample_pct=100),
    StatDef(13, "events", "ix_event_id", ("event_id",), INDEX),
    StatDef(14, "events", "wa_ts", ("ts",), AUTO),
    StatDef(15, "events", "wa_user", ("user_id",), AUTO),
    StatDef(16, "customer", "wa_segment", ("c_mktsegment",), AUTO),
    StatDef(17, "nation", "ix_nation", ("n_nationkey",), INDEX),
    StatDef(18, "documents", "us_text", ("text",), USER),
    StatDef(19, "documents", "_dta_stat_1", ("lang",), USER, with_histogram=False),
    StatDef(20, "lineitem", "us_line", ("l_linenumber",), USER, filter="l_shipdate > '2000-01-01' OR l_linenumber <= 4"),
    StatDef(21, "lineitem", "wa_line", ("l_linenumber",), AUTO, filter="l_shipdate > '2000-01-01' OR l_linenumber > 4",
            sample_pct=50, sample_on="l_orderkey"),
]

REFERENCES = [
    Reference("fk_lineitem_orders", "sales", "lineitem", ("l_orderkey", "l_linenumber"), "orders", ("o_orderkey", "o_line")),
    Reference("fk_lineitem_partsupp", "sales", "lineitem", ("l_partkey", "l_suppkey"), "partsupp", ("ps_partkey", "ps_suppkey")),
    Reference("fk_orders_customer", "sales", "orders", ("o_custkey",), "customer", ("c_custkey",)),
]


def names_of_stats() -> list[str]:
    db = {t.name: t.database for t in TABLE_DEFS}
    return [f"{db[s.table]}.{s.table}.{s.name}" for s in STAT_DEFS]


#: What the events stand for: counter of usage, type of event.
ACCESS_KINDS = {"seeks": "view", "scans": "click", "lookups": "purchase", "changes": "signup", "waits": "error"}


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses of statistics, one per event: which one, what kind and how long ago."""
    ev = read_named(spark, sf_dir, "events")
    return ev.select(
        (F.pmod("event_id", F.lit(len(STAT_DEFS))) + 1).cast("int").alias("rowid"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("partition_number"),
        F.col("event_type").alias("kind"),
        F.floor("value").cast("long").alias("wait_ms"),
        F.timestamp_diff("SECOND", F.col("ts"), F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'")).alias("age"),
    )


def usage_per_statistic(log: DataFrame) -> DataFrame:
    """view = seek, click = scan, purchase = lookup, signup = change, error = wait."""
    def kind(k):
        return F.col("kind") == k
    return log.groupBy("rowid").agg(
        F.count(F.when(kind("view"), 1)).alias("user_seeks"),
        F.count(F.when(kind("click"), 1)).alias("user_scans"),
        F.count(F.when(kind("purchase"), 1)).alias("user_lookups"),
        F.count(F.when(kind("signup"), 1)).alias("user_updates"),
        F.count(F.when(kind("error"), 1)).alias("wait_count"),
        F.coalesce(F.sum(F.when(kind("error"), F.col("wait_ms"))), F.lit(0)).alias("wait_ms"),
        F.min(F.when(kind("view"), F.col("age"))).alias("age_seek"),
        F.min(F.when(kind("click"), F.col("age"))).alias("age_scan"),
        F.min(F.when(kind("purchase"), F.col("age"))).alias("age_lookup"),
    )


_OPEN: dict[str, dict[str, DataFrame]] = {}


def collected(spark: SparkSession, sf_dir: str, refresh: bool = False) -> dict[str, DataFrame]:
    """The collected tables of ``sf_dir``. The first call of a session builds them from the whole test tables."""
    key = f"{spark.sparkContext.applicationId}-{sf_dir.strip('/').replace('/', '-')}"
    if key in _OPEN and not refresh:
        return _OPEN[key]
    frames = {t.name: read_named(spark, sf_dir, t.name) for t in TABLE_DEFS}
    _OPEN[key] = collect(
        spark, frames, TABLE_DEFS, STAT_DEFS, f"{shared_folder(spark)}/collected-{key}", refresh,
        usage=lambda: usage_per_statistic(access_log(spark, sf_dir)),
    )
    return _OPEN[key]
