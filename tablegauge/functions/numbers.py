"""Rounded ratios, refresh threshold, default sample size and storage size formulas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

PAGE_BYTES = 8192
LARGE_VALUE_BYTES = 8000


def ratio(a: Column, b: Column, digits: int, factor: int = 1) -> Column:
    """``a * factor / b`` rounded half up to ``digits`` places, as double; NULL when b is 0. Neither may be negative.

    Rounded once, by a whole division: a decimal quotient would already be rounded to six places.
    """
    divisor = F.nullif(b.cast("decimal(24,4)"), F.lit(0).cast("decimal(24,4)"))
    scale = F.lit(2 * factor * 10 ** digits).cast("decimal(10,0)")
    whole = F.call_function("div", a.cast("decimal(24,4)") * scale + divisor, divisor * 2)
    return whole.cast("double") / float(10 ** digits)


def or_one(c: Column) -> Column:
    """0 and NULL read as 1, for divisors."""
    return F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(1)).otherwise(c)


def threshold_type(rows: Column, dynamic: bool = True) -> Column:
    if not dynamic:
        return F.lit("Static")
    return F.when(F.coalesce(rows, F.lit(0)) >= 25001, "Dynamic").otherwise("Static")


def auto_threshold(rows: Column, dynamic: bool = True) -> Column:
    """Modifications after which a statistic is refreshed."""
    n = F.coalesce(rows, F.lit(0)).cast("long")
    static = F.when(n <= 500, F.lit(501).cast("long")).otherwise(F.lit(500) + (n.cast("decimal(20,0)") * F.lit("0.2").cast("decimal(2,1)")).cast("long"))
    if not dynamic:
        return static
    return F.when(n >= 25001, F.sqrt(n * 1000).cast("long")).otherwise(static)


def density_values(density: Column) -> Column:
    """Distinct values a density stands for: trunc(1 / density), 0 read as 1."""
    d = F.when(density == 0, F.lit(1.0)).otherwise(density)
    # 1/(1/n) may fall a hair short of n in floating point, so round before truncating
    return F.round(F.lit(1.0) / d, 6).cast("long")


def default_sample_rows(rows: Column) -> Column:
    """ceil(15 * rows ^ 0.55)."""
    return F.ceil(F.round(F.lit(15.0) * F.pow(rows.cast("double"), F.lit(0.55)), 6)).cast("long")


FIXED_BYTES = {
    T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
    T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def value_bytes(name: str, dtype: T.DataType) -> str:
    """SQL text of the stored size of one value; NULL counts 0."""
    size = FIXED_BYTES.get(type(dtype))
    if isinstance(dtype, T.DecimalType):
        size = 9 if dtype.precision <= 19 else 17
    if size is not None:
        return f"CAST(IF(`{name}` IS NULL, 0, {size}) AS BIGINT)"
    value = f"`{name}`" if isinstance(dtype, (T.StringType, T.BinaryType)) else f"to_json(named_struct('v', `{name}`))"
    return f"CAST(coalesce(octet_length({value}), 0) AS BIGINT)"


def pages(size: Column) -> Column:
    return F.ceil(size.cast("decimal(30,0)") / F.lit(PAGE_BYTES)).cast("long")
