"""One ordered struct type that holds a key of any scalar type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

KEY_TYPE = T.StructType([
    T.StructField("l", T.LongType()),
    T.StructField("d", T.DecimalType(38, 9)),
    T.StructField("f", T.DoubleType()),
    T.StructField("s", T.StringType()),
    T.StructField("t", T.TimestampNTZType()),
])


def slot_of(dtype: T.DataType) -> str:
    """Name of the struct field that carries keys of this type."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "l"
    if isinstance(dtype, T.DecimalType):
        if dtype.scale > 9 or dtype.precision - dtype.scale > 29:
            raise TypeError(f"{dtype.simpleString()} does not fit the key type decimal(38,9)")
        return "d"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "f"
    if isinstance(dtype, T.StringType):
        return "s"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "t"
    raise TypeError(f"no ordered key for {dtype.simpleString()}")


def key_sql(name: str | None, dtype: T.DataType | None) -> str:
    """SQL text of the key struct of a column; without a column a NULL key."""
    slot = slot_of(dtype) if name else None
    fields = [f"'{f.name}', CAST({f'`{name}`' if f.name == slot else 'NULL'} AS {f.dataType.simpleString()})" for f in KEY_TYPE]
    return f"named_struct({', '.join(fields)})"


def key_is_null(k: str = "hi") -> Column:
    return F.expr(key_is_null_sql(k))


def key_is_null_sql(k: str = "hi") -> str:
    return "(" + " AND ".join(f"{k}.{f.name} IS NULL" for f in KEY_TYPE) + ")"


def native_key(k: Column, dtype: T.DataType) -> Column:
    return k[slot_of(dtype)].cast(dtype)


def key_text(k: Column) -> Column:
    """The key as text; NULL for a NULL key."""
    return F.coalesce(
        k["l"].cast("string"), k["d"].cast("string"), k["f"].cast("string"), k["s"],
        F.date_format(k["t"], "yyyy-MM-dd HH:mm:ss"),
    )


def key_date(k: Column) -> Column:
    return k["t"].cast("date")
