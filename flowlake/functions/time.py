"""Time scalar functions F7-F10 (native expressions).

Timestamps without zone stay without zone: ``date_trunc`` answers a zoned
timestamp, so results are cast back.  Sessions run in UTC (see session.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_to_timestamp(col) -> Column:
    """epoch seconds (double, micro precision kept) to timestamp_ntz."""
    micros = F.round(_c(col) * 1_000_000).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def text_to_timestamp(col, fmt: str | None = None) -> Column:
    """text to timestamp_ntz, bad text -> NULL."""
    ts = F.try_to_timestamp(_c(col), F.lit(fmt)) if fmt else F.try_to_timestamp(_c(col))
    return ts.cast("timestamp_ntz")


def timestamp_to_epoch(col) -> Column:
    """timestamp (with or without zone) to epoch seconds as double."""
    return F.unix_micros(_c(col).cast("timestamp")) / F.lit(1_000_000.0)


def floor_time(col, unit: str = "hour", dtype: T.DataType | None = None) -> Column:
    """truncate to 'hour' | 'day' | ...; keeps timestamp_ntz input as ntz."""
    out = F.date_trunc(unit, _c(col))
    if dtype is None or isinstance(dtype, T.TimestampNTZType):
        return out.cast("timestamp_ntz")
    return out


def with_time_parts(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """F8: hour, day_of_week (Monday = 0), is_weekend."""
    return df.withColumns({
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
    }).withColumn("is_weekend", F.col("day_of_week").isin(5, 6))
