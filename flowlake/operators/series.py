"""Time series and distribution tables: A5, A13-A17 and the traffic overview.

All are one hash aggregate with partial (map-side) aggregation; outputs are
bounded by the number of time buckets or bins, never by the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions.time import floor_time


def _dtype(df: DataFrame, col: str):
    return df.schema[col].dataType


def traffic_overview(df: DataFrame, ts: str = "ts", unit: str = "hour", size: str = "packet_size",
                     source: str = "src_ip", ndigits: int = 4) -> DataFrame:
    """Per time bucket: packets, bytes, mean size, distinct sources (A13 + A14)."""
    bucket = floor_time(ts, unit, _dtype(df, ts)).alias("bucket")
    return (df.groupBy(bucket)
              .agg(F.count(F.lit(1)).alias("packets"),
                   F.sum(size).cast("long").alias("bytes"),
                   F.round(F.avg(size), ndigits).alias("mean_size"),
                   F.countDistinct(source).alias("distinct_sources")))


def counts_per_period(df: DataFrame, ts: str = "ts", unit: str = "hour") -> DataFrame:
    """Rows per hour or day; empty buckets are not emitted."""
    bucket = floor_time(ts, unit, _dtype(df, ts)).alias("bucket")
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("packets"))


def mean_per_hour(df: DataFrame, ts: str = "ts", value: str = "packet_size", ndigits: int = 4) -> DataFrame:
    """Mean of a value per hour of day."""
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.round(F.avg(value), ndigits).alias("mean_size"))


def hour_distribution(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A5: packets per hour of day."""
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("packets"))


def peak_hour(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A5: the modal hour, smallest hour on ties (one row)."""
    return hour_distribution(df, ts).orderBy(F.desc("packets"), F.asc("hour")).limit(1)


def top_categories(df: DataFrame, col: str, n: int = 5, order: str = "count") -> list:
    """The n pivot levels of A15: by count (ties by name) or by name."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).count()
    if order == "name":
        counts = counts.orderBy(col)
    else:
        counts = counts.orderBy(F.desc("count"), F.asc(col))
    return [r[0] for r in counts.limit(n).collect()]  # n values, bounded


def protocol_hour_long(df: DataFrame, ts: str = "ts", cat: str = "protocol") -> DataFrame:
    """A15 long form: (hour, protocol, packets)."""
    return (df.where(F.col(cat).isNotNull())
              .groupBy(F.hour(ts).alias("hour"), F.col(cat))
              .agg(F.count(F.lit(1)).alias("packets")))


def protocol_hour_matrix(df: DataFrame, ts: str = "ts", cat: str = "protocol",
                         values: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """Hour x protocol counts, missing = 0.  Pivot values are given, or
    the n most frequent (one small aggregate collects n names)."""
    vals = list(values) if values is not None else top_categories(df, cat, n)
    wide = (df.where(F.col(cat).isin(vals))
              .groupBy(F.hour(ts).alias("hour"))
              .pivot(cat, vals).agg(F.count(F.lit(1))))
    hours = df.select(F.hour(ts).alias("hour")).distinct()
    out = hours.join(wide, "hour", "left").fillna(0, subset=vals)
    return out.select("hour", *[F.col(v).cast("long").alias(v) for v in vals])


def anomalies_per_hour(df: DataFrame, ts: str = "ts", pred: str = "prediction") -> DataFrame:
    """Anomalous (-1) and normal (1) rows per hour."""
    return df.groupBy(F.hour(ts).alias("hour")).agg(
        F.count_if(F.col(pred) == -1).alias("anomalous"),
        F.count_if(F.col(pred) == 1).alias("normal"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram, last bin closed, all bins emitted.

    The range comes from one aggregate (one row, broadcast); an empty range
    widens to [x - 0.5, x + 0.5] as NumPy does.
    """
    spark = df.sparkSession
    rng = (df.agg(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx"))
             .select(F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                     F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi")))
    vals = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(F.col(col).cast("double").alias("x"))
    binned = (vals.crossJoin(F.broadcast(rng))
                  .select(F.least(F.floor((F.col("x") - F.col("lo")) * F.lit(float(bins))
                                          / (F.col("hi") - F.col("lo"))).cast("int"),
                                  F.lit(bins - 1)).alias("bin"))
                  .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    edges = (spark.range(bins).select(F.col("id").cast("int").alias("bin"))
                  .crossJoin(F.broadcast(rng))
                  .select("bin",
                          (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / F.lit(float(bins))).alias("lower"),
                          (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / F.lit(float(bins))).alias("upper"),
                          F.col("lo").isNotNull().alias("_has")))
    return (edges.where("_has").drop("_has").join(binned, "bin", "left")
                 .select("bin", "lower", "upper", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))
