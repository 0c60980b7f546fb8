"""Registry of named plans over the driver tables.

Each plan is ``(spark, sf_dir) -> DataFrame`` with an optional SQL twin in
DuckDB's dialect.  Every plan reads whole tables; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.session import prepare

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        PLANS[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str, spread_scan: bool = False) -> DataFrame:
    """A driver table; ``spread_scan`` for plans whose per-row work is heavy
    (UDFs, model scoring), where the shuffle pays for itself."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if spread_scan else df


def spread(df: DataFrame) -> DataFrame:
    """Right-size a scan: a file with a single row group reads as one task,
    so when a scan has fewer partitions than the cluster has cores it is
    spread round-robin.  A large input (many splits) is left untouched."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def rounded(df: DataFrame, ndigits: int = 6) -> DataFrame:
    """Round every double column (sum order changes the last digits)."""
    return df.select(*[F.round(F.col(f.name), ndigits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
