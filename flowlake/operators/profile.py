"""Table profile operators A18-A23, P6, P14, P16, P17.

Per-column statistics are computed on a stacked (column, value) form, so a
table of any width is one grouped aggregate instead of one job per column;
value counts use partial aggregation, so a value that fills a third of a
column is one row after the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators.quantiles import exact_quantiles, quantile_values

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns (booleans are not numeric, as in pandas' number dtype)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    """String and boolean columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def _q(c: str):
    return F.col(f"`{c}`")


def _stack(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _q(c).cast(cast).alias("value")) for c in cols
    ])).alias("s")).select("s.column", "s.value")


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    """First n rows, ordered by a key for repeatable output."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def column_types(df: DataFrame) -> DataFrame:
    """Column name, position and Spark type (no job)."""
    spark = df.sparkSession
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "position int, column string, dtype string")


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column (all columns)."""
    one = df.agg(*[F.count_if(_q(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _q(c).alias("missing")) for c in df.columns])).alias("s")).select("s.*")


def missing_top(df: DataFrame, k: int = 30) -> DataFrame:
    """Columns with missing values, most first (ties by name), top k;
    empty when nothing is missing."""
    m = missing_counts(df).where(F.col("missing") > 0)
    return m.orderBy(F.desc("missing"), F.asc("column")).limit(k)


def column_sums(df: DataFrame) -> DataFrame:
    """Sum of every numeric column."""
    cols = numeric_columns(df)
    one = df.agg(*[F.sum(_q(c)).cast("double").alias(c) for c in cols])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _q(c).alias("sum")) for c in cols])).alias("s")).select("s.*")


def variance_rank(df: DataFrame, k: int = 5) -> DataFrame:
    """Numeric columns by sample variance, largest first, top k."""
    cols = numeric_columns(df)
    one = df.agg(*[F.var_samp(_q(c)).alias(c) for c in cols])
    v = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _q(c).alias("variance")) for c in cols])).alias("s")).select("s.*")
    return v.where(F.col("variance").isNotNull()).orderBy(F.desc("variance"), F.asc("column")).limit(k)


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair, pairwise complete, for any number of columns.

    Each task adds up, for all pairs at once, the counts, sums, squares and cross products of the rows where both
    columns are present (matrix products over Arrow batches of values less the column's mean); the partial sums are one
    grouped aggregate by pair.  A column that is constant on a pair's rows gives NULL."""
    cols = list(cols) if cols else numeric_columns(df)
    d = len(cols)
    x = df.select(*[_q(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    mean = x.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in x.columns]).first()
    shift = np.array([m if m is not None else 0.0 for m in mean])

    def sums(batches):
        acc = np.zeros((4, d, d))
        for batch in batches:
            A = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]) - shift
            for i in range(0, len(A), 4096):
                part = A[i:i + 4096]
                there = ~np.isnan(part)
                V, M = np.where(there, part, 0.0), there.astype("float64")
                acc += [M.T @ M, V.T @ M, (V * V).T @ M, V.T @ V]
        i, j = np.triu_indices(d)
        n, s, q, c = acc
        cols_ = [i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], c[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols_], ["i", "j", "n", "si", "sj", "qi", "qj", "c"])
    part = x.mapInArrow(sums, "i long, j long, n double, si double, sj double, qi double, qj double, c double")
    tot = part.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in ("n", "si", "sj", "qi", "qj", "c")])

    def spread(q: str, s: str):         # what rounding leaves of a constant column counts as 0
        v = F.col(q) - F.col(s) * F.col(s) / F.col("n")
        return F.when((F.col("n") > 1) & (v > F.col(q) * 1e-12), v)
    corr = (F.col("c") - F.col("si") * F.col("sj") / F.col("n")) / F.sqrt(spread("qi", "si") * spread("qj", "sj"))
    tot = tot.select("i", "j", F.when(F.col("n") > 1, F.when(F.col("i") == F.col("j"), F.when(spread("qi", "si").isNotNull(), 1.0)).otherwise(corr)).alias("corr"))
    names = F.array(*[F.lit(c) for c in cols])
    ways = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return tot.select(F.explode(ways).alias("p"), "corr").select(
        F.get(names, F.col("p.i").cast("int")).alias("column_a"), F.get(names, F.col("p.j").cast("int")).alias("column_b"), "corr")


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10, max_cols: int = 5) -> DataFrame:
    """The first ``max_cols`` categorical columns, top k values each;
    missing shown as the text 'nan'."""
    cols = list(cols) if cols else categorical_columns(df)[:max_cols]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(_q(c).cast("string"), F.lit("nan")).alias("value"))
        for c in cols])).alias("s")).select("s.column", "s.value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    from flowlake.operators.summary import top_k_per_group
    return top_k_per_group(counts, ["column"], [F.desc("count"), F.asc("value")], k)


def table_profile(df: DataFrame, quantiles: bool = True) -> DataFrame:
    """One row per column: type, count, missing; unique/top/freq for
    non-numeric columns; mean/std/min/quartiles/max for numeric ones.

    top on ties: the smallest value (pandas keeps first occurrence)."""
    num = numeric_columns(df)
    other = [c for c in df.columns if c not in num]
    types = column_types(df)
    counts = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    base = counts.select("__rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count")) for i, c in enumerate(df.columns)
    ])).alias("s")).select("s.column", "s.count", (F.col("__rows") - F.col("s.count")).alias("missing"))
    out = types.join(base, "column")
    if other:
        vc = (_stack(df, other, "string").where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")))
        cat = vc.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"),
            F.min_by("value", F.struct(-F.col("c"), F.col("value"))).alias("top"),
            F.max("c").alias("freq"))
        out = out.join(cat, "column", "left")
    else:
        out = out.select("*", F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
                         F.lit(None).cast("long").alias("freq"))
    if num:
        long = _stack(df, num, "double")
        mom = long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                         F.min("value").alias("min"), F.max("value").alias("max"))
        if quantiles:
            qs = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"], names=["q25", "median", "q75"])
            mom = mom.join(qs, "column", "left")
        out = out.join(mom, "column", "left")
    return out.orderBy("position")


def drop_constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Numeric columns whose sample variance is not 0 (NULL variance,
    e.g. one row, is kept as pandas keeps NaN != 0).  One aggregate; the
    answer is one value per column."""
    cols = list(cols) if cols else numeric_columns(df)
    row = df.agg(*[F.var_samp(F.coalesce(_q(c).cast("double"), F.lit(0.0))).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is None or row[c] != 0]


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Rows outside [Q1 - k IQR, Q3 + k IQR] (exact quartiles as literals)."""
    q1, q3 = quantile_values(df, col, [0.25, 0.75])
    if q1 is None:
        return df.where(F.lit(False))
    lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    return df.where((_q(col) < F.lit(lo)) | (_q(col) > F.lit(hi)))
