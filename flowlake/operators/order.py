"""Ordered operators without a single-partition window: W1, W2, W4, W5.

``Window.orderBy`` with no partition key moves every row into one task.  The
global order is split into value ranges instead: bucket bounds come from one
``percentile_approx`` (a few dozen numbers, made literals), rows are ordered inside
their bucket, and a bucket's first row takes its predecessor from a tiny
per-bucket table.  Equal keys always share a bucket, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numeric_key(df: DataFrame, col: str):
    dt = df.schema[col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(col)).cast("double")
    return F.col(col).cast("double")


ROWS_PER_BUCKET, LEAST_BUCKETS = 2_000_000, 64


def _bounds(keys: DataFrame, buckets: int | None) -> tuple[list, int]:
    """Bucket bounds of column ``__k`` and their number: as given, or one bucket for each
    ``ROWS_PER_BUCKET`` rows (64 at least), so a bucket's sort stays one task's work at any input size."""
    n = buckets or LEAST_BUCKETS
    fr = F.array(*[F.lit(i / n) for i in range(1, n)])
    r = keys.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__k", fr, 10 * n).alias("b")).first()
    need = math.ceil(r["n"] / ROWS_PER_BUCKET)
    return _bounds(keys, need) if buckets is None and need > n else (r["b"] or [], n)


def with_range_bucket(df: DataFrame, order_col: str, buckets: int | None = None, out: str = "__bkt",
                      tiebreak: str | None = None) -> DataFrame:
    """Tag rows with a value-range bucket of ``order_col``.  The bounds (one
    ``percentile_approx``, ``buckets - 1`` numbers; by default their number follows
    the rows) come back to the driver and become a literal binary-search
    expression, so every later read of the plan sees the same buckets.

    A value that fills several buckets (a bound repeated) would put all its
    rows in one task; with a ``tiebreak`` column those rows are split again
    by ranges of the tiebreak, which keeps the (order_col, tiebreak) order:
    the bucket number is ``base * buckets + sub``."""
    from flowlake.operators.quantiles import bucket_of
    key = _numeric_key(df, order_col)
    bnd, buckets = _bounds(df.select(key.alias("__k")), buckets)
    if not bnd:
        return df.withColumn(out, F.lit(0))
    expr, _ = bucket_of(key, bnd)
    hot = sorted({b for b in bnd if bnd.count(b) > 1})
    orderable = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if tiebreak is not None and not isinstance(df.schema[tiebreak].dataType, orderable):
        tiebreak = None                  # only numeric / time tiebreaks have ranges
    if not hot or tiebreak is None:
        return df.withColumn(out, F.coalesce(expr, F.lit(0)))
    tkey = _numeric_key(df, tiebreak)
    sub = F.lit(0)
    for v in hot:                        # a handful at most: repeated bounds
        tb, _ = _bounds(df.where(key == F.lit(v)).select(tkey.alias("__k")), buckets)
        if tb:
            texpr, _ = bucket_of(tkey, tb)
            sub = F.when(key == F.lit(v), texpr).otherwise(sub)
    return df.withColumn(out, F.coalesce(expr, F.lit(0)) * F.lit(buckets) + sub)


def global_lag(df: DataFrame, order_cols: Sequence[str], value_col: str, out: str = "prev",
               buckets: int | None = None) -> DataFrame:
    """Value of ``value_col`` on the previous row in ``order_cols`` order over
    the whole table (NULL on the first row).  The first order column sets the
    bucket; the rest break ties.  Best with a near-unique first key."""
    order_cols = list(order_cols)
    b = with_range_bucket(df, order_cols[0], buckets, tiebreak=order_cols[1] if len(order_cols) > 1 else None)
    w = Window.partitionBy("__bkt").orderBy(*order_cols)
    b = b.withColumn(out, F.lag(value_col).over(w)).withColumn("__rn", F.row_number().over(w))
    tail = (b.groupBy("__bkt")
             .agg(F.max_by(value_col, F.struct(*order_cols)).alias("__last"))
             .withColumn("__prev_last", F.lag("__last").over(Window.orderBy("__bkt")))  # <= buckets rows
             .select("__bkt", "__prev_last"))
    b = b.join(F.broadcast(tail), "__bkt", "left")
    b = b.withColumn(out, F.when(F.col("__rn") == 1, F.col("__prev_last")).otherwise(F.col(out)))
    return b.drop("__bkt", "__rn", "__prev_last")


def global_row_number(df: DataFrame, order_cols: Sequence[str], out: str = "row_no",
                      buckets: int | None = None) -> DataFrame:
    """1-based row number in ``order_cols`` order: local number plus the
    prefix sum of bucket sizes (tiny table)."""
    order_cols = list(order_cols)
    b = with_range_bucket(df, order_cols[0], buckets, tiebreak=order_cols[1] if len(order_cols) > 1 else None)
    b = b.withColumn("__grn", F.row_number().over(Window.partitionBy("__bkt").orderBy(*order_cols)))
    sizes = (b.groupBy("__bkt").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__off", F.sum("__n").over(Window.orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)))
              .select("__bkt", F.coalesce("__off", F.lit(0)).alias("__off")))
    b = b.join(F.broadcast(sizes), "__bkt").withColumn(out, (F.col("__grn") + F.col("__off")).cast("long"))
    return b.drop("__bkt", "__grn", "__off")


def time_delta(df: DataFrame, order_col: str = "No.", time_col: str = "Time", out: str = "time_delta") -> DataFrame:
    """Difference to the previous row in file order, first row 0."""
    lagged = global_lag(df, [order_col], time_col, out="__prev")
    return lagged.withColumn(out, F.coalesce(F.col(time_col) - F.col("__prev"), F.lit(0.0))).drop("__prev")


def gap_stats(df: DataFrame, ts: str = "timestamp", buckets: int | None = None) -> DataFrame:
    """W2 + A8: capture duration, mean gap, packet rate, gap variance (one row).

    Equal timestamps are collapsed first (partial aggregation); c copies of a
    value add c - 1 zero gaps.  The lag then runs over distinct values only,
    so a timestamp holding a third of all rows is one row."""
    vc = df.where(F.col(ts).isNotNull()).groupBy(F.col(ts).cast("double").alias("t")).agg(
        F.count(F.lit(1)).alias("c"))
    lagged = global_lag(vc, ["t"], "t", out="p", buckets=buckets)
    gaps = lagged.select((F.col("t") - F.col("p")).alias("g"), (F.col("c") - 1).alias("z"))
    tot = gaps.agg(F.sum(F.coalesce("g", F.lit(0.0))).alias("s"),
                   F.count("g").alias("npos"), F.sum("z").alias("nz"))
    tot = tot.withColumn("m", F.col("s") / (F.col("npos") + F.col("nz")))
    dev = (gaps.crossJoin(F.broadcast(tot.select("m")))
               .agg(F.sum(F.when(F.col("g").isNotNull(), (F.col("g") - F.col("m")) ** 2)).alias("ss_pos"),
                    F.sum(F.col("z") * F.col("m") * F.col("m")).alias("ss_zero")))
    span = df.agg(F.min(ts).cast("double").alias("mn"), F.max(ts).cast("double").alias("mx"),
                  F.count(F.lit(1)).alias("n"))
    out = span.crossJoin(tot).crossJoin(dev)
    k = F.col("npos") + F.col("nz")
    return out.select(
        (F.col("mx") - F.col("mn")).alias("capture_duration"),
        F.when(k > 0, F.col("s") / k).alias("avg_packet_interval"),
        (F.col("n") / (F.col("mx") - F.col("mn") + F.lit(0.001))).alias("packet_rate"),
        F.when(k > 1, (F.coalesce("ss_pos", F.lit(0.0)) + F.coalesce("ss_zero", F.lit(0.0))) / (k - 1)).alias("time_variance"),
    )


def batch_numbers(df: DataFrame, order_cols: Sequence[str], size: int = 1000, out: str = "batch_id",
                  dense_id: str | None = None) -> DataFrame:
    """Rows numbered into batches of ``size`` in order.  With a dense
    0-based id column the batch is plain arithmetic (no ordering job)."""
    if dense_id is not None:
        return df.withColumn(out, F.floor(F.col(dense_id) / size).cast("long"))
    numbered = global_row_number(df, order_cols, out="__rowno")
    return numbered.withColumn(out, F.floor((F.col("__rowno") - 1) / size).cast("long")).drop("__rowno")


def first_rows_per_batch(df: DataFrame, batch: str, order_cols: Sequence[str], n: int = 20) -> DataFrame:
    """The first n rows of each batch."""
    w = Window.partitionBy(batch).orderBy(*order_cols)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def sequences(df: DataFrame, key: str, order_cols: Sequence[str], value: str, k: int = 10,
              out: str = "seq", hot_rows: int = 1_000_000, buckets: int | None = None) -> DataFrame:
    """Sliding windows of k rows (step 1) per key, full windows only;
    a key with fewer than k rows gives none.  One row per window, at its
    last row.

    Every key is cut into time slices: ranges of the first order column, one for
    each ``hot_rows`` rows of the table (or ``buckets`` of them).  A slice
    borrows the k - 1 rows of its key that precede it: the last k - 1 rows of
    every slice form a small table, in which a running window gives each slice's end its
    halo, so no task holds a hot key.  Equal values share a slice."""
    from flowlake.operators.quantiles import bucket_of
    order_cols = list(order_cols)
    n = buckets or max(1, math.ceil(df.count() / hot_rows))
    bnd = _bounds(df.select(_numeric_key(df, order_cols[0]).alias("__k")), n)[0] if n > 1 else []
    number = F.coalesce(bucket_of(_numeric_key(df, order_cols[0]), bnd)[0], F.lit(0)) if bnd else F.lit(0)
    body = df.withColumn("__slice", number).withColumn("__halo", F.lit(False))
    # the last k - 1 rows of every slice, and at the end of each the last k - 1 rows of the key so far
    last = Window.partitionBy(key, "__slice").orderBy(*[F.desc(c) for c in order_cols])
    tails = body.withColumn("__r", F.row_number().over(last)).where(F.col("__r") < k)
    so_far = Window.partitionBy(key).orderBy("__slice", F.desc("__r")).rowsBetween(-max(k - 2, 0), 0)
    ends = tails.withColumn("__rows", F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).over(so_far)).where(F.col("__r") == 1)
    ends = ends.select(key, F.lead("__slice").over(Window.partitionBy(key).orderBy("__slice")).alias("__slice"), "__rows").where(F.col("__slice").isNotNull())
    halo = ends.select("__slice", F.explode("__rows").alias("__row")).select(
        *[F.col("__row").getField(c).alias(c) for c in df.columns], "__slice", F.lit(True).alias("__halo"))
    # the halo comes first also where order columns are equal
    w = Window.partitionBy(key, "__slice").orderBy(F.desc("__halo"), *order_cols).rowsBetween(-(k - 1), 0)
    res = body.unionByName(halo).withColumn(out, F.collect_list(value).over(w))
    return res.where(~F.col("__halo") & (F.size(out) == k)).drop("__halo", "__slice")
