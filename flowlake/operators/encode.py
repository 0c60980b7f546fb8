"""Encoders and scalers: F12 (ordinal codes), F13 (one-hot levels), A24
(category cap), F14 (robust scale), F15 (standard scale), P4, P5.

Codes and caps come from grouped counts joined back, never from a list
gathered on the driver, so a column of any cardinality is handled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators.order import global_row_number
from flowlake.operators.quantiles import exact_quantiles


def _q(c: str):
    return F.col(f"`{c}`")


def to_number(col) -> F.Column:
    """Coerce to double, bad text -> NULL (ANSI cast would throw)."""
    c = _q(col) if isinstance(col, str) else col
    return c.cast("string").try_cast("double")


def clean_number(col) -> F.Column:
    """P5: missing, NaN and +-inf -> 0."""
    c = (_q(col) if isinstance(col, str) else col).cast("double")
    return F.coalesce(F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c), F.lit(0.0))


def category_codes(df: DataFrame, col: str, out: str | None = None, missing_as_text: bool = False,
                   buckets: int = 16) -> DataFrame:
    """0-based code of each value in sorted order.

    ``missing_as_text=False``: NULL -> -1 (categorical codes);
    ``True``: NULL is the text 'nan' and is coded with the rest (label encoding).
    Distinct values are numbered with a bucketed global row number (no
    single-partition window), then joined back."""
    out = out or f"{col}_code"
    val = F.coalesce(_q(col).cast("string"), F.lit("nan")) if missing_as_text else _q(col).cast("string")
    src = df.withColumn("__v", val)
    levels = category_code_table(src, "__v", out=out, buckets=buckets)
    res = src.join(levels, "__v", "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)).cast("int"))
    return res.drop("__v")


def category_code_table(df: DataFrame, col: str, out: str = "code", buckets: int = 16) -> DataFrame:
    """(value, code) for the distinct non-missing values of ``col``, codes
    0.. in sorted text order (bucketed global row number)."""
    levels = df.select(_q(col).cast("string").alias("__v")).where(F.col("__v").isNotNull()).distinct()
    numbered = global_row_number(_with_sort_key(levels), ["__sk", "__v"], out="__rn", buckets=buckets)
    return numbered.select(F.col("__v").alias(col), (F.col("__rn") - 1).cast("int").alias(out))


def _with_sort_key(levels: DataFrame) -> DataFrame:
    # numeric bucket key that follows text order: the first 7 bytes as an integer
    first = F.substring(F.col("__v"), 1, 7)
    key = F.conv(F.hex(F.rpad(first.cast("binary"), 7, F.lit(b"\x00").cast("binary"))), 16, 10).cast("double")
    return levels.withColumn("__sk", key)


def levels_of(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct levels of a column (for one-hot column names; the
    count of columns is the count of levels, so it must be small)."""
    return [r[0] for r in df.select(_q(col).cast("string")).where(_q(col).isNotNull()).distinct().orderBy(1).collect()]


def cap_categories(df: DataFrame, col: str, top: int = 50, other: str = "OTHER") -> DataFrame:
    """Values outside the ``top`` most frequent -> 'OTHER'; missing is
    the text 'nan' first.  The kept list is at most ``top`` rows (limit), so
    its broadcast has a proven size."""
    v = F.coalesce(_q(col).cast("string"), F.lit("nan"))
    src = df.withColumn("__v", v)
    keep = (src.groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
               .orderBy(F.desc("__n"), F.asc("__v")).limit(top).select("__v", F.lit(True).alias("__keep")))
    res = src.join(F.broadcast(keep), "__v", "left")
    return res.withColumn(col, F.when(F.col("__keep"), F.col("__v")).otherwise(F.lit(other))).drop("__v", "__keep")


def robust_scale(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - median) / IQR, IQR 0 -> 1 (exact quantiles, linear)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _q(c).cast("double").alias("value")) for c in cols])).alias("s")
    ).select("s.column", "s.value")
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"], names=["q1", "med", "q3"])
    wide = q.agg(*[F.max(F.when(F.col("column") == c, F.col(k))).alias(f"__{k}_{i}")
                   for i, c in enumerate(cols) for k in ("q1", "med", "q3")])
    out = df.crossJoin(F.broadcast(wide))  # one row
    exprs = {}
    for i, c in enumerate(cols):
        iqr = F.col(f"__q3_{i}") - F.col(f"__q1_{i}")
        scale = F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
        exprs[f"{c}{suffix}"] = (_q(c).cast("double") - F.col(f"__med_{i}")) / scale
    out = out.withColumns(exprs)
    return out.drop(*[f"__{k}_{i}" for i in range(len(cols)) for k in ("q1", "med", "q3")])


def standard_scale(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population std (std 0 -> 1, as scikit-learn does)."""
    stats = df.agg(*[F.avg(_q(c)).alias(f"__m_{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(_q(c)).alias(f"__s_{i}") for i, c in enumerate(cols)])
    out = df.crossJoin(F.broadcast(stats))
    exprs = {}
    for i, c in enumerate(cols):
        s = F.col(f"__s_{i}")
        exprs[f"{c}{suffix}"] = (_q(c).cast("double") - F.col(f"__m_{i}")) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    out = out.withColumns(exprs)
    return out.drop(*[f"__m_{i}" for i in range(len(cols))], *[f"__s_{i}" for i in range(len(cols))])


def dictionary_lookup(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Left join on a mapping table; unknown -> NULL.  The planner (AQE)
    broadcasts the mapping when it is small at run time."""
    m = mapping.select(F.col(key).alias("__k"), F.col(value).alias(out))
    return df.join(m, _q(col) == F.col("__k"), "left").drop("__k")


# Fixed values of the reference's attack-type map (J4), in its order.
ATTACK_CATEGORIES = [
    ("normal", "Normal"),
    ("back", "DoS"), ("land", "DoS"), ("neptune", "DoS"), ("pod", "DoS"), ("smurf", "DoS"), ("teardrop", "DoS"),
    ("ipsweep", "Probe"), ("nmap", "Probe"), ("portsweep", "Probe"), ("satan", "Probe"),
    ("buffer_overflow", "U2R"), ("loadmodule", "U2R"), ("perl", "U2R"), ("rootkit", "U2R"),
    ("ftp_write", "R2L"), ("guess_passwd", "R2L"), ("imap", "R2L"), ("multihop", "R2L"),
    ("phf", "R2L"), ("spy", "R2L"), ("warezclient", "R2L"), ("warezmaster", "R2L"),
]


def attack_category(df: DataFrame, col: str = "attack_type", out: str = "attack_category") -> DataFrame:
    """J4 on a KDD table: attack type -> category, unknown -> NULL."""
    spark = df.sparkSession
    mapping = spark.createDataFrame(ATTACK_CATEGORIES, "k string, v string")
    return dictionary_lookup(df, col, mapping, "k", "v", out)
