"""Traffic-log features (M13) with the heuristic label.

Frequencies and protocol variety are grouped counts joined back (J2, J3);
the time delta is the bucketed global lag (W1); thresholds are exact
quantiles (one row, broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions import text
from flowlake.operators import encode, order
from flowlake.operators.quantiles import quantile_values

FEATURES = ["packet_length", "protocol_encoded", "time_delta", "is_broadcast", "source_frequency",
            "dest_frequency", "protocol_variety", "info_length", "has_error"]


def _q(c):
    return F.col(f"`{c}`")


def value_frequency(df: DataFrame, col: str, out: str) -> DataFrame:
    """Count of the row's value over the table (missing key -> NULL)."""
    counts = df.where(_q(col).isNotNull()).groupBy(_q(col).alias("__fk")).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, _q(col) == F.col("__fk"), "left").drop("__fk")


def distinct_per_key(df: DataFrame, key: str, col: str, out: str, missing: int = 1) -> DataFrame:
    """Distinct values of ``col`` per ``key``, mapped to rows; missing -> ``missing``."""
    v = df.where(_q(key).isNotNull()).groupBy(_q(key).alias("__dk")).agg(F.countDistinct(_q(col)).alias(out))
    j = df.join(v, _q(key) == F.col("__dk"), "left").drop("__dk")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(missing)).cast("long"))


def log_features(df: DataFrame, no: str = "No.", time: str = "Time", source: str = "Source",
                 dest: str = "Destination", protocol: str = "Protocol", length: str = "Length",
                 info: str | None = "Info", keep: tuple = ()) -> DataFrame:
    """The nine features of a packet-list export, plus ``keep`` columns.

    Every lookup table (codes, frequencies, variety) is an aggregate of the
    same base projection joined onto the rows, so the plan grows linearly
    with the number of features."""
    base = df.select(_q(no).alias("no"), _q(time).cast("double").alias("__t"), _q(source).alias("__src"),
                     _q(dest).alias("__dst"), _q(protocol).alias("__proto"), _q(length).alias("__len"),
                     (_q(info) if info else F.lit(None).cast("string")).alias("__info"),
                     *[_q(k) for k in keep])
    codes = encode.category_code_table(base, "__proto", out="protocol_encoded")
    sfreq = (base.where(F.col("__src").isNotNull()).groupBy("__src")
                 .agg(F.count(F.lit(1)).alias("source_frequency"), F.countDistinct("__proto").alias("protocol_variety")))
    dfreq = base.where(F.col("__dst").isNotNull()).groupBy("__dst").agg(F.count(F.lit(1)).alias("dest_frequency"))
    out = order.time_delta(base, order_col="no", time_col="__t", out="time_delta")
    out = (out.join(codes, "__proto", "left").join(sfreq, "__src", "left").join(dfreq, "__dst", "left"))
    out = out.withColumns({
        "packet_length": F.coalesce(encode.to_number("__len"), F.lit(0.0)),
        "protocol_encoded": F.coalesce(F.col("protocol_encoded"), F.lit(-1)).cast("int"),
        "is_broadcast": text.is_broadcast("__dst"),
        "protocol_variety": F.coalesce(F.col("protocol_variety"), F.lit(1)).cast("long"),
        "info_length": text.text_length("__info") if info else F.lit(0),
        "has_error": text.has_error("__info") if info else F.lit(0),
    })
    return out.select("no", *FEATURES, *keep)


def heuristic_label(features: DataFrame, length_q: float = 0.95, freq_q: float = 0.90) -> DataFrame:
    """1 when length > its q95, or source frequency > its q90, or an
    error word is present.  The two thresholds are exact quantiles taken as
    literals (one row each)."""
    (ql,) = quantile_values(features, "packet_length", [length_q])
    (qf,) = quantile_values(features, "source_frequency", [freq_q])
    lab = F.col("has_error") > 0
    if ql is not None:
        lab = lab | (F.col("packet_length") > F.lit(ql))
    if qf is not None:
        lab = lab | F.coalesce(F.col("source_frequency") > F.lit(qf), F.lit(False))
    return features.withColumn("label", F.coalesce(lab, F.lit(False)).cast("int"))
