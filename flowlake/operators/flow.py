"""Flow operators: per-flow statistics (A2), flow summary (A3), statistics back
onto packets (J1), whole-table z-scores (W3), derived packet columns.

Flows are a ``groupBy(flow_id)`` with partial aggregation: a flow holding a
third of all packets is combined map-side to one row per task before the
shuffle, so no task ever holds a flow's packets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions import net
from flowlake.functions.numeric import np_round
from flowlake.functions.time import epoch_to_timestamp, with_time_parts


def flow_stats(df: DataFrame, flow: str = "flow_id", size: str = "packet_size",
               ts: str = "timestamp", ndigits: int = 4) -> DataFrame:
    """A2: count, sum, mean, std (sample; NULL for one packet), min, max of
    the size and min/max time, each rounded as NumPy rounds; duration = max - min of the
    rounded times; rate = sum / (duration + 0.001)."""
    s = F.col(size)
    agg = df.groupBy(flow).agg(
        F.count(s).alias("packet_size_count"),
        np_round(F.sum(s), ndigits).alias("packet_size_sum"),
        np_round(F.avg(s), ndigits).alias("packet_size_mean"),
        np_round(F.stddev_samp(s), ndigits).alias("packet_size_std"),
        np_round(F.min(s), ndigits).alias("packet_size_min"),
        np_round(F.max(s), ndigits).alias("packet_size_max"),
        np_round(F.min(ts), ndigits).alias("timestamp_min"),
        np_round(F.max(ts), ndigits).alias("timestamp_max"),
    )
    return (agg.withColumn("flow_duration", F.col("timestamp_max") - F.col("timestamp_min"))
               .withColumn("flow_rate", F.col("packet_size_sum") / (F.col("flow_duration") + F.lit(0.001))))


def flow_summary(df: DataFrame, flow: str = "flow_id", size: str = "packet_size",
                 ts: str = "timestamp") -> DataFrame:
    """A3: mean and max flow duration, mean packets and bytes per flow (one row)."""
    per = df.groupBy(flow).agg(F.count(size).alias("n"), F.sum(size).alias("b"),
                               (F.max(ts) - F.min(ts)).alias("d"))
    return per.agg(F.avg("d").alias("avg_flow_duration"),
                   F.max("d").alias("max_flow_duration"),
                   F.avg("n").alias("avg_packets_per_flow"),
                   F.avg("b").alias("avg_bytes_per_flow"))


def attach_flow_stats(df: DataFrame, flow: str = "flow_id", **kw) -> DataFrame:
    """Flow statistics on every packet (left join on the flow id).

    The flow table is one row per flow; AQE turns the join into a broadcast
    when that table is small at run time and keeps sort-merge otherwise.
    """
    return df.join(flow_stats(df, flow=flow, **kw), flow, "left")


def zscores(df: DataFrame, cols: Sequence[str] = ("packet_size", "tcp_window", "ip_ttl"),
            eps: float = 0.001, suffix: str = "_zscore") -> DataFrame:
    """(x - mean) / (std + eps) over the whole table.

    Mean and sample std come from one global aggregate (one row), joined by
    broadcast: an unpartitioned window would move every row into one task.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols],
                   *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + F.lit(eps))
                           for c in cols})
    return out.drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])


def one_hot(df: DataFrame, col: str, levels: Sequence[str], prefix: str | None = None,
            drop_first: bool = False, keep: bool = True) -> DataFrame:
    """one boolean column per level (all levels, or the first dropped).

    The source column is kept (D1: later operators still read it)."""
    prefix = prefix or col
    lv = sorted(levels)[1:] if drop_first else sorted(levels)
    out = df.withColumns({f"{prefix}_{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)) for v in lv})
    return out if keep else out.drop(col)


def with_derived(df: DataFrame, ts: str = "timestamp", proto_levels: Sequence[str] | None = None) -> DataFrame:
    """The derived packet columns of a capture: time parts, flow statistics,
    port and address flags, z-scores, protocol one-hot."""
    out = df
    if "flow_id" not in out.columns:
        out = net.with_flow_id(out)
    out = out.withColumn("datetime", epoch_to_timestamp(ts))
    out = with_time_parts(out, "datetime")
    out = attach_flow_stats(out, ts=ts)
    out = net.with_address_flags(out)
    out = zscores(out)
    if proto_levels is not None and "protocol" in out.columns:
        out = one_hot(out, "protocol", proto_levels, prefix="proto")
    return out
