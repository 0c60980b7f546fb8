"""Running traffic counters (A32), traffic report (A33, F28), top talkers (T5).

The counters are one grouped aggregate over (kind, key) rows; the same
function runs on a batch table and on a stream (see streaming/monitor.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counter_rows(df: DataFrame, size: str = "packet_size", protocol: str = "protocol", flow: str = "flow_id",
                 src: str = "src_ip", dst: str = "dst_ip", keep: tuple = ()) -> DataFrame:
    """Stack every packet into its counter keys: total, protocol (missing ->
    'Unknown'), flow (missing -> 'unknown'), src and dst (empty skipped)."""
    keys = [F.struct(F.lit("total").alias("kind"), F.lit("packets").alias("key")),
            F.struct(F.lit("protocol").alias("kind"), F.coalesce(F.col(protocol), F.lit("Unknown")).alias("key")),
            F.struct(F.lit("flow").alias("kind"), F.coalesce(F.col(flow), F.lit("unknown")).alias("key")),
            F.struct(F.lit("src_ip").alias("kind"), F.when(F.col(src) != "", F.col(src)).alias("key")),
            F.struct(F.lit("dst_ip").alias("kind"), F.when(F.col(dst) != "", F.col(dst)).alias("key"))]
    if flow not in df.columns:
        keys = [k for i, k in enumerate(keys) if i != 2]
    rows = df.select(*keep, F.coalesce(F.col(size), F.lit(0)).alias("__size"), F.explode(F.array(*keys)).alias("k"))
    return rows.where(F.col("k.key").isNotNull()).select(*keep, "k.kind", "k.key", "__size")


def counters(df: DataFrame, **cols) -> DataFrame:
    """Packets and bytes per (kind, key)."""
    return counter_rows(df, **cols).groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("__size").cast("long").alias("bytes"))


def traffic_report(counter_table: DataFrame, window_seconds: float = 300.0) -> DataFrame:
    """A33 + F28: totals and per-second rates over the window length (0 if
    the window is not positive); one row."""
    tot = counter_table.where((F.col("kind") == "total") & (F.col("key") == "packets"))
    w = F.lit(float(window_seconds))
    rate = (lambda c: F.when(w > 0, F.col(c) / w).otherwise(F.lit(0.0)))
    return tot.select(w.alias("duration"), F.col("packets").alias("total_packets"),
                      F.col("bytes").alias("total_bytes")).select(
        "duration", "total_packets", "total_bytes",
        rate("total_packets").alias("packets_per_second"), rate("total_bytes").alias("bytes_per_second"))


def top_talkers(counter_table: DataFrame, k: int = 10) -> DataFrame:
    """T5: sources with the most packets."""
    return (counter_table.where(F.col("kind") == "src_ip")
            .select(F.col("key").alias("ip"), "packets")
            .orderBy(F.desc("packets"), F.asc("ip")).limit(k))


def traffic_report_rows(counter_table: DataFrame, alerts: DataFrame | None = None, window_seconds: float = 300.0,
                        talkers: int = 10, last_alerts: int = 10) -> DataFrame:
    """A33 in full as long rows (section, pos, key, value): totals and rates, packets per
    protocol, the busiest sources, and the newest alerts (``alerts``: batch_id, alert_type, details, n)."""
    t = traffic_report(counter_table, window_seconds)
    names = ["duration", "total_packets", "total_bytes", "packets_per_second", "bytes_per_second"]
    totals = t.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value"))
                                             for n in names])).alias("pos", "x")).select(
        F.lit("totals").alias("section"), F.col("pos").cast("int").alias("pos"), "x.key", "x.value")

    def ranked(section: str, rows: DataFrame, *order) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), (F.row_number().over(Window.orderBy(*order)) - 1).cast("int").alias("pos"),
                           F.col("key"), F.col("value").cast("double").alias("value"))
    by_value = (F.desc("value"), F.asc("key"))
    protocols = counter_table.where(F.col("kind") == "protocol").select("key", F.col("packets").alias("value"))
    out = totals.unionByName(ranked("protocol_distribution", protocols, *by_value)).unionByName(
        ranked("top_talkers", top_talkers(counter_table, talkers).select(F.col("ip").alias("key"), F.col("packets").alias("value")), *by_value))
    if alerts is not None:
        newest = alerts.orderBy(F.desc("batch_id"), "alert_type").limit(last_alerts).select(
            "batch_id", "alert_type", F.col("details").alias("key"), F.col("n").alias("value"))
        out = out.unionByName(ranked("recent_alerts", newest, F.desc("batch_id"), F.asc("alert_type")))
    return out
