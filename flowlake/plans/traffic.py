"""Plans over the packet view: series, flows, summaries, ports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions import net
from flowlake.operators import flow as flow_ops
from flowlake.operators import order as order_ops
from flowlake.operators import series, summary
from flowlake.plans.packets import packets, with_packets
from flowlake.plans.registry import plan, rounded, table

# ---- series ---------------------------------------------------------------


@plan("traffic_overview", with_packets("""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, count(*) AS packets,
       CAST(sum(packet_size) AS BIGINT) AS bytes, round(avg(packet_size), 4) AS mean_size,
       count(DISTINCT src_ip) AS distinct_sources
FROM packets GROUP BY 1""", flows=False))
def traffic_overview(spark, sf):
    """A13 + A14 + distinct sources per hour (the flagship)."""
    return series.traffic_overview(packets(spark, sf, with_flow=False), ts="ts", unit="hour")


@plan("traffic_daily", with_packets("""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS packets
FROM packets GROUP BY 1""", flows=False))
def traffic_daily(spark, sf):
    """A13 per day."""
    return series.counts_per_period(packets(spark, sf, with_flow=False), ts="ts", unit="day")


@plan("hourly_mean_size", with_packets("""
SELECT CAST(hour(ts) AS INTEGER) AS hour, round(avg(packet_size), 4) AS mean_size
FROM packets GROUP BY 1""", flows=False))
def hourly_mean_size(spark, sf):
    """A14."""
    return series.mean_per_hour(packets(spark, sf, with_flow=False), ts="ts")


@plan("protocol_hour_matrix", with_packets("""
SELECT CAST(hour(ts) AS INTEGER) AS hour,
       count(*) FILTER (WHERE protocol = 'TCP') AS "TCP",
       count(*) FILTER (WHERE protocol = 'UDP') AS "UDP",
       count(*) FILTER (WHERE protocol = 'ICMP') AS "ICMP"
FROM packets GROUP BY 1""", flows=False))
def protocol_hour_matrix(spark, sf):
    """A15, pivot levels = 5 most frequent protocols (here 3 exist)."""
    return series.protocol_hour_matrix(packets(spark, sf, with_flow=False), ts="ts", cat="protocol")


@plan("hour_distribution", with_packets("""
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS packets FROM packets GROUP BY 1""", flows=False))
def hour_distribution(spark, sf):
    """A5 distribution."""
    return series.hour_distribution(packets(spark, sf, with_flow=False), ts="ts")


@plan("peak_hour", with_packets("""
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS packets FROM packets
GROUP BY 1 ORDER BY packets DESC, hour ASC LIMIT 1""", flows=False))
def peak_hour(spark, sf):
    """A5 peak (a top-1 report)."""
    return series.peak_hour(packets(spark, sf, with_flow=False), ts="ts")


@plan("size_histogram", """
WITH r AS (SELECT CASE WHEN min(l_extendedprice) = max(l_extendedprice) THEN min(l_extendedprice) - 0.5
                       ELSE min(l_extendedprice) END AS lo,
                  CASE WHEN min(l_extendedprice) = max(l_extendedprice) THEN max(l_extendedprice) + 0.5
                       ELSE max(l_extendedprice) END AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) * 50.0::DOUBLE / (hi - lo)) AS INTEGER), 49) AS bin,
             count(*) AS cnt
      FROM lineitem, r WHERE l_extendedprice IS NOT NULL GROUP BY 1),
e AS (SELECT CAST(i AS INTEGER) AS bin, lo + (hi - lo) * i / 50.0::DOUBLE AS lower,
             lo + (hi - lo) * (i + 1) / 50.0::DOUBLE AS upper
      FROM range(50) t(i), r WHERE lo IS NOT NULL)
SELECT e.bin, round(lower, 6) AS lower, round(upper, 6) AS upper, CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM e LEFT JOIN b ON e.bin = b.bin""")
def size_histogram(spark, sf):
    """A17 on lineitem prices, 50 bins."""
    return rounded(series.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50))


# ---- flows ----------------------------------------------------------------


@plan("flow_ids", with_packets("SELECT packet_id, flow_id FROM pflows"))
def flow_ids(spark, sf):
    """F1 on every packet."""
    return packets(spark, sf).select("packet_id", "flow_id")


def r(x: str, n: int = 4) -> str:
    """NumPy rounding in DuckDB: scale, half to even, scale back."""
    return f"round_even(({x}) * {10 ** n}.0::DOUBLE, 0) / {10 ** n}.0::DOUBLE"


_FLOW_STATS_SQL = f"""
flow_stats AS (
  SELECT flow_id, packet_size_count, packet_size_sum, packet_size_mean, packet_size_std,
         packet_size_min, packet_size_max, timestamp_min, timestamp_max,
         timestamp_max - timestamp_min AS flow_duration,
         packet_size_sum / (timestamp_max - timestamp_min + 0.001::DOUBLE) AS flow_rate
  FROM (SELECT flow_id, count(packet_size) AS packet_size_count,
               {r('CAST(sum(packet_size) AS DOUBLE)')} AS packet_size_sum,
               {r('avg(packet_size)')} AS packet_size_mean,
               {r('stddev_samp(packet_size)')} AS packet_size_std,
               {r('CAST(min(packet_size) AS DOUBLE)')} AS packet_size_min,
               {r('CAST(max(packet_size) AS DOUBLE)')} AS packet_size_max,
               {r('min(timestamp)')} AS timestamp_min, {r('max(timestamp)')} AS timestamp_max
        FROM pflows GROUP BY flow_id) s)"""


@plan("flow_stats", with_packets("SELECT * FROM flow_stats").replace(
    "\nSELECT * FROM flow_stats", "," + _FLOW_STATS_SQL + "\nSELECT * FROM flow_stats"))
def flow_stats(spark, sf):
    """A2."""
    return flow_ops.flow_stats(packets(spark, sf))


@plan("flow_summary", with_packets("""
SELECT round(avg(d), 6) AS avg_flow_duration, round(max(d), 6) AS max_flow_duration,
       round(avg(n), 6) AS avg_packets_per_flow, round(avg(b), 6) AS avg_bytes_per_flow
FROM (SELECT flow_id, count(packet_size) AS n, sum(packet_size) AS b, max(timestamp) - min(timestamp) AS d
      FROM pflows GROUP BY flow_id) f"""))
def flow_summary(spark, sf):
    """A3."""
    return rounded(flow_ops.flow_summary(packets(spark, sf)))


@plan("packet_flow_join", with_packets("SELECT * FROM flow_stats").replace(
    "\nSELECT * FROM flow_stats", "," + _FLOW_STATS_SQL + """
SELECT p.packet_id, p.flow_id, s.packet_size_count, s.packet_size_mean, s.flow_duration, s.flow_rate
FROM pflows p LEFT JOIN flow_stats s ON p.flow_id = s.flow_id"""))
def packet_flow_join(spark, sf):
    """Flow statistics on every packet."""
    out = flow_ops.attach_flow_stats(packets(spark, sf))
    return out.select("packet_id", "flow_id", "packet_size_count", "packet_size_mean",
                      "flow_duration", "flow_rate")


# ---- summaries ------------------------------------------------------------


@plan("basic_features", with_packets("""
SELECT count(*) AS total_packets, count(DISTINCT flow_id) AS unique_flows,
       count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
       round(avg(packet_size), 6) AS avg_packet_size, CAST(sum(packet_size) AS BIGINT) AS total_bytes
FROM pflows"""))
def basic_features(spark, sf):
    """A1."""
    return rounded(summary.basic_features(packets(spark, sf)))


@plan("protocol_counts", with_packets("""
SELECT protocol, count(*) AS count FROM packets WHERE protocol IS NOT NULL GROUP BY 1""", flows=False))
def protocol_counts(spark, sf):
    """A12 on protocol."""
    return summary.value_counts(packets(spark, sf, with_flow=False), "protocol")


@plan("size_statistics", with_packets("""
SELECT col AS "column", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       round(min(v), 6) AS min, round(max(v), 6) AS max,
       round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75,
       round(quantile_cont(v, 0.25), 6) AS q25
FROM (SELECT 'packet_size' AS col, CAST(packet_size AS DOUBLE) AS v FROM packets
      UNION ALL SELECT 'tcp_window', CAST(tcp_window AS DOUBLE) FROM packets
      UNION ALL SELECT 'ip_ttl', CAST(ip_ttl AS DOUBLE) FROM packets) u
GROUP BY col""", flows=False))
def size_statistics(spark, sf):
    """A4 over packet_size, tcp_window, ip_ttl."""
    return rounded(summary.column_statistics(packets(spark, sf, with_flow=False)))


@plan("temporal_features", with_packets("""
SELECT round(max(timestamp) - min(timestamp), 6) AS capture_duration,
       round((SELECT avg(g) FROM gaps), 6) AS avg_packet_interval,
       round(count(*) / (max(timestamp) - min(timestamp) + 0.001::DOUBLE), 6) AS packet_rate,
       round((SELECT var_samp(g) FROM gaps), 4) AS time_variance
FROM packets""", flows=False).replace("\nSELECT round(max(timestamp)", """,
gaps AS (SELECT timestamp - lag(timestamp) OVER (ORDER BY timestamp, packet_id) AS g FROM packets)
SELECT round(max(timestamp)"""))
def temporal_features(spark, sf):
    """A8 + W2 (gap mean and variance without a single-partition window)."""
    out = order_ops.gap_stats(packets(spark, sf, with_flow=False), ts="timestamp")
    return out.select(F.round("capture_duration", 6).alias("capture_duration"),
                      F.round("avg_packet_interval", 6).alias("avg_packet_interval"),
                      F.round("packet_rate", 6).alias("packet_rate"),
                      F.round("time_variance", 4).alias("time_variance"))


@plan("port_scan_sources", with_packets("""
SELECT src_ip, count(DISTINCT dst_port) AS distinct_ports FROM packets
WHERE src_ip IS NOT NULL GROUP BY src_ip HAVING count(DISTINCT dst_port) > 3""", flows=False))
def port_scan_sources(spark, sf):
    """A6 with the threshold lowered to 3 (the view has 4 destination ports)."""
    return summary.port_scan_sources(packets(spark, sf, with_flow=False), threshold=3)


@plan("tcp_flag_counts", with_packets("""
SELECT count(*) FILTER (WHERE (tcp_flags & 2) <> 0) AS syn_packets,
       count(*) FILTER (WHERE (tcp_flags & 16) <> 0) AS ack_packets,
       count(*) FILTER (WHERE (tcp_flags & 1) <> 0) AS fin_packets,
       count(*) FILTER (WHERE (tcp_flags & 4) <> 0) AS rst_packets,
       round(avg(tcp_window), 6) AS avg_window_size
FROM packets WHERE protocol = 'TCP'""", flows=False))
def tcp_flag_counts(spark, sf):
    """A7 (flags from the F4 bit masks)."""
    return rounded(summary.tcp_features(packets(spark, sf, with_flow=False)))


_PRIVATE_SQL = None  # built below from the same fixed table as the Spark side


def _sql_ipv4_long(col: str) -> str:
    parts = [f"CAST(string_split({col}, '.')[{i}] AS BIGINT)" for i in range(1, 5)]
    return (f"CASE WHEN regexp_full_match({col}, '{net.IPV4_PATTERN[1:-1]}') THEN "
            f"{parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]} END")


def _sql_is_private(col: str) -> str:
    v = _sql_ipv4_long(col)
    conds = []
    for netw, bits in net.PRIVATE_V4_BLOCKS:
        lo = net._dotted_to_int(netw)
        hi = lo + (1 << (32 - bits)) - 1
        conds.append(f"({v}) BETWEEN {lo} AND {hi}")
    exc = ", ".join(str(net._dotted_to_int(x)) for x in net.PRIVATE_V4_EXCEPTIONS)
    return f"coalesce(({' OR '.join(conds)}) AND ({v}) NOT IN ({exc}), false)"


def _sql_in(col: str, values) -> str:
    return f"coalesce({col} IN ({', '.join(str(v) for v in values)}), false)"


@plan("port_flags", with_packets(f"""
SELECT packet_id,
       {_sql_in('dst_port', net.COMMON_PORTS)} AS is_common_port,
       coalesce(dst_port > 1024, false) AS is_high_port,
       {_sql_in('dst_port', net.SUSPICIOUS_PORTS)} AS is_suspicious_port,
       {_sql_is_private('src_ip')} AS src_ip_private,
       {_sql_is_private('dst_ip')} AS dst_ip_private,
       {_sql_is_private('src_ip')} AND {_sql_is_private('dst_ip')} AS is_internal_traffic,
       (tcp_flags & 2) <> 0 AS tcp_flag_syn, (tcp_flags & 16) <> 0 AS tcp_flag_ack,
       (tcp_flags & 1) <> 0 AS tcp_flag_fin, (tcp_flags & 4) <> 0 AS tcp_flag_rst
FROM packets""", flows=False))
def port_flags(spark, sf):
    """P7-P11 and F4 on every packet."""
    p = net.with_address_flags(packets(spark, sf, with_flow=False))
    p = net.with_tcp_flags(p).withColumn("is_suspicious_port", net.is_suspicious_port("dst_port"))
    return p.select("packet_id", "is_common_port", "is_high_port", "is_suspicious_port",
                    "src_ip_private", "dst_ip_private", "is_internal_traffic",
                    "tcp_flag_syn", "tcp_flag_ack", "tcp_flag_fin", "tcp_flag_rst")


@plan("zscores", with_packets("""
SELECT packet_id,
       round((packet_size - avg(packet_size) OVER ()) / (stddev_samp(packet_size) OVER () + 0.001::DOUBLE), 6) AS packet_size_zscore,
       round((tcp_window - avg(tcp_window) OVER ()) / (stddev_samp(tcp_window) OVER () + 0.001::DOUBLE), 6) AS tcp_window_zscore,
       round((ip_ttl - avg(ip_ttl) OVER ()) / (stddev_samp(ip_ttl) OVER () + 0.001::DOUBLE), 6) AS ip_ttl_zscore
FROM packets""", flows=False))
def zscores(spark, sf):
    """W3 (one global aggregate, broadcast)."""
    z = flow_ops.zscores(packets(spark, sf, with_flow=False))
    return rounded(z.select("packet_id", "packet_size_zscore", "tcp_window_zscore", "ip_ttl_zscore"))


@plan("derived_packets", with_packets("SELECT 1").replace("\nSELECT 1", "," + _FLOW_STATS_SQL + f"""
SELECT p.packet_id, CAST(hour(p.ts) AS INTEGER) AS hour, CAST(isodow(p.ts) - 1 AS INTEGER) AS day_of_week,
       isodow(p.ts) - 1 IN (5, 6) AS is_weekend, s.flow_duration, s.flow_rate,
       {_sql_in('p.dst_port', net.COMMON_PORTS)} AS is_common_port, coalesce(p.dst_port > 1024, false) AS is_high_port,
       {_sql_is_private('p.src_ip')} AND {_sql_is_private('p.dst_ip')} AS is_internal_traffic,
       round((p.packet_size - avg(p.packet_size) OVER ()) / (stddev_samp(p.packet_size) OVER () + 0.001::DOUBLE), 6)
         AS packet_size_zscore,
       coalesce(p.protocol = 'ICMP', false) AS proto_ICMP, coalesce(p.protocol = 'TCP', false) AS proto_TCP,
       coalesce(p.protocol = 'UDP', false) AS proto_UDP
FROM pflows p LEFT JOIN flow_stats s ON p.flow_id = s.flow_id"""))
def derived_packets(spark, sf):
    """The derived packet columns of a capture."""
    p = packets(spark, sf)
    out = flow_ops.with_derived(p, ts="timestamp", proto_levels=["ICMP", "TCP", "UDP"])
    return rounded(out.select("packet_id", "hour", "day_of_week", "is_weekend", "flow_duration", "flow_rate",
                              "is_common_port", "is_high_port", "is_internal_traffic", "packet_size_zscore",
                              "proto_ICMP", "proto_TCP", "proto_UDP"))
