"""The ``packets`` view over the driver's ``events`` table.

The driver tables carry no packets; every packet column below is a fixed
arithmetic over an event, written once for Spark and once as SQL for the
DuckDB twin, so both sides see identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions import net

# Fixed mapping values of the view.
TCP_EVENTS = ["click", "view", "purchase"]
DST_IPS = ["192.168.1.1", "8.8.8.8", "9.9.9.9"]        # by event_id % 3
DST_PORTS = [80, 443, 22, 8080]                         # by k % 4


def packets_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    proto = (F.when(F.col("event_type").isin(TCP_EVENTS), F.lit("TCP"))
              .when(F.col("event_type") == "signup", F.lit("UDP"))
              .when(F.col("event_type") == "error", F.lit("ICMP")))
    dst_ip = F.element_at(F.array(*[F.lit(x) for x in DST_IPS]), (F.col("event_id") % 3 + 1).cast("int"))
    dst_port = F.element_at(F.array(*[F.lit(x) for x in DST_PORTS]), (k % 4 + 1).cast("int"))
    return (events
            .withColumn("protocol", proto)
            .withColumn("k", k)
            .select(
                F.col("event_id").alias("packet_id"),
                F.col("ts"),
                (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)).alias("timestamp"),
                (F.lit(40) + F.floor("value").cast("long")).alias("packet_size"),
                F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("src_ip"),
                dst_ip.alias("dst_ip"),
                F.col("protocol"),
                F.when(F.col("protocol") != "ICMP",
                       (F.lit(1024) + F.col("user_id") * 7919 % 60000).cast("int")).alias("src_port"),
                F.when(F.col("protocol") != "ICMP", dst_port).cast("int").alias("dst_port"),
                F.when(F.col("protocol") == "TCP", (F.col("k") % 64).cast("int")).alias("tcp_flags"),
                (F.lit(32) + F.col("k")).cast("int").alias("ip_ttl"),
                F.when(F.col("protocol") == "TCP",
                       (F.lit(1024) + F.col("event_id") * 31 % 60000).cast("int")).alias("tcp_window"),
                F.col("user_id"),
                F.col("event_type"),
            ))


def packets(spark, sf_dir: str, with_flow: bool = True, spread_scan: bool = False) -> DataFrame:
    from flowlake.plans.registry import table
    ev = table(spark, sf_dir, "events", spread_scan=spread_scan)
    p = packets_from_events(ev)
    if with_flow:
        p = p.withColumn("flow_id", net.flow_id())
    return p


# ---- SQL twin (DuckDB dialect) -------------------------------------------

PACKETS_SQL = """
packets AS (
  SELECT
    event_id AS packet_id,
    ts,
    CAST(epoch_us(ts) AS DOUBLE) / 1000000.0::DOUBLE AS timestamp,
    CAST(40 + CAST(floor(value) AS BIGINT) AS BIGINT) AS packet_size,
    '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS src_ip,
    CASE event_id % 3 WHEN 0 THEN '192.168.1.1' WHEN 1 THEN '8.8.8.8' ELSE '9.9.9.9' END AS dst_ip,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'TCP'
         WHEN event_type = 'signup' THEN 'UDP'
         WHEN event_type = 'error' THEN 'ICMP' END AS protocol,
    CASE WHEN event_type <> 'error' THEN CAST(1024 + user_id * 7919 % 60000 AS INTEGER) END AS src_port,
    CASE WHEN event_type <> 'error' THEN CAST(CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4
         WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 ELSE 8080 END AS INTEGER) END AS dst_port,
    CASE WHEN event_type IN ('click', 'view', 'purchase')
         THEN CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 64 AS INTEGER) END AS tcp_flags,
    CAST(32 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS INTEGER) AS ip_ttl,
    CASE WHEN event_type IN ('click', 'view', 'purchase')
         THEN CAST(1024 + event_id * 31 % 60000 AS INTEGER) END AS tcp_window,
    user_id,
    event_type
  FROM events
)"""


def sql_flow_key(s="src_ip", d="dst_ip", sp="src_port", dp="dst_port", pr="protocol") -> str:
    si, di = f"coalesce({s}, '')", f"coalesce({d}, '')"
    spi, dpi = f"coalesce(CAST({sp} AS BIGINT), 0)", f"coalesce(CAST({dp} AS BIGINT), 0)"
    spt, dpt = f"CAST({spi} AS VARCHAR)", f"CAST({dpi} AS VARCHAR)"
    prt = f"coalesce({pr}, '')"
    fwd = f"{si} || ':' || {spt} || '-' || {di} || ':' || {dpt} || '-' || {prt}"
    rev = f"{di} || ':' || {dpt} || '-' || {si} || ':' || {spt} || '-' || {prt}"
    return f"CASE WHEN {si} < {di} OR ({si} = {di} AND {spi} < {dpi}) THEN {fwd} ELSE {rev} END"


def sql_flow_id(**kw) -> str:
    return f"substr(md5({sql_flow_key(**kw)}), 1, 16)"


PFLOWS_SQL = PACKETS_SQL + f""",
pflows AS (SELECT *, {sql_flow_id()} AS flow_id FROM packets)"""


def with_packets(select_sql: str, flows: bool = True) -> str:
    """Prefix a query over ``packets`` / ``pflows`` with the view CTEs."""
    return "WITH " + (PFLOWS_SQL if flows else PACKETS_SQL) + "\n" + select_sql
