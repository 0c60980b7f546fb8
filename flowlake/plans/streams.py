"""Streaming plans: the driver's ``events`` replayed as a stream with
``trigger(availableNow=True)`` (ST1-ST7, ST11); results land in tables under
the checkpoint folder and are read back.  Their SQL twins state the same
answer over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions import net
from flowlake.plans.packets import packets_from_events, with_packets
from flowlake.plans.registry import plan, table
from flowlake.plans.security import _THREAT_SQL, _lists
from flowlake.streaming import monitor


def _packet_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    ev = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # a glob: the source wants a pattern or a folder
    return packets_from_events(ev).withColumn("flow_id", net.flow_id())


@plan("stream_windows", with_packets("""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, count(*) AS packets,
       CAST(sum(coalesce(packet_size, 0)) AS BIGINT) AS bytes
FROM packets GROUP BY 1""", flows=False))
def stream_windows(spark, sf):
    """ST3: hourly event-time windows with a watermark, update mode."""
    agg = monitor.windowed_counts(_packet_stream(spark, sf), ts="ts", window="1 hour")
    out, ck = monitor.scratch_path(spark, "windows"), monitor.scratch_path(spark, "windows-ck")
    monitor.update_to_table(agg, out, ck)
    schema = "window struct<start: timestamp, end: timestamp>, packets long, bytes long, batch_id long"
    return monitor.latest(spark, out, schema, ["window"]).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                                          "packets", "bytes")


@plan("stream_counters", with_packets("""
SELECT kind, key, count(*) AS packets, CAST(sum(sz) AS BIGINT) AS bytes FROM (
  SELECT 'total' AS kind, 'packets' AS key, coalesce(packet_size, 0) AS sz FROM pflows
  UNION ALL SELECT 'protocol', coalesce(protocol, 'Unknown'), coalesce(packet_size, 0) FROM pflows
  UNION ALL SELECT 'flow', coalesce(flow_id, 'unknown'), coalesce(packet_size, 0) FROM pflows
  UNION ALL SELECT 'src_ip', src_ip, coalesce(packet_size, 0) FROM pflows WHERE src_ip <> ''
  UNION ALL SELECT 'dst_ip', dst_ip, coalesce(packet_size, 0) FROM pflows WHERE dst_ip <> '') u
GROUP BY kind, key"""))
def stream_counters(spark, sf):
    """ST4 / A32: running (kind, key) counters over the replayed stream, without state."""
    out, ck = monitor.scratch_path(spark, "counters"), monitor.scratch_path(spark, "counters-ck")
    monitor.run_available_now(_packet_stream(spark, sf), monitor.counter_writer(out), ck)
    return monitor.counter_totals(spark, out)


@plan("stream_alerts", with_packets(f""",{_THREAT_SQL}
SELECT CAST(0 AS BIGINT) AS batch_id, 'threat' AS alert_type, 'high' AS severity,
       'Detected ' || CAST(count(*) AS VARCHAR) || ' high severity threats' AS details, count(*) AS n,
       (SELECT string_agg(CAST(packet_id AS VARCHAR), ',' ORDER BY packet_id)
        FROM (SELECT packet_id FROM raw WHERE r > 60 ORDER BY packet_id LIMIT 5)) AS example_ids
FROM raw WHERE r > 60 HAVING count(*) > 0""", flows=False).replace("\n,", ",", 1))
def stream_alerts(spark, sf):
    """ST5-ST7: foreachBatch threat alerts, idempotent by batch id (one
    landed file = one batch under availableNow)."""
    m, t = _lists(spark)
    alerts, ck = monitor.scratch_path(spark, "alerts"), monitor.scratch_path(spark, "alerts-ck")
    counters = monitor.scratch_path(spark, "alert-counters")
    sink = monitor.alert_writer(alerts, malicious=m, tor=t, counters_path=counters, report_every=1)
    monitor.run_available_now(_packet_stream(spark, sf), sink, ck)
    ids = F.array_join(F.transform("examples", lambda x: x["packet_id"].cast("string")), ",")
    return monitor.read_alerts(spark, alerts).select("batch_id", "alert_type", "severity", "details", "n", ids.alias("example_ids"))


@plan("stream_recent", with_packets("""
SELECT packet_id, ts, src_ip, dst_ip, packet_size FROM packets ORDER BY ts DESC, packet_id DESC LIMIT 10000""", flows=False))
def stream_recent(spark, sf):
    """ST3: the last 10,000 packets of the replayed stream, a state of as many rows."""
    stream = _packet_stream(spark, sf).select("packet_id", "ts", "src_ip", "dst_ip", "packet_size")
    out, ck = monitor.scratch_path(spark, "recent"), monitor.scratch_path(spark, "recent-ck")
    monitor.run_available_now(stream, monitor.recent_writer(out), ck)
    return monitor.recent_rows(spark, out, stream.schema)


def _replayed(spark, sf, **kw):
    p = packets_from_events(table(spark, sf, "events"))
    landed, alerts, ck = (monitor.scratch_path(spark, f"replay-{n}") for n in ("rows", "alerts", "ck"))
    monitor.land_batches(p, landed)
    m, t = _lists(spark)
    schema = p.schema.add("replay_batch", "long")
    monitor.replay(spark, landed, schema, alerts, ck, malicious=m, tor=t, **kw)
    ids = F.array_join(F.transform("examples", lambda x: x["packet_id"].cast("string")), ",")
    return monitor.read_replay_alerts(spark, alerts).select("batch_id", "alert_type", "severity", "details", "n", ids.alias("example_ids"))


@plan("replay_threats", with_packets(f""",{_THREAT_SQL},
numbered AS (SELECT packet_id, CAST(floor((row_number() OVER (ORDER BY ts, packet_id) - 1) / 1000) AS BIGINT) AS batch_id FROM packets),
high AS (SELECT numbered.batch_id, raw.packet_id, row_number() OVER (PARTITION BY numbered.batch_id ORDER BY raw.packet_id) AS k
         FROM raw JOIN numbered USING (packet_id) WHERE r > 60)
SELECT batch_id, 'threat' AS alert_type, 'high' AS severity, 'Detected ' || CAST(count(*) AS VARCHAR) || ' high severity threats' AS details,
       count(*) AS n, string_agg(CAST(packet_id AS VARCHAR), ',' ORDER BY packet_id) FILTER (WHERE k <= 5) AS example_ids
FROM high GROUP BY batch_id""", flows=False).replace("\n,", ",", 1))
def replay_threats(spark, sf):
    """ST7: the events replayed in 1,000-row batches, threat alerts of every batch."""
    return _replayed(spark, sf)


@plan("replay_alerts")
def replay_alerts(spark, sf):
    """ST5 + ST7: the same replay with a forest trained on the landed rows first: anomaly and threat alerts."""
    from flowlake.operators.detect.detector import DetectorConfig
    from flowlake.plans.models import PACKET_FEATURES
    return _replayed(spark, sf, features=PACKET_FEATURES, config=DetectorConfig(models=("isolation_forest",)))


@plan("stream_sessions", with_packets("""
SELECT flow_id, count(*) AS sessions, CAST(sum(packets) AS BIGINT) AS packets FROM (
  SELECT flow_id, sid, count(*) AS packets FROM (
    SELECT flow_id, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 3600000000 THEN 1 ELSE 0 END)
             OVER (PARTITION BY flow_id ORDER BY ts, packet_id) AS sid
    FROM (SELECT flow_id, ts, packet_id, lag(ts) OVER (PARTITION BY flow_id ORDER BY ts, packet_id) AS prev
          FROM pflows) a) b
  GROUP BY flow_id, sid) c
GROUP BY flow_id"""))
def stream_sessions(spark, sf):
    """ST11: per-flow sessions by a one-hour gap, closed ones from the append table and open ones from the state;
    reported as sessions and packets per flow."""
    agg = monitor.flow_sessions(_packet_stream(spark, sf), ts="ts", gap="1 hour", watermark="10 minutes")
    out, ck = monitor.scratch_path(spark, "sessions"), monitor.scratch_path(spark, "sessions-ck")
    late = monitor.sessions_to_table(agg, out, ck)
    if late:
        raise ValueError(f"{late} rows of the replay came later than its watermark; widen the watermark")
    s = monitor.all_sessions(spark, out, ck)
    return s.groupBy("flow_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("packets").cast("long").alias("packets"))
