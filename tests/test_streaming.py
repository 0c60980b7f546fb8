"""Streaming: an availableNow replay equals the batch answer on the same rows."""
import pytest

from pyspark.sql import functions as F

from flowlake.functions import net
from flowlake.operators import counters
from flowlake.plans.packets import packets_from_events
from flowlake.streaming import monitor


def _stream(spark, sf_small, tmp_path):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    land = str(tmp_path / "landed")
    ev.repartition(3).write.parquet(land)            # three landed files
    s = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(land)
    return packets_from_events(s).withColumn("flow_id", net.flow_id()), packets_from_events(ev).withColumn(
        "flow_id", net.flow_id())


def test_counters_replay_equals_batch(spark, sf_small, tmp_path):
    stream, batch = _stream(spark, sf_small, tmp_path)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    monitor.complete_to_table(monitor.stream_counters(stream), out, ck)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = sorted(map(tuple, counters.counters(batch).collect()))
    assert got == want


def test_windows_and_alerts(spark, sf_small, tmp_path):
    stream, batch = _stream(spark, sf_small, tmp_path)
    out, ck = str(tmp_path / "w"), str(tmp_path / "wck")
    monitor.complete_to_table(monitor.windowed_counts(stream, window="1 hour"), out, ck)
    assert spark.read.parquet(out).agg(F.sum("packets")).first()[0] == batch.count()
    mal = spark.createDataFrame([("9.9.9.9",)], "ip string")
    tor = spark.createDataFrame([("10.0.0.7",)], "ip string")
    alerts, ack = str(tmp_path / "alerts"), str(tmp_path / "ack")
    sink = monitor.alert_writer(alerts, malicious=mal, tor=tor, counters_path=str(tmp_path / "c"), report_every=2)
    monitor.run_available_now(stream, sink, ack)
    a = spark.read.parquet(alerts)
    assert a.select("batch_id").distinct().count() <= 3
    for r in a.collect():
        assert 1 <= len(r.examples) <= 5 and r.n >= len(r.examples)
    # a retried batch id overwrites its own partition instead of appending twice
    sink(batch, 99)
    once = spark.read.parquet(alerts).where("batch_id = 99").count()
    sink(batch, 99)
    assert once >= 1 and spark.read.parquet(alerts).where("batch_id = 99").count() == once


def test_current_stats_and_reports(spark, sf_small, tmp_path):
    stream, batch = _stream(spark, sf_small, tmp_path)
    alerts, counters_path = str(tmp_path / "al"), str(tmp_path / "co")
    sink = monitor.alert_writer(alerts, malicious=spark.createDataFrame([("9.9.9.9",)], "ip string"),
                                tor=spark.createDataFrame([("10.0.0.7",)], "ip string"),
                                counters_path=counters_path, report_every=2)
    monitor.run_available_now(stream, sink, str(tmp_path / "ck2"))
    stats = monitor.current_stats(spark, counters_path, alerts)
    tot = stats["totals"].where("kind = 'total'").first()
    assert tot.packets == batch.count()
    reports = spark.read.parquet(counters_path + "_reports")
    assert reports.count() >= 1 and set(reports.columns) >= {"total_packets", "packets_per_second", "batch_id"}


def test_lazy_quantiles_many_groups(spark):
    import numpy as np
    from flowlake.operators.quantiles import exact_quantiles
    rows = [(i % 40, float((i * 37) % 101)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.q0 for r in exact_quantiles(df, "x", [0.3], by=["g"], max_groups=10, buckets=8).collect()}
    for g in range(40):
        v = np.array([x for k, x in rows if k == g])
        assert abs(got[g] - np.quantile(v, 0.3)) < 1e-9


def test_lazy_quantiles_skewed_groups(spark):
    import numpy as np
    from flowlake.operators.quantiles import exact_quantiles
    rnd = np.random.default_rng(2)
    rows = [(0 if i < 3000 else 1 + i % 30, float(v)) for i, v in enumerate(
        np.concatenate([rnd.normal(0, 1, 3000), rnd.exponential(1.0, 3000)]))]
    rows += [(0, 0.25)] * 500                       # ties inside the hot group
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: (r.q0, r.q1) for r in exact_quantiles(df, "x", [0.1, 0.77], by=["g"], max_groups=5,
                                                          buckets=8).collect()}
    for g in range(31):
        v = np.array([x for k, x in rows if k == g])
        assert got[g] == pytest.approx(tuple(np.quantile(v, [0.1, 0.77])), rel=1e-12, abs=1e-12)


def test_quiet_and_retried_batches(spark, tmp_path):
    seen = []
    quiet = spark.createDataFrame([("1.1.1.1",)], "ip string")
    loud = spark.createDataFrame([("9.9.9.9",)], "ip string")
    rows = spark.createDataFrame([(1, "9.9.9.9", "9.9.9.9", 80, 10, "TCP", "f")],
                                 "packet_id long, src_ip string, dst_ip string, dst_port int, packet_size long, protocol string, flow_id string")
    path = str(tmp_path / "alerts")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    monitor.alert_writer(path, malicious=quiet, tor=quiet, on_alerts=lambda a, n: seen.append(a.count()))(rows, 0)
    assert seen == [0] and monitor.read_alerts(spark, path).count() == 0
    monitor.alert_writer(path, malicious=loud, tor=quiet)(rows, 1)
    assert [r.batch_id for r in monitor.read_alerts(spark, path).collect()] == [1]
    monitor.alert_writer(path, malicious=quiet, tor=quiet)(rows, 1)      # the retry has no alert any more
    assert monitor.read_alerts(spark, path).count() == 0
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
