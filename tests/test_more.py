"""T1, T9, P19, F30, A9 on captures, M15 grid, K1/K2/K5 writers, ST1 capture stream."""

import json

import pytest
from pyspark.sql import functions as F

from flowlake import sinks
from flowlake.operators import summary, supervised
from flowlake.sources import capture
from flowlake.streaming import monitor
from tests.pcapgen import sample_frames, write_pcap


def test_hash_sample_and_sort(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sorted(r.k for r in summary.hash_sample(df, "k", 50).collect())
    b = sorted(r.k for r in summary.hash_sample(df.repartition(7), "k", 50).collect())
    assert a == b and len(a) == 50
    s = summary.time_sorted(df.withColumn("t", -F.col("k").cast("double")), "t", 4)
    ts = [r.t for r in s.collect()]
    assert ts == sorted(ts)


def test_require_rows(spark):
    with pytest.raises(ValueError):
        summary.require_rows(spark.range(5), min_rows=10)
    assert summary.require_rows(spark.range(50), min_rows=10, min_cols=1) == 10


def test_results_json_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"x": 2})], "id int, tags array<string>, m map<string,int>")
    doc = json.loads(sinks.results_json(df).first().json)
    assert doc == {"id": 1, "tags": ["a", "b"], "m": {"x": 2}}
    sinks.write_csv(df.select("id"), str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().id == "1"
    assert spark.read.json(str(tmp_path / "j")).first().tags == ["a", "b"]


def test_narrative(spark):
    alerts = spark.createDataFrame([("high", "Anomalous traffic detected", "Detected 60 anomalous samples.")],
                                   "severity string, title string, details string")
    lines = sinks.narrative(
        spark, alerts,
        spark.createDataFrame([("TCP", 5), ("UDP", 3)], "protocol string, count long"),
        spark.createDataFrame([(4, 2)], "total_queries long, unique_domains long"),
        spark.createDataFrame([(3, 1)], "total_requests long, unique_hosts long"),
        spark.createDataFrame([(2, 1)], "suspicious_packets long, high_risk_flows long"),
        spark.createDataFrame([("SQL:union select", 2)], "pattern string, count long"),
        spark.createDataFrame([(60,)], "n long"))
    got = [r.line for r in lines.orderBy("line_no").collect()]
    assert got[0] == "- [HIGH] Anomalous traffic detected: Detected 60 anomalous samples."
    assert "Top protocols by packet count: TCP: 5, UDP: 3." in got
    assert "Observed 4 DNS queries across 2 unique domains." in got
    assert "Top detected attack patterns: SQL:union select: 2." in got


def test_dns_summary_on_capture(spark, tmp_path):
    write_pcap(str(tmp_path / "d.pcap"), sample_frames() * 3)
    pk = capture.read_captures(spark, str(tmp_path))
    r = summary.dns_summary(pk).first()
    assert (r.total_queries, r.unique_domains) == (3, 1)
    top = summary.top_k(pk.where("dns_query IS NOT NULL"), "dns_query", 10).first()
    assert (top.dns_query, top["count"]) == ("example.org.", 3)
    h = summary.http_summary(pk).first()
    assert (h.total_requests, h.unique_hosts) == (3, 1)


def test_grid_search_small(spark):
    rows = [(i, float(i % 7), "a" if i % 3 else "b", str(int(i % 7 > 3))) for i in range(120)]
    df = spark.createDataFrame(rows, "rid long, x double, c string, y string")
    res = supervised.grid_search(df, ["x", "c"], "y", "rid", folds=2, trees=[5], depths=[3, 5], min_splits=[1],
                                 parallelism=2)
    assert len(res["avg_metrics"]) == 2 and res["accuracy"] > 0.8


def test_capture_stream(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    write_pcap(str(land / "a.pcap"), sample_frames())
    write_pcap(str(land / "b.pcap"), sample_frames())
    s = monitor.capture_stream(spark, str(land))
    out, ck = str(tmp_path / "o"), str(tmp_path / "ck")
    monitor.complete_to_table(s.groupBy("protocol").count(), out, ck)
    got = {r.protocol: r["count"] for r in spark.read.parquet(out).collect()}
    assert got == {"TCP": 4, "UDP": 2, "ICMP": 2, None: 2}


def test_kdd_forests(spark, tmp_path):
    """M14 (multi-class on attack_type), M16 (logged_in, target not a feature), J4 map."""
    from flowlake.operators.encode import attack_category
    from flowlake.sources import csv
    kinds = ["normal", "neptune", "satan", "rootkit", "mystery"]
    lines = []
    for i in range(300):
        k = kinds[i % 5]
        vals = ["0", "tcp" if i % 2 else "udp", "http", "SF"] + [str((i * 7 + j) % 5) for j in range(37)]
        vals[10] = str(i % 5)            # num_failed_logins tracks the class
        vals[11] = str(i % 2)            # logged_in
        lines.append(",".join(vals + [k, str(i % 21)]))
    (tmp_path / "kdd.csv").write_text("\n".join(lines) + "\n")
    kdd = csv.read_kdd(spark, str(tmp_path / "kdd.csv")).withColumn("rid", F.monotonically_increasing_id())
    cats = {r.attack_type: r.attack_category for r in attack_category(kdd).select("attack_type", "attack_category").distinct().collect()}
    assert cats == {"normal": "Normal", "neptune": "DoS", "satan": "Probe", "rootkit": "U2R", "mystery": None}
    feats = ["num_failed_logins", "hot", "num_access_files", "protocol_type"]
    multi = supervised.train_forest(kdd, feats, "attack_type", "rid", test_fraction=0.2, num_trees=20)
    assert multi["accuracy"] > 0.9
    logged = supervised.train_forest(kdd, ["logged_in"] + feats, "logged_in", "rid", test_fraction=0.2, num_trees=20)
    assert "logged_in" not in [r.feature for r in logged["importances"].collect()]


def test_approx_options(spark):
    rows = [(f"f{i % 50}", f"s{i % 30}", "d", i % 97) for i in range(5000)]
    df = spark.createDataFrame(rows, "flow_id string, src_ip string, dst_ip string, packet_size long")
    exact = summary.basic_features(df).first()
    approx = summary.basic_features(df, approx=True).first()
    assert (exact.unique_flows, exact.unique_src_ips) == (50, 30)
    assert abs(approx.unique_flows - 50) <= 2 and abs(approx.unique_src_ips - 30) <= 2
    a = {r.column: r for r in summary.column_statistics(df, ["packet_size"], approx=True).collect()}
    e = {r.column: r for r in summary.column_statistics(df, ["packet_size"]).collect()}
    assert abs(a["packet_size"].median - e["packet_size"].median) <= 1.0


def test_empty_inputs(spark):
    """Empty tables give empty or NULL answers, not errors."""
    from flowlake.operators import flow, order, series
    from flowlake.operators.quantiles import exact_quantiles, quantile_values
    e = spark.createDataFrame([], "flow_id string, packet_size long, timestamp double, ts timestamp_ntz, "
                                  "src_ip string, dst_ip string, dst_port int, protocol string")
    assert flow.flow_stats(e).count() == 0
    assert series.histogram(e, "packet_size", 5).count() == 0
    assert series.traffic_overview(e).count() == 0
    g = order.gap_stats(e).first()
    assert g.avg_packet_interval is None and g.time_variance is None
    assert quantile_values(e, "packet_size", [0.5]) == [None]
    assert exact_quantiles(e, "packet_size", [0.5], by=["protocol"]).count() == 0
    assert summary.basic_features(e).first().total_packets == 0
    assert summary.summarize(e).count() >= 0


def test_forest_takes_a_feature_with_500_levels(spark):
    from flowlake.operators import supervised
    df = spark.range(2000).selectExpr("id", "concat('level', id % 500) as name", "cast(id % 500 < 250 as int) as label")
    out = supervised.train_forest(df, ["name"], "label", "id", num_trees=5, max_depth=8)
    assert out["accuracy"] > 0.9
    assert [r["feature"] for r in out["importances"].collect()] == ["name"]


def test_per_group_forests_have_no_group_limit(spark):
    from pyspark.sql import functions as F
    from flowlake.operators import batch
    X = spark.range(6000).select((F.col("id") % 200).alias("g"), "id", F.array(F.rand(1), F.rand(2)).alias("features"))
    out = batch.fit_per_group(X, "g", "id", n_trees=10, max_samples=16, rows_per_task=7)
    r = out.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == -1).alias("a")).collect()
    assert len(r) == 200 and all(x["n"] == 30 and 0 < x["a"] <= 6 for x in r)


def test_components_of_a_long_chain(spark):
    from flowlake.operators.detect.dbscan import connected_components
    e = spark.range(300).selectExpr("id as a", "id + 1 as b")
    n = spark.range(301).withColumnRenamed("id", "node")
    assert {r["label"] for r in connected_components(n, e).collect()} == {0}


def test_bucket_number_follows_the_rows(spark, monkeypatch):
    from flowlake.operators import order
    monkeypatch.setattr(order, "ROWS_PER_BUCKET", 10)
    df = spark.range(2000).selectExpr("(id * 7919) % 2000 as t")
    out = order.global_row_number(df, ["t"])
    assert out.filter("row_no <> t + 1").count() == 0
    assert order.with_range_bucket(df, "t").select("__bkt").distinct().count() > 150


def test_saved_detector_keeps_dbscan_and_config(spark, tmp_path):
    from pyspark.sql import functions as F
    from flowlake import sinks
    from flowlake.operators.detect.detector import AnomalyDetector, DbscanConfig, DetectorConfig, EnsembleConfig
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    cfg = DetectorConfig(dbscan=DbscanConfig(eps=0.3, min_samples=3), ensemble=EnsembleConfig(voting="hard"),
                         models=("isolation_forest", "dbscan"))
    m = AnomalyDetector(cfg).fit(df, "id")
    assert not m.failures
    sinks.save_detector(m, str(tmp_path / "m"))
    back = sinks.load_detector(str(tmp_path / "m"))
    assert back.config == cfg and set(back.models) == {"isolation_forest", "dbscan"}
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(back.transform(df)) == key(m.transform(df))


def test_replace_list_may_read_its_own_table(spark, tmp_path):
    from flowlake.sources import feeds
    path = str(tmp_path / "list")
    first = feeds.replace_list(spark.createDataFrame([("1.1.1.1",), (" 2.2.2.2 ",), ("",), ("1.1.1.1",)], "ip string"), path)
    assert sorted(r.ip for r in first.collect()) == ["1.1.1.1", "2.2.2.2"]
    again = feeds.replace_list(first.where("ip <> '1.1.1.1'").union(spark.createDataFrame([("3.3.3.3",)], "ip string")), path)
    assert sorted(r.ip for r in again.collect()) == ["2.2.2.2", "3.3.3.3"]


def test_narrative_takes_the_first_alerts_in_order(spark):
    from flowlake import sinks
    one = lambda **kw: spark.createDataFrame([tuple(kw.values())], list(kw))
    alerts = spark.createDataFrame([(i, "high", f"t{i}", "d") for i in range(14, -1, -1)], "alert_order int, severity string, title string, details string").repartition(5)
    lines = sinks.narrative(spark, alerts, one(protocol="TCP", count=1), one(total_queries=1, unique_domains=1),
                            one(total_requests=1, unique_hosts=1), one(suspicious_packets=1, high_risk_flows=1),
                            one(pattern="p", count=1), one(n=1)).orderBy("line_no").collect()
    assert [r.line for r in lines[:10]] == [f"- [HIGH] t{i}: d" for i in range(10)] and lines[10].line.startswith("Detected 1")


def test_quantiles_refine_around_a_value_that_fills_a_bucket(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from flowlake.operators import quantiles as Q
    df = spark.range(6000).select(F.when(F.col("id") % 10 < 7, F.lit(5.0)).otherwise(F.col("id") / 700.0).alias("v"))
    x = np.array([r.v for r in df.collect()])
    probs = [0.0, 0.05, 0.2, 0.5, 0.77, 0.9, 0.999, 1.0]
    got = Q.exact_quantiles(df, "v", probs, refine_rows=20, buckets=8).first()
    assert np.allclose(list(got), np.quantile(x, probs))
