"""Threat rules (FIXTURES F18-F20), feeds (S7-S9), CSV routing (P1, S1, S2), sinks."""

import json

from pyspark.sql import functions as F

from flowlake.functions import net, text
from flowlake.functions.time import epoch_to_timestamp, text_to_timestamp
from flowlake.operators import encode, threat
from flowlake.sinks import load_detector, save_detector, text_report, write_text
from flowlake.sources import csv, feeds


def _lists(spark, mal, tor):
    return (spark.createDataFrame([(x,) for x in mal], "ip string"),
            spark.createDataFrame([(x,) for x in tor], "ip string"))


def test_threat_scores(spark):
    m, t = _lists(spark, ["1.1.1.1", "2.2.2.2"], ["2.2.2.2", "3.3.3.3"])
    rows = spark.createDataFrame([
        (1, "1.1.1.1", "5.5.5.5", 3389),   # src malicious, dst unknown, port -> 60 medium
        (2, "2.2.2.2", "1.1.1.1", 80),     # src malicious + Tor, dst malicious -> 130 -> 100 high
        (3, "3.3.3.3", "5.5.5.5", 80),     # Tor only -> 20 + 30 = 50 medium
        (4, "9.9.9.9", "5.5.5.5", 80),     # nothing -> low
    ], "id int, src_ip string, dst_ip string, dst_port int")
    out = {r.id: r for r in threat.threat_scores(rows, m, t).collect()}
    assert (out[1].threat_score, out[1].threat_level) == (60, "medium")
    assert (out[2].threat_score, out[2].threat_level) == (100, "high")
    assert (out[3].threat_score, out[3].threat_level) == (50, "medium")
    assert (out[4].threat_score, out[4].threat_level, out[4].threat_indicators) == (0, "low", [])
    assert out[3].threat_indicators == ["Suspicious source IP: 3.3.3.3", "Tor exit node: 3.3.3.3"]


def test_payload_rules(spark):
    m, t = _lists(spark, ["x"], ["y"])
    rows = spark.createDataFrame([(1, "a", "b", 1, "eval(1) UNION SELECT")], "id int, src_ip string, dst_ip string, "
                                 "dst_port int, payload string")
    r = threat.threat_scores(rows, m, t, payload="payload").first()
    assert r.threat_score == 70 and r.threat_level == "high"


def test_reputation(spark):
    m, t = _lists(spark, ["1.1.1.1"], ["1.1.1.1", "3.3.3.3"])
    ips = spark.createDataFrame([("1.1.1.1",), ("3.3.3.3",), ("4.4.4.4",)], "ip string")
    r = {x.ip: x for x in threat.reputation(ips, m, t).collect()}
    assert (r["1.1.1.1"].reputation, r["1.1.1.1"].score, r["1.1.1.1"].categories) == ("malicious", 100, ["malicious", "tor"])
    assert (r["3.3.3.3"].reputation, r["3.3.3.3"].score, r["3.3.3.3"].is_tor) == ("suspicious", 70, True)
    assert (r["4.4.4.4"].reputation, r["4.4.4.4"].score) == ("unknown", 0)


def test_engine_verdict(spark):
    def ans(n_mal, n):
        res = {f"e{i}": {"category": "malicious" if i < n_mal else "harmless"} for i in range(n)}
        return json.dumps({"data": {"attributes": {"reputation": 0, "last_analysis_results": res}}})
    df = spark.createDataFrame([("a", ans(21, 100)), ("b", ans(1, 100)), ("c", ans(0, 100)), ("d", ans(0, 0))],
                               "ip string, json string")
    got = {r.ip: r.reputation for r in threat.verdict_from_engines(df).collect()}
    assert got == {"a": "malicious", "b": "suspicious", "c": "clean", "d": "clean"}


def test_feeds(spark, tmp_path):
    (tmp_path / "ips.txt").write_text(" 1.1.1.1 \n\n2.2.2.2\n1.1.1.1\n")
    (tmp_path / "tor.txt").write_text("ExitNode X\nExitAddress 5.5.5.5 2024-01-01 00:00:00\nPublished x\n")
    (tmp_path / "rep.json").write_text(json.dumps({"reputation": [{"ip": "7.7.7.7", "threat_score": 3},
                                                                  {"ip": "8.8.8.8", "threat_score": 2},
                                                                  {"ip": "9.9.9.9"}]}))
    assert sorted(r.ip for r in feeds.read_list(spark, str(tmp_path / "ips.txt")).collect()) == ["1.1.1.1", "2.2.2.2"]
    assert [r.ip for r in feeds.read_tor_exits(spark, str(tmp_path / "tor.txt")).collect()] == ["5.5.5.5"]
    rep = feeds.read_reputation_feed(spark, str(tmp_path / "rep.json"))
    assert [r.ip for r in rep.collect()] == ["7.7.7.7"]
    merged = feeds.add_entries(feeds.read_list(spark, str(tmp_path / "ips.txt")), rep)
    assert merged.count() == 3
    cache = spark.createDataFrame([("1.1.1.1",)], "ip string")
    assert [r.ip for r in threat.new_ips(merged, cache).orderBy("ip").collect()] == ["2.2.2.2", "7.7.7.7"]


def test_csv_routing(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("No.,Time,Source,Destination,Protocol,Length,Info\n1,0.5,a,Broadcast,ARP,60,who has\n")
    df = csv.read_csv(spark, str(p))
    assert csv.detect_schema(df) == "traffic_log"
    q = tmp_path / "kdd.csv"
    q.write_text(",".join(["0", "tcp", "http", "SF"] + ["1"] * 37 + ["normal", "20"]) + "\n")
    k = csv.read_kdd(spark, str(q))
    r = k.first()
    assert (r.protocol_type, r.attack_type, r.label, len(k.columns)) == ("tcp", "normal", 20, 43)
    assert csv.detect_schema(k) == "labelled"  # KDD holds all five labelled columns
    assert csv.detect_schema(k.drop("label")) == "generic"


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("0x12", 1700000000.25, "2024-01-02 03:04:05", "a_b c", "x|y", None)],
                               "h string, e double, t string, n string, s string, m string")
    r = df.select(net.hex_to_int("h").alias("h"), epoch_to_timestamp("e").alias("e"),
                  text_to_timestamp("t").alias("t"), text.display_name("n").alias("n"),
                  text.text_length("m").alias("len"), text.percent_text(F.lit(0.047)).alias("pct"),
                  encode.to_number(F.lit("abc")).alias("bad"), encode.clean_number(F.lit(float("inf"))).alias("inf"),
                  text.is_broadcast(F.lit("ff:ff:ff:ff:ff:ff")).alias("b"), text.has_error(F.lit("conn REFUSED")).alias("e2"),
                  ).first()
    assert r.h == 18 and str(r.e) == "2023-11-14 22:13:20.250000" and str(r.t) == "2024-01-02 03:04:05"
    assert (r.n, r.len, r.pct, r.bad, r.inf, r.b, r.e2) == ("A B C", 3, "4.70%", None, 0.0, 1, 1)


def test_report_and_model_roundtrip(spark, tmp_path):
    from flowlake.operators.detect.detector import AnomalyDetector, DetectorConfig
    rows = [(i, float(i % 17), float((i * 7) % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "rid long, a double, b double")
    m = AnomalyDetector(DetectorConfig(models=("isolation_forest", "autoencoder"))).fit(df, "rid")
    save_detector(m, str(tmp_path / "model"))
    m2 = load_detector(str(tmp_path / "model"))
    key = ["rid", "isolation_forest", "autoencoder"]
    assert sorted(map(tuple, m.transform(df).select(key).collect())) == sorted(map(tuple, m2.transform(df).select(key).collect()))
    summary = spark.createDataFrame([("isolation_forest", 30)], "model string, total_anomalies long")
    recs = spark.createDataFrame([(1, "Check A"), (2, "Check B")], "rec_order int, recommendation string")
    lines = text_report(spark, total_packets=spark.createDataFrame([(300,)], "total_packets long"), feature_count=2,
                        anomalies=summary, recommendations=recs)
    got = [r.line for r in lines.orderBy("line_no").collect()]
    assert got[0] == "NETWORK TRAFFIC ANALYSIS REPORT" and "Total Packets: 300" in got
    assert "  Isolation Forest: 30 anomalies" in got and "  2. Check B" in got
    write_text(lines, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == len(got)
