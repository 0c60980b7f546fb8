"""Hand-made rows with known answers (FIXTURES.md part C)."""

import hashlib
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowlake.functions import bytes as fb
from flowlake.functions import net, text
from flowlake.functions.time import with_time_parts
from flowlake.operators import flow as flow_ops
from flowlake.operators import series, summary
from flowlake.operators.quantiles import exact_quantiles


def md5_16(s):
    return hashlib.md5(s.encode()).hexdigest()[:16]


def test_flow_id_both_directions(spark):
    df = spark.createDataFrame(
        [("10.0.0.1", "10.0.0.2", 5000, 80, "TCP"), ("10.0.0.2", "10.0.0.1", 80, 5000, "TCP"),
         ("9.9.9.9", "10.0.0.1", 1, 2, "UDP"), (None, None, None, None, None)],
        "src_ip string, dst_ip string, src_port int, dst_port int, protocol string")
    got = [r[0] for r in df.select(net.flow_id()).collect()]
    assert got[0] == got[1] == md5_16("10.0.0.1:5000-10.0.0.2:80-TCP")
    assert got[2] == md5_16("10.0.0.1:2-9.9.9.9:1-UDP")
    assert got[3] == md5_16(":0-:0-")


def test_entropy(spark):
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"aaaa"),), (bytearray(b"ab"),),
                                (bytearray(bytes(range(256))),), (None,)], "b binary")
    got = [r[0] for r in df.select(fb.byte_entropy("b")).collect()]
    assert got[:4] == pytest.approx([0.0, 0.0, 1.0, 8.0])
    assert got[4] is None


def test_payload_patterns(spark):
    df = spark.createDataFrame([("x UNION SELECT y; <script>alert(1)",), ("execute(",), ("nothing",)], "t string")
    out = text.with_payload_patterns(df, "t").collect()
    assert out[0]["suspicious_score"] == 7
    assert out[0]["suspicious_patterns"] == "SQL:union select|XSS:<script|XSS:alert("
    assert out[1]["suspicious_score"] == 3
    assert out[1]["suspicious_patterns"] == "SQL:execute("
    assert out[2]["suspicious_score"] is None and out[2]["suspicious_patterns"] is None


def test_tcp_flags(spark):
    df = net.with_tcp_flags(spark.createDataFrame([(18,)], "tcp_flags int"))
    r = df.collect()[0]
    on = {n for n, _ in net.TCP_FLAG_BITS if r[f"tcp_flag_{n}"]}
    assert on == {"syn", "ack"}


def test_weekday(spark):
    df = spark.createDataFrame([("2026-12-01",), ("2026-12-05",)], "d string").select(
        F.to_timestamp("d").alias("datetime"))
    r = with_time_parts(df).collect()
    assert (r[0]["day_of_week"], r[0]["is_weekend"]) == (1, False)
    assert (r[1]["day_of_week"], r[1]["is_weekend"]) == (5, True)


def test_ports_and_private(spark):
    df = spark.createDataFrame([(1024,), (1025,), (None,)], "p int")
    assert [r[0] for r in df.select(net.is_high_port("p")).collect()] == [False, True, False]
    ips = ["10.1.1.1", "172.32.0.1", "192.168.0.1", "8.8.8.8", "127.0.0.1", None, "abc"]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    assert [r[0] for r in df.select(net.is_private_ip("ip")).collect()] == [True, False, True, False, True, False, False]


def test_private_matches_stdlib(spark):
    rnd = random.Random(7)
    specials = ["192.0.0.9", "192.0.0.10", "192.0.0.8", "100.64.0.1", "255.255.255.255", "0.1.2.3",
                "169.254.3.4", "198.19.255.255", "198.20.0.0", "240.0.0.1", "203.0.113.9", "01.2.3.4"]
    ips = specials + [".".join(str(rnd.randrange(256)) for _ in range(4)) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    got = [r[0] for r in df.select(net.is_private_ip("ip")).collect()]

    def want(ip):
        try:
            return ipaddress.ip_address(ip).is_private
        except ValueError:
            return False
    assert got == [want(x) for x in ips]


def test_flow_stats(spark):
    df = spark.createDataFrame([("f", 100, 1.0), ("f", 300, 3.0), ("g", 50, 7.0)],
                               "flow_id string, packet_size long, timestamp double")
    r = {x["flow_id"]: x for x in flow_ops.flow_stats(df).collect()}
    f = r["f"]
    assert (f.packet_size_count, f.packet_size_sum, f.packet_size_mean) == (2, 400.0, 200.0)
    assert f.packet_size_std == pytest.approx(141.4214)
    assert f.flow_duration == 2.0 and f.flow_rate == pytest.approx(400 / 2.001)
    g = r["g"]
    assert g.packet_size_std is None and g.flow_duration == 0.0 and g.flow_rate == pytest.approx(50000.0)


def test_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = exact_quantiles(df, "x", [0.25, 0.5, 0.75], names=["q25", "med", "q75"]).collect()[0]
    assert (r.q25, r.med, r.q75) == (1.75, 2.5, 4.75)


def test_quantiles_skewed_and_grouped(spark):
    import numpy as np
    rnd = np.random.default_rng(3)
    vals = np.concatenate([np.full(3000, 5.0), rnd.normal(0, 10, 6000)])
    rows = [("a" if i % 2 else "b", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in exact_quantiles(df, "x", [0.1, 0.5, 0.93], by=["g"], buckets=16).collect()}
    for g in ("a", "b"):
        v = np.array([x for k, x in rows if k == g])
        assert got[g] == pytest.approx(tuple(np.quantile(v, [0.1, 0.5, 0.93])), rel=1e-12)


def test_port_scan(spark):
    rows = [("a", p) for p in range(101)] + [("b", p) for p in range(100)]
    df = spark.createDataFrame(rows, "src_ip string, dst_port int")
    assert [r.src_ip for r in summary.port_scan_sources(df).collect()] == ["a"]


def test_histogram(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    h = series.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 2, 2, 2]


def test_sequences_hot_key_split(spark):
    from flowlake.operators import order
    rows = [(1 if i % 10 else 2, i, float(i)) for i in range(600)] + [(3, i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, t long, v double")
    plain = order.sequences(df, "k", ["t"], "v", k=10)
    split = order.sequences(df, "k", ["t"], "v", k=10, hot_rows=50, buckets=8)
    a = sorted((r.k, r.t, tuple(r.seq)) for r in plain.collect())
    b = sorted((r.k, r.t, tuple(r.seq)) for r in split.collect())
    assert a == b and len(a) == (540 - 9) + (60 - 9)


def test_row_numbers_with_hot_value(spark):
    """A third of the rows share one timestamp: numbering equals a plain sort."""
    from flowlake.operators import order
    rows = [(i, 5.0 if i % 3 == 0 else float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, t double")
    got = {r.id: r.row_no for r in order.global_row_number(df, ["t", "id"], buckets=16).collect()}
    want = {rid: n + 1 for n, (rid, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want
    b = order.with_range_bucket(df, "t", 16, out="b", tiebreak="id")
    assert b.where("t = 5.0").select("b").distinct().count() > 1


def test_quantiles_refined_buckets(spark):
    """Forcing refinement (tiny refine_rows) gives the same exact answer."""
    import numpy as np
    rnd = np.random.default_rng(11)
    vals = np.concatenate([np.full(2000, 3.0), rnd.exponential(2.0, 6000)])
    rows = [("a" if i % 2 else "b", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.q0, r.q1) for r in exact_quantiles(df, "x", [0.05, 0.9], by=["g"], buckets=8,
                                                          refine_rows=50).collect()}
    for g in ("a", "b"):
        v = np.array([x for k, x in rows if k == g])
        assert got[g] == pytest.approx(tuple(np.quantile(v, [0.05, 0.9])), rel=1e-12)
    one = exact_quantiles(df, "x", [0.5], buckets=4, refine_rows=10).first()[0]
    assert one == pytest.approx(float(np.quantile(vals, 0.5)), rel=1e-12)
