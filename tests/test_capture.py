import hashlib

from flowlake.sources import capture
from tests.pcapgen import sample_frames, write_pcap


def test_decode_and_flow(spark, tmp_path):
    path = tmp_path / "a.pcap"
    write_pcap(str(path), sample_frames())
    df = capture.read_captures(spark, str(tmp_path))
    rows = {r.packet_id: r for r in df.collect()}
    assert len(rows) == 5
    http, resp, dns, ping, arp = (rows[i] for i in range(5))
    assert (http.protocol, http.src_port, http.dst_port, http.tcp_flags) == ("TCP", 5000, 80, 0x12)
    assert http.tcp_flag_syn and http.tcp_flag_ack and not http.tcp_flag_fin
    assert (http.application, http.http_method, http.http_host, http.http_uri) == ("HTTP", "GET", "example.com", "/index.html")
    assert http.tcp_options_length == 12  # NOP, NOP, MSS -> three options
    assert http.flow_id == resp.flow_id == hashlib.md5(b"10.0.0.1:5000-10.0.0.2:80-TCP").hexdigest()[:16]
    assert resp.suspicious_score == 7 and resp.suspicious_patterns == "SQL:union select|XSS:<script|XSS:alert("
    assert (dns.application, dns.dns_query, dns.dns_qtype, dns.dns_id, dns.dns_qr) == ("DNS", "example.org.", 1, 77, 0)
    assert (ping.protocol, ping.icmp_type, ping.icmp_id, ping.payload_size) == ("ICMP", 8, 9, 4)
    assert arp.src_ip is None and arp.protocol is None
    assert http.ip_ttl == 64 and http.ip_flags == 2 and http.timestamp == 1700000000.0
    assert abs(ping.timestamp - 1700000001.5) < 1e-9


def test_chunked_equals_whole(spark, tmp_path):
    frames = sample_frames() * 40
    write_pcap(str(tmp_path / "b.pcap"), frames)
    whole = capture.read_captures(spark, str(tmp_path))
    parts = capture.read_captures(spark, str(tmp_path), chunk_bytes=500)
    key = ["packet_id", "flow_id", "packet_size", "timestamp"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, parts.select(key).collect()))
    assert parts.select("packet_id").distinct().count() == len(frames)


def test_datasource(spark, tmp_path):
    write_pcap(str(tmp_path / "c.pcap"), sample_frames())
    capture.register(spark)
    df = capture.finish(spark.read.format("capture").load(str(tmp_path)))
    assert df.count() == 5
    assert df.where("protocol = 'TCP'").select("flow_id").distinct().count() == 1


def test_pcapng(spark, tmp_path):
    from tests.pcapgen import write_pcapng
    write_pcapng(str(tmp_path / "n.pcapng"), sample_frames())
    rows = {r.packet_id: r for r in capture.read_captures(spark, str(tmp_path)).collect()}
    assert len(rows) == 5 and rows[0].http_host == "example.com" and rows[2].dns_query == "example.org."
    assert abs(rows[1].timestamp - 1700000000.5) < 1e-6


def test_datasource_prunes_files(spark, tmp_path):
    write_pcap(str(tmp_path / "a.pcap"), sample_frames())
    write_pcap(str(tmp_path / "b.pcap"), sample_frames()[:2])
    capture.register(spark)
    df = spark.read.format("capture").load(str(tmp_path))
    one = spark.read.format("capture").load(str(tmp_path / "b*.pcap"))
    assert one.count() == 2
    assert one.rdd.getNumPartitions() == 1          # the other file was never planned
    assert df.count() == 7


def test_ids_over_files_and_damaged_files(spark, tmp_path):
    from tests.pcapgen import write_pcapng
    write_pcap(str(tmp_path / "a.pcap"), sample_frames())
    write_pcapng(str(tmp_path / "b.pcapng"), sample_frames() * 20)
    write_pcap(str(tmp_path / "c.pcap"), sample_frames())
    whole = (tmp_path / "c.pcap").read_bytes()
    (tmp_path / "c.pcap").write_bytes(whole[:-7])
    (tmp_path / "d.cap").write_bytes(b"no capture at all, just text")
    (tmp_path / "e.pcap").write_bytes(b"")
    for chunk in (None, 400):
        rows = capture.read_captures(spark, str(tmp_path), chunk_bytes=chunk).select(
            "packet_id", "source_file", "decode_error", "http_host").collect()
        assert len({r.packet_id for r in rows}) == len(rows) == 5 + 100 + 4 + 1 + 1
        bad = {r.source_file.rsplit("/", 1)[1]: r.decode_error for r in rows if r.decode_error}
        assert set(bad) == {"c.pcap", "d.cap"}        # Spark's scan leaves files of zero bytes out
        assert bad["c.pcap"].startswith("truncated or corrupt record at byte") and "not a capture" in bad["d.cap"]
        assert sum(r.http_host == "example.com" for r in rows) == 1 + 20 + 1
    errors = {r.source_file.rsplit("/", 1)[1]: r.bad_records for r in capture.decode_errors(
        capture.read_captures(spark, str(tmp_path))).collect()}
    assert errors == {"c.pcap": 1, "d.cap": 1}


def test_nothing_found_is_an_error(spark, tmp_path):
    import pytest
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        capture.read_captures(spark, str(tmp_path))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        capture.read_captures(spark, str(tmp_path / "missing"))


def test_later_fragments_have_no_ports(spark, tmp_path):
    frame = bytearray(sample_frames()[0])
    frame[20:22] = b"\x00\x10"           # fragment offset 16
    write_pcap(str(tmp_path / "f.pcap"), [bytes(frame)])
    r = capture.read_captures(spark, str(tmp_path)).first()
    assert (r.src_ip, r.ip_fragment_offset, r.protocol, r.src_port, r.tcp_flags) == ("10.0.0.1", 16, None, None, None)


def test_capture_stream_ids_are_unique(spark, tmp_path):
    from flowlake.streaming import monitor
    (tmp_path / "in").mkdir()
    for n in "ab":
        write_pcap(str(tmp_path / "in" / f"{n}.pcap"), sample_frames())
    got = []
    monitor.run_available_now(monitor.capture_stream(spark, str(tmp_path / "in")),
                              lambda b, n: got.extend(b.select("packet_id").collect()), str(tmp_path / "ck"))
    assert len(got) == 10 and len({r.packet_id for r in got}) == 10
