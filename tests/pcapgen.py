"""Build small capture files byte by byte for the tests."""

import struct


def _csum(b: bytes) -> int:
    if len(b) % 2:
        b += b"\0"
    s = sum(struct.unpack(f"!{len(b) // 2}H", b))
    s = (s >> 16) + (s & 0xFFFF)
    s += s >> 16
    return ~s & 0xFFFF


def ipv4(src, dst, proto, payload, ttl=64, ident=1):
    tot = 20 + len(payload)
    hdr = struct.pack("!BBHHHBBH4s4s", 0x45, 0, tot, ident, 0x4000, ttl, proto, 0,
                      bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    hdr = hdr[:10] + struct.pack("!H", _csum(hdr)) + hdr[12:]
    return hdr + payload


def eth(payload, ethertype=0x0800):
    return b"\x00\x11\x22\x33\x44\x55" + b"\x66\x77\x88\x99\xaa\xbb" + struct.pack("!H", ethertype) + payload


def tcp(sp, dp, flags, payload=b"", seq=1000, ack=0, window=8192, options=b""):
    off = (20 + len(options)) // 4
    return struct.pack("!HHIIBBHHH", sp, dp, seq, ack, off << 4, flags, window, 0, 0) + options + payload


def udp(sp, dp, payload):
    return struct.pack("!HHHH", sp, dp, 8 + len(payload), 0) + payload


def icmp_echo(ident, seq, payload):
    return struct.pack("!BBHHH", 8, 0, 0, ident, seq) + payload


def dns_query(qid, name, qtype=1):
    q = b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0"
    return struct.pack("!HHHHHH", qid, 0x0100, 1, 0, 0, 0) + q + struct.pack("!HH", qtype, 1)


def write_pcap(path, frames, t0=1700000000.0):
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for i, fr in enumerate(frames):
            ts = t0 + i * 0.5
            sec = int(ts)
            usec = int(round((ts - sec) * 1e6))
            f.write(struct.pack("<IIII", sec, usec, len(fr), len(fr)))
            f.write(fr)


def sample_frames():
    http = b"GET /index.html HTTP/1.1\r\nHost: example.com\r\nUser-Agent: t\r\n\r\n"
    return [
        eth(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(5000, 80, 0x12, http, options=b"\x01\x01\x02\x04\x05\xb4"[:4]))),
        eth(ipv4("10.0.0.2", "10.0.0.1", 6, tcp(80, 5000, 0x10, b"x UNION SELECT y; <script>alert(1)"))),
        eth(ipv4("192.168.1.5", "8.8.8.8", 17, udp(40000, 53, dns_query(77, "example.org")))),
        eth(ipv4("192.168.1.5", "8.8.8.8", 1, icmp_echo(9, 1, b"abcd"))),
        eth(b"\x00\x01\x08\x00\x06\x04\x00\x01" + b"\0" * 20, ethertype=0x0806),
    ]


def write_pcapng(path, frames, t0_us=1700000000000000):
    """Section header, one Ethernet interface, enhanced packet blocks."""
    def block(btype, body):
        pad = (-len(body)) % 4
        blen = 12 + len(body) + pad
        return struct.pack("<II", btype, blen) + body + b"\0" * pad + struct.pack("<I", blen)
    with open(path, "wb") as f:
        f.write(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)))
        f.write(block(1, struct.pack("<HHI", 1, 0, 65535)))
        for i, fr in enumerate(frames):
            ts = t0_us + i * 500000
            f.write(block(6, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(fr), len(fr)) + fr))
