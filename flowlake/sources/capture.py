"""Packet-capture sources S3-S6 and P18.

``read_captures(spark, path)`` is the scalable path:

1. Spark's own file listing (``binaryFile``, metadata columns only) finds the
   capture files (``.pcap``, ``.pcapng``, ``.cap``; a file, a folder or a
   glob) on any file system of the cluster; nothing found is an error, and files
   of zero bytes are left out;
2. a scan task walks each file's record or block headers (seeking over the
   packet bytes) and cuts it into byte ranges of about ``chunk_mb`` on
   record boundaries, each with its first packet number and, for pcapng, the
   interfaces known at its start;
3. the ranges are repartitioned and every task decodes its range in Arrow
   batches of the fixed packet schema (Ethernet, VLAN, Linux cooked, raw IP;
   IPv4; TCP, UDP, ICMP; DNS question; HTTP request line and Host; payload
   size, entropy, patterns).

``packet_id`` is unique over all files of a read: the file's number in path
order times 2^40 plus the packet's number in its file.  Later fragments of an
IP datagram carry no layer-4 header, so they have no ports or flags.

The flow id (F1) and the payload patterns (F3) are Spark expressions added
after decoding.  PERMISSIVE: a record that fails to decode keeps its number and
file with the error text in ``decode_error``; a file that is no capture, can't be
read, or ends inside a record gives one row that says so with the byte offset.
``good_packets`` drops those rows (P18), ``decode_errors`` counts them per file.

Local paths are opened directly, other URIs through Arrow's file systems.

``spark.read.format("capture").load(path)`` (registered by ``register``)
reads whole local files, one partition per file, with the same decoder.
"""

from __future__ import annotations

import glob
import json
import os
import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.functions import net, text
from flowlake.schemas import PACKET_FIELDS

EXTENSIONS = (".pcap", ".pcapng", ".cap")
DECODED_FIELDS = [f for f in PACKET_FIELDS if f[0] not in ("flow_id", "suspicious_score", "suspicious_patterns")]
DECODED_SCHEMA = T.StructType([T.StructField(n, t) for n, t in DECODED_FIELDS]
                              + [T.StructField("payload_text", T.StringType()),
                                 T.StructField("decode_error", T.StringType())])
CHUNK_SCHEMA = "path string, file_no long, chunk long, start long, stop long, first_index long, state string, error string"
FILE_IDS = 1 << 40              # packet numbers of one file

HTTP_METHODS = (b"GET", b"POST", b"PUT", b"DELETE", b"HEAD", b"OPTIONS", b"PATCH", b"CONNECT", b"TRACE")


# ---- file listing and chunking -----------------------------------------------

def list_captures(path: str) -> list[str]:
    if os.path.isdir(path):
        files = [os.path.join(path, f) for f in sorted(os.listdir(path))]
    else:
        files = sorted(glob.glob(path))
    return [f for f in files if f.lower().endswith(EXTENSIONS) and os.path.isfile(f)]


def _pcap_header(buf: bytes):
    magic = buf[:4]
    table = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6),
             b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}
    if magic not in table:
        return None
    endian, res = table[magic]
    linktype = struct.unpack(endian + "I", buf[20:24])[0] & 0x0FFFFFFF
    return endian, res, linktype


def open_capture(path: str):
    """A seekable binary stream of a local file or of a URI."""
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return open(unquote(u.path) if u.scheme else path, "rb")
    from pyarrow import fs
    found, inner = fs.FileSystem.from_uri(path)
    return found.open_input_file(inner)


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_no) of every capture under ``path``, by Spark's listing.  Raises if there is none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path")
    found = found.where(F.lower("path").rlike(r"[.](pcap|pcapng|cap)$"))
    # one narrow row per file; a file's number is its place in path order
    files = found.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("file_no"))
    if not files.take(1):
        raise FileNotFoundError(f"no capture file ({', '.join(EXTENSIONS)}) under {path}")
    return files


def chunk_stream(f, size: int, chunk_bytes: int) -> list[tuple]:
    """Byte ranges on record boundaries: (chunk, start, stop, first_index, state, error).

    ``state`` holds a pcapng section's byte order and interfaces at the range's
    start.  A file that is no capture, or ends inside a record, gives a last range with an error.
    """
    head = f.read(24)
    out: list[tuple] = []
    hdr = _pcap_header(head) if len(head) == 24 else None
    ng = head[:4] == b"\x0a\x0d\x0d\x0a"
    if hdr is None and not ng:
        return [(0, 0, 0, 0, None, "not a capture file (byte 0)" if size else "empty file (byte 0)")]
    state: dict = {"endian": "<", "ifaces": []}
    start = pos = 0 if ng else 24
    first = idx = 0
    at_start, error = json.dumps(state), None
    while pos < size:
        f.seek(pos)
        rec = f.read(16)
        if ng:
            nxt, is_packet = _pcapng_step(f, rec, pos, state)
        else:
            nxt = pos + 16 + struct.unpack(hdr[0] + "I", rec[8:12])[0] if len(rec) == 16 else None
            is_packet = True
        if nxt is None or nxt > size:
            error = f"truncated or corrupt record at byte {pos}"
            break
        idx += is_packet
        pos = nxt
        if pos - start >= chunk_bytes:
            out.append((len(out), start, pos, first, at_start, None))
            start, first, at_start = pos, idx, json.dumps(state)
    if pos > start or not out:
        out.append((len(out), start, pos, first, at_start, None))
    if error:
        out.append((len(out), pos, pos, idx, None, error))
    return out


def chunk_file(path: str, chunk_bytes: int) -> list[tuple]:
    try:
        with open_capture(path) as f:
            f.seek(0, 2)
            size = f.tell()
            f.seek(0)
            return chunk_stream(f, size, chunk_bytes)
    except Exception as e:  # noqa: BLE001 - kept as the file's error row
        return [(0, 0, 0, 0, None, f"unreadable: {type(e).__name__}: {e}")]


def _pcapng_step(f, rec: bytes, pos: int, state: dict) -> tuple[int | None, bool]:
    """End of the block at ``pos`` (None: damaged) and whether it holds a packet; follows sections and interfaces."""
    if len(rec) < 12:
        return None, False
    if rec[:4] == b"\x0a\x0d\x0d\x0a":
        if rec[8:12] not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
            return None, False
        state.update(endian="<" if rec[8:12] == b"\x4d\x3c\x2b\x1a" else ">", ifaces=[])
    btype, blen = struct.unpack(state["endian"] + "II", rec[:8])
    if blen < 12 or blen % 4:
        return None, False
    if btype == 1:
        f.seek(pos + 8)
        body = f.read(blen - 12)
        if len(body) >= 8:
            state["ifaces"].append(_interface(body, state["endian"]))
    return pos + blen, btype in (3, 6)


def _interface(body: bytes, endian: str) -> tuple[int, float]:
    """Link type and seconds per tick of an interface description."""
    lt, tsres, opos = struct.unpack(endian + "H", body[:2])[0], 1e-6, 8
    while opos + 4 <= len(body):
        code, ln = struct.unpack(endian + "HH", body[opos:opos + 4])
        if code == 0:
            break
        if code == 9 and ln >= 1 and opos + 4 < len(body):
            v = body[opos + 4]
            tsres = 2.0 ** -(v & 0x7F) if v & 0x80 else 10.0 ** -v
        opos += 4 + ((ln + 3) // 4) * 4
    return lt, tsres


# ---- protocol decoding -------------------------------------------------------

def _entropy(b: bytes) -> float:
    if not b:
        return 0.0
    c = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    p = c[c > 0] / len(b)
    return float(-(p * np.log2(p)).sum())


def _dns_name(buf: bytes, off: int, depth: int = 0):
    labels = []
    while off < len(buf):
        ln = buf[off]
        if ln == 0:
            return ".".join(labels) + ".", off + 1
        if ln & 0xC0 == 0xC0:
            if depth > 10 or off + 1 >= len(buf):
                return None, off + 2
            ptr = ((ln & 0x3F) << 8) | buf[off + 1]
            rest, _ = _dns_name(buf, ptr, depth + 1)
            return (".".join(labels) + ("." if labels else "") + (rest or "")), off + 2
        labels.append(buf[off + 1: off + 1 + ln].decode("utf-8", errors="replace"))
        off += 1 + ln
    return None, off


def _tcp_option_count(opts: bytes) -> int:
    n, i = 0, 0
    while i < len(opts):
        kind = opts[i]
        n += 1
        if kind == 0:
            break
        if kind == 1:
            i += 1
            continue
        if i + 1 >= len(opts) or opts[i + 1] < 2:
            break
        i += opts[i + 1]
    return n


def decode_packet(frame: bytes, linktype: int, row: dict) -> None:
    """Fill ``row`` from one captured frame (fields absent stay None)."""
    off, ethertype = 0, None
    if linktype == 1:                                    # Ethernet
        if len(frame) < 14:
            return
        ethertype = struct.unpack("!H", frame[12:14])[0]
        off = 14
        while ethertype in (0x8100, 0x88A8) and len(frame) >= off + 4:
            ethertype = struct.unpack("!H", frame[off + 2: off + 4])[0]
            off += 4
    elif linktype == 113:                                # Linux cooked
        if len(frame) < 16:
            return
        ethertype = struct.unpack("!H", frame[14:16])[0]
        off = 16
    elif linktype in (101, 228, 12, 14):                 # raw IP / raw IPv4
        ethertype = 0x0800 if frame and frame[0] >> 4 == 4 else None
    if ethertype != 0x0800 or len(frame) < off + 20:
        return
    ip = frame[off:]
    vihl, tos, tot, ident, ffo, ttl, proto, csum = struct.unpack("!BBHHHBBH", ip[:12])
    ihl = (vihl & 0x0F) * 4
    row.update(src_ip=".".join(str(b) for b in ip[12:16]), dst_ip=".".join(str(b) for b in ip[16:20]),
               ip_version=vihl >> 4, ip_header_length=ihl, ip_tos=tos, ip_total_length=tot,
               ip_identification=ident, ip_flags=ffo >> 13, ip_fragment_offset=ffo & 0x1FFF,
               ip_ttl=ttl, ip_protocol=proto, ip_checksum=csum)
    if ffo & 0x1FFF:                                     # a later fragment: no layer-4 header
        return
    end = min(len(ip), tot) if tot >= ihl else len(ip)
    l4 = ip[ihl:end]
    payload = b""
    if proto == 6 and len(l4) >= 20:
        sp, dp, seq, ack, offres, flags, win, tcs, urg = struct.unpack("!HHIIBBHHH", l4[:20])
        dataofs = (offres >> 4) * 4
        fl = ((offres & 0x01) << 8) | flags
        row.update(protocol="TCP", src_port=sp, dst_port=dp, tcp_seq=seq, tcp_ack=ack, tcp_header_length=dataofs,
                   tcp_flags=fl, tcp_window=win, tcp_checksum=tcs, tcp_urgent=urg,
                   tcp_options_length=_tcp_option_count(l4[20:dataofs]) * 4)
        for name, m in net.TCP_FLAG_BITS:
            row[f"tcp_flag_{name}"] = bool(fl & m)
        payload = l4[dataofs:] if dataofs >= 20 else b""
    elif proto == 17 and len(l4) >= 8:
        sp, dp, ulen, ucs = struct.unpack("!HHHH", l4[:8])
        row.update(protocol="UDP", src_port=sp, dst_port=dp, udp_length=ulen, udp_checksum=ucs)
        payload = l4[8:]
    elif proto == 1 and len(l4) >= 4:
        itype, icode, ics = struct.unpack("!BBH", l4[:4])
        echo_like = itype in (0, 8, 13, 14, 15, 16, 17, 18)
        iid = struct.unpack("!H", l4[4:6])[0] if echo_like and len(l4) >= 6 else 0
        row.update(protocol="ICMP", icmp_type=itype, icmp_code=icode, icmp_checksum=ics, icmp_id=iid)
        payload = l4[8:] if len(l4) > 8 else b""
    # application layer
    sport, dport = row.get("src_port"), row.get("dst_port")
    if row.get("protocol") in ("UDP", "TCP") and 53 in (sport, dport) and len(payload) >= 12:
        dbuf = payload if row["protocol"] == "UDP" else payload[2:]
        did, fl2, qd, an = struct.unpack("!HHHH", dbuf[:8])
        row.update(application="DNS", dns_id=did, dns_qr=fl2 >> 15, dns_opcode=(fl2 >> 11) & 0xF,
                   dns_rcode=fl2 & 0xF, dns_qdcount=qd, dns_ancount=an)
        if qd:
            name, o2 = _dns_name(dbuf, 12)
            row["dns_query"] = name
            if name is not None and o2 + 2 <= len(dbuf):
                row["dns_qtype"] = struct.unpack("!H", dbuf[o2:o2 + 2])[0]
        payload = b""
    elif row.get("protocol") == "TCP" and payload.split(b" ", 1)[0] in HTTP_METHODS and b"\r\n" in payload:
        head, _, body = payload.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        parts = lines[0].split(b" ")
        host = b""
        for ln in lines[1:]:
            if ln.lower().startswith(b"host:"):
                host = ln[5:].strip()
        row.update(application="HTTP", http_method=parts[0].decode("utf-8", "replace"),
                   http_host=host.decode("utf-8", "replace"),
                   http_uri=parts[1].decode("utf-8", "replace") if len(parts) > 1 else "")
        payload = body
    if payload:
        row["payload_size"] = len(payload)
        row["payload_entropy"] = _entropy(payload)
        row["payload_text"] = payload.decode("utf-8", errors="ignore").lower()


def _records(buf: bytes, endian: str, res: float):
    pos = 0
    while pos + 16 <= len(buf):
        sec, frac, incl, orig = struct.unpack(endian + "IIII", buf[pos:pos + 16])
        data = buf[pos + 16: pos + 16 + incl]
        yield sec + frac * res, data, orig
        pos += 16 + incl


def _pcapng_records(buf: bytes, state: dict):
    """(timestamp, frame, linktype) of the enhanced and simple packet blocks of a range."""
    endian, ifaces, pos = state["endian"], list(state["ifaces"]), 0
    while pos + 12 <= len(buf):
        if buf[pos:pos + 4] == b"\x0a\x0d\x0d\x0a":
            endian, ifaces = "<" if buf[pos + 8:pos + 12] == b"\x4d\x3c\x2b\x1a" else ">", []
        btype, blen = struct.unpack(endian + "II", buf[pos:pos + 8])
        body = buf[pos + 8:pos + blen - 4]
        pos += blen
        if btype == 1 and len(body) >= 8:
            ifaces.append(_interface(body, endian))
        elif btype == 6 and len(body) >= 20:
            iface, hi, lo, cap, _orig = struct.unpack(endian + "IIIII", body[:20])
            lt, res = ifaces[iface] if iface < len(ifaces) else (1, 1e-6)
            yield ((hi << 32) | lo) * res, body[20:20 + cap], lt
        elif btype in (3, 6):
            lt, res = ifaces[0] if ifaces else (1, 1e-6)
            yield None, body[4:], lt


def iter_range(path: str, start: int, stop: int, first_index: int, state: str | None, error: str | None):
    """Decoded rows of one byte range of a file, one at a time."""
    try:
        with open_capture(path) as f:
            yield from iter_stream(f, start, stop, first_index, path, state, error)
    except OSError as e:
        yield {"packet_id": first_index, "source_file": path, "decode_error": error or f"unreadable: {e}"}


def iter_stream(f, start: int, stop: int, first_index: int, source: str, state: str | None, error: str | None):
    """Decoded rows of a byte range of any seekable binary stream; a range with an error is one row."""
    if error is not None:
        yield {"packet_id": first_index, "source_file": source, "decode_error": error}
        return
    f.seek(0)
    hdr = _pcap_header(f.read(24))
    f.seek(start)
    buf = f.read(stop - start)
    if hdr is not None:
        endian, res, linktype = hdr
        recs = ((ts, data, linktype) for ts, data, _ in _records(buf, endian, res))
    else:
        recs = _pcapng_records(buf, json.loads(state or '{"endian": "<", "ifaces": []}'))
    for i, (ts, data, lt) in enumerate(recs):
        row = {"packet_id": first_index + i, "timestamp": ts, "packet_size": len(data), "source_file": source}
        try:
            decode_packet(data, lt, row)
        except Exception as e:  # noqa: BLE001 - kept as a bad record
            row["decode_error"] = f"{type(e).__name__}: {e}"
        yield row


def _to_frame(rows: list[dict]) -> pd.DataFrame:
    cols = [f.name for f in DECODED_SCHEMA.fields]
    pdf = pd.DataFrame.from_records(rows, columns=cols)
    for f in DECODED_SCHEMA.fields:
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            pdf[f.name] = pdf[f.name].astype("Int64")
        elif isinstance(f.dataType, T.BooleanType):
            pdf[f.name] = pdf[f.name].astype("boolean")
        elif isinstance(f.dataType, T.DoubleType):
            pdf[f.name] = pdf[f.name].astype("float64")
        else:
            pdf[f.name] = pdf[f.name].astype("object")
    return pdf


def _decode_chunks(batches: Iterator[pd.DataFrame], batch_rows: int = 10000) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            rows = []
            for row in iter_range(r.path, int(r.start), int(r.stop), int(r.file_no) * FILE_IDS + int(r.first_index), r.state, r.error):
                rows.append(row)
                if len(rows) >= batch_rows:
                    yield _to_frame(rows)
                    rows = []
            if rows:
                yield _to_frame(rows)


def _chunker(chunk_bytes: int):
    def run(batches):
        for pdf in batches:
            out = [(p, n, *c) for p, n in zip(pdf["path"], pdf["file_no"], strict=True) for c in chunk_file(p, chunk_bytes)]
            yield pd.DataFrame(out, columns=["path", "file_no", "chunk", "start", "stop", "first_index", "state", "error"])
    return run


def finish(decoded: DataFrame) -> DataFrame:
    """Spark-side columns: F3 patterns on the payload text, F1 flow id."""
    out = text.with_payload_patterns(decoded, "payload_text")
    out = out.withColumn("flow_id", net.flow_id())
    cols = [n for n, _ in PACKET_FIELDS]
    return out.select(*cols, "decode_error")


def decode_files(files: DataFrame, chunk_bytes: int, spread: bool = True) -> DataFrame:
    """Packets of the captures named by (path, file_no)."""
    chunks = files.mapInPandas(_chunker(chunk_bytes), CHUNK_SCHEMA)
    if spread:
        chunks = chunks.repartition("path", "chunk")
    return finish(chunks.mapInPandas(_decode_chunks, DECODED_SCHEMA))


def read_captures(spark: SparkSession, path: str, chunk_mb: int = 128, chunk_bytes: int | None = None) -> DataFrame:
    """Every capture under ``path`` as one DataFrame (schema 1.3 +
    ``decode_error``).  Raises when no capture is found."""
    files = capture_files(spark, path).repartition("path")
    return decode_files(files, chunk_bytes or chunk_mb * 1024 * 1024)


def good_packets(df: DataFrame, require_ip: bool = False) -> DataFrame:
    """Drop records that failed to decode (and, for the live path,
    those without an IP layer)."""
    out = df.where(F.col("decode_error").isNull())
    return out.where(F.col("src_ip").isNotNull()) if require_ip else out


def decode_errors(df: DataFrame) -> DataFrame:
    """Side table of the records that failed, per file."""
    return (df.where(F.col("decode_error").isNotNull())
              .groupBy("source_file").agg(F.count(F.lit(1)).alias("bad_records"),
                                          F.first("decode_error").alias("example")))


# ---- Python Data Source: spark.read.format("capture") --------------------------

def register(spark: SparkSession) -> None:
    """Register ``spark.read.format("capture")``.  Files are chosen by the
    path (a folder or a glob), so unwanted captures are never planned.  The
    reader keeps no per-query state: PySpark reuses one reader for every
    query of a DataFrame, so filter pushdown state would leak between them."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class _FilePartition(InputPartition):
        def __init__(self, number, path):
            self.number, self.path = number, path

    class CaptureReader(DataSourceReader):
        def __init__(self, options):
            self.path = options.get("path")

        def partitions(self):
            return [_FilePartition(i, p) for i, p in enumerate(list_captures(self.path))]

        def read(self, partition):
            for _, start, stop, first, state, error in chunk_file(partition.path, 1 << 27):
                for row in iter_range(partition.path, start, stop, partition.number * FILE_IDS + first, state, error):
                    yield tuple(row.get(f.name) for f in DECODED_SCHEMA.fields)

    class CaptureSource(DataSource):
        @classmethod
        def name(cls):
            return "capture"

        def schema(self):
            return DECODED_SCHEMA

        def reader(self, schema):
            return CaptureReader(self.options)

    spark.dataSource.register(CaptureSource)
