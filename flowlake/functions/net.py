"""Network scalar functions, all native Spark expressions (codegen friendly).

F1 flow id, F4 TCP flag bits, F5 hex flags, F6 header words, F24 IP class,
P7-P11 port and address predicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's rules.
# Common destination ports.
COMMON_PORTS = [21, 22, 23, 25, 53, 80, 110, 143, 443, 993, 995]
# Suspicious destination ports.
SUSPICIOUS_PORTS = [21, 22, 23, 135, 139, 445, 1433, 3389, 5432, 6379]
# TCP flag bit masks (F4), in bit order.
TCP_FLAG_BITS = [("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8),
                 ("ack", 16), ("urg", 32), ("ece", 64), ("cwr", 128)]
# IPv4 blocks the standard library calls private (network, prefix length),
# and the two addresses inside 192.0.0.0/24 that it excludes.
PRIVATE_V4_BLOCKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
]
PRIVATE_V4_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = r"^" + _OCTET + r"\." + _OCTET + r"\." + _OCTET + r"\." + _OCTET + r"$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dotted_to_int(ip: str) -> int:
    a, b, c, d = (int(p) for p in ip.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def flow_key(src_ip, dst_ip, src_port, dst_port, protocol) -> Column:
    """Direction-free 5-tuple text: lower end first (IP as text, then port)."""
    s_ip = F.coalesce(_c(src_ip).cast("string"), F.lit(""))
    d_ip = F.coalesce(_c(dst_ip).cast("string"), F.lit(""))
    s_pt = F.coalesce(_c(src_port).cast("long"), F.lit(0)).cast("string")
    d_pt = F.coalesce(_c(dst_port).cast("long"), F.lit(0)).cast("string")
    proto = F.coalesce(_c(protocol).cast("string"), F.lit(""))
    forward = (s_ip < d_ip) | ((s_ip == d_ip) & (s_pt.cast("long") < d_pt.cast("long")))
    fwd = F.concat(s_ip, F.lit(":"), s_pt, F.lit("-"), d_ip, F.lit(":"), d_pt, F.lit("-"), proto)
    rev = F.concat(d_ip, F.lit(":"), d_pt, F.lit("-"), s_ip, F.lit(":"), s_pt, F.lit("-"), proto)
    return F.when(forward, fwd).otherwise(rev)


def flow_id(src_ip="src_ip", dst_ip="dst_ip", src_port="src_port", dst_port="dst_port",
            protocol="protocol") -> Column:
    """first 16 hex digits of MD5 of the direction-free key."""
    return F.substring(F.md5(flow_key(src_ip, dst_ip, src_port, dst_port, protocol)), 1, 16)


def with_flow_id(df: DataFrame, out: str = "flow_id", **cols) -> DataFrame:
    return df.withColumn(out, flow_id(**cols))


def tcp_flag(flags, mask: int) -> Column:
    """one flag bit as boolean (NULL flags -> NULL)."""
    return _c(flags).bitwiseAND(F.lit(mask)) != 0


def with_tcp_flags(df: DataFrame, flags: str = "tcp_flags", prefix: str = "tcp_flag_") -> DataFrame:
    return df.withColumns({f"{prefix}{name}": tcp_flag(flags, m) for name, m in TCP_FLAG_BITS})


def hex_to_int(col) -> Column:
    """hex text such as '0x0012' to an integer; bad text -> NULL."""
    txt = F.regexp_replace(F.lower(F.trim(_c(col))), r"^0x", "")
    return F.when(txt.rlike(r"^[0-9a-f]{1,15}$"), F.conv(txt, 16, 10).cast("long"))


def words_to_bytes(col) -> Column:
    """32-bit word count (IHL, data offset) to bytes."""
    return _c(col) * 4


def is_common_port(col="dst_port") -> Column:
    """Missing -> false."""
    return F.coalesce(_c(col).isin(COMMON_PORTS), F.lit(False))


def is_high_port(col="dst_port") -> Column:
    """Port > 1024, missing -> false."""
    return F.coalesce(_c(col) > 1024, F.lit(False))


def is_suspicious_port(col="dst_port") -> Column:
    """P11."""
    return F.coalesce(_c(col).isin(SUSPICIOUS_PORTS), F.lit(False))


def ipv4_to_long(col) -> Column:
    """Dotted IPv4 text to its 32-bit value; anything else -> NULL."""
    ip = _c(col)
    parts = F.split(ip, r"\.")
    value = (parts.getItem(0).cast("long") * 16777216 + parts.getItem(1).cast("long") * 65536
             + parts.getItem(2).cast("long") * 256 + parts.getItem(3).cast("long"))
    return F.when(ip.rlike(IPV4_PATTERN), value)


def is_private_ip(col) -> Column:
    """IPv4 private per the standard library's table; bad or missing -> false."""
    def listed(v: Column) -> Column:
        cond = F.lit(False)
        for net, bits in PRIVATE_V4_BLOCKS:
            lo = _dotted_to_int(net)
            hi = lo + (1 << (32 - bits)) - 1
            cond = cond | v.between(lo, hi)
        return cond & ~v.isin([_dotted_to_int(x) for x in PRIVATE_V4_EXCEPTIONS])
    # a lambda variable holds the parsed address: parsed once, compared with every block
    return F.coalesce(F.get(F.transform(F.array(ipv4_to_long(col)), listed), F.lit(0)), F.lit(False))


def with_address_flags(df: DataFrame, src="src_ip", dst="dst_ip", dst_port="dst_port") -> DataFrame:
    """P7-P10 as columns."""
    return df.withColumns({
        "is_common_port": is_common_port(dst_port),
        "is_high_port": is_high_port(dst_port),
        "src_ip_private": is_private_ip(src),
        "dst_ip_private": is_private_ip(dst),
    }).withColumn("is_internal_traffic", F.col("src_ip_private") & F.col("dst_ip_private"))


def ip_class(col) -> Column:
    """'private' / 'public' for valid IPv4, 'other' otherwise."""
    return (F.when(ipv4_to_long(col).isNull(), F.lit("other"))
            .when(is_private_ip(col), F.lit("private"))
            .otherwise(F.lit("public")))
