"""Fixed schemas: packet rows (1.3), KDD table, traffic log, labelled table."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the routed layouts (fixed values of the reference).
LABELLED_COLUMNS = ["num_failed_logins", "hot", "num_access_files", "attack_type", "label"]
TRAFFIC_LOG_COLUMNS = ["Time", "Source", "No.", "Destination", "Protocol", "Length", "Info"]

# KDD column order, as in the public data set's documentation.
KDD_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login",
    "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
    "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "attack_type", "label",
]
_KDD_STRING = {"protocol_type", "service", "flag", "attack_type"}
_KDD_INT = {"land", "logged_in", "root_shell", "su_attempted", "is_host_login", "is_guest_login", "label"}


def _kdd_type(name: str) -> T.DataType:
    if name in _KDD_STRING:
        return T.StringType()
    if name in _KDD_INT:
        return T.IntegerType()
    if name.endswith("_rate"):
        return T.DoubleType()
    return T.LongType()


KDD_SCHEMA = T.StructType([T.StructField(c, _kdd_type(c)) for c in KDD_COLUMNS])

TRAFFIC_LOG_SCHEMA = T.StructType([
    T.StructField("No.", T.LongType()), T.StructField("Time", T.DoubleType()),
    T.StructField("Source", T.StringType()), T.StructField("Destination", T.StringType()),
    T.StructField("Protocol", T.StringType()), T.StructField("Length", T.IntegerType()),
    T.StructField("Info", T.StringType()),
])

_I, _L, _D, _S, _B = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
PACKET_FIELDS = [
    ("packet_id", _L), ("timestamp", _D), ("packet_size", _L),
    ("src_ip", _S), ("dst_ip", _S), ("ip_version", _I), ("ip_header_length", _I), ("ip_tos", _I),
    ("ip_total_length", _I), ("ip_identification", _I), ("ip_flags", _I), ("ip_fragment_offset", _I),
    ("ip_ttl", _I), ("ip_protocol", _I), ("ip_checksum", _I),
    ("protocol", _S), ("src_port", _I), ("dst_port", _I),
    ("tcp_seq", _L), ("tcp_ack", _L), ("tcp_header_length", _I), ("tcp_flags", _I), ("tcp_window", _I),
    ("tcp_checksum", _I), ("tcp_urgent", _I), ("tcp_options_length", _I),
    ("tcp_flag_fin", _B), ("tcp_flag_syn", _B), ("tcp_flag_rst", _B), ("tcp_flag_psh", _B),
    ("tcp_flag_ack", _B), ("tcp_flag_urg", _B), ("tcp_flag_ece", _B), ("tcp_flag_cwr", _B),
    ("udp_length", _I), ("udp_checksum", _I), ("icmp_type", _I), ("icmp_code", _I),
    ("icmp_checksum", _I), ("icmp_id", _I),
    ("application", _S), ("dns_id", _I), ("dns_qr", _I), ("dns_opcode", _I), ("dns_rcode", _I),
    ("dns_qdcount", _I), ("dns_ancount", _I), ("dns_query", _S), ("dns_qtype", _I),
    ("http_method", _S), ("http_host", _S), ("http_uri", _S),
    ("payload_size", _I), ("payload_entropy", _D), ("suspicious_score", _I), ("suspicious_patterns", _S),
    ("flow_id", _S), ("source_file", _S),
]
PACKET_SCHEMA = T.StructType([T.StructField(n, t) for n, t in PACKET_FIELDS])
