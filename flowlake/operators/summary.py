"""Summary extractors of a packet table.

Each extractor is ``DataFrame -> DataFrame``.  ``summarize`` runs a chosen
set and unions them into long rows ``(section, metric, key, value)``; an
extractor whose columns are missing is skipped and reported as a row, so
one failing section never hides the others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions import net
from flowlake.operators import flow as flow_ops
from flowlake.operators import order as order_ops
from flowlake.operators import series
from flowlake.operators.quantiles import exact_quantiles


def value_counts(df: DataFrame, col: str, out: str = "count", dropna: bool = True) -> DataFrame:
    """Counts of a column, largest first (ties by value)."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return src.groupBy(col).agg(F.count(F.lit(1)).alias(out))


def top_k(df: DataFrame, col: str, k: int = 10, out: str = "count") -> DataFrame:
    """K most frequent values; plans as TakeOrderedAndProject."""
    return value_counts(df, col, out).orderBy(F.desc(out), F.asc(col)).limit(k)


def basic_features(df: DataFrame, flow: str = "flow_id", src: str = "src_ip", dst: str = "dst_ip",
                   size: str = "packet_size", approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """A1 (one row).  Distinct counts are exact by default (each plans as its
    own partial aggregate on the key, so a hot key is combined map-side);
    ``approx=True`` uses HyperLogLog++ sketches (one pass, no shuffle of keys)."""
    distinct = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.countDistinct
    return df.agg(F.count(F.lit(1)).alias("total_packets"),
                  distinct(flow).alias("unique_flows"),
                  distinct(src).alias("unique_src_ips"),
                  distinct(dst).alias("unique_dst_ips"),
                  F.avg(size).alias("avg_packet_size"),
                  F.sum(size).cast("long").alias("total_bytes"))


def column_statistics(df: DataFrame, cols: Sequence[str] = ("packet_size", "tcp_window", "ip_ttl"),
                      approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """A4: mean, std (sample), min, max, median, q75, q25 per column.

    Columns are stacked into (column, value) rows, then one grouped aggregate
    and the distributed exact quantiles (quantiles.py); ``approx=True`` takes
    the quartiles from ``percentile_approx`` in the same single aggregate."""
    cols = [c for c in cols if c in df.columns]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("s")).select("s.column", "s.value")
    aggs = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max")]
    if approx:
        q = F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.25)), accuracy)
        return long.groupBy("column").agg(*aggs, q.alias("__q")).select(
            "column", "mean", "std", "min", "max", F.col("__q")[0].alias("median"),
            F.col("__q")[1].alias("q75"), F.col("__q")[2].alias("q25"))
    moments = long.groupBy("column").agg(*aggs)
    qs = exact_quantiles(long, "value", [0.5, 0.75, 0.25], by=["column"], names=["median", "q75", "q25"])
    return moments.join(qs, "column", "left")


def port_scan_sources(df: DataFrame, src: str = "src_ip", port: str = "dst_port", threshold: int = 100) -> DataFrame:
    """Sources contacting more than ``threshold`` distinct ports."""
    return (df.where(F.col(src).isNotNull())
              .groupBy(src).agg(F.countDistinct(port).alias("distinct_ports"))
              .where(F.col("distinct_ports") > threshold))


def tcp_features(df: DataFrame, proto: str = "protocol", flags: str = "tcp_flags",
                 window: str = "tcp_window") -> DataFrame:
    """SYN, ACK, FIN, RST packet counts and mean window over TCP rows."""
    bits = dict(net.TCP_FLAG_BITS)
    tcp = df.where(F.col(proto) == "TCP")

    def flag(name):
        col = f"tcp_flag_{name}"
        return F.col(col) if col in df.columns else net.tcp_flag(flags, bits[name])
    return tcp.agg(F.count_if(F.coalesce(flag("syn"), F.lit(False))).alias("syn_packets"),
                   F.count_if(F.coalesce(flag("ack"), F.lit(False))).alias("ack_packets"),
                   F.count_if(F.coalesce(flag("fin"), F.lit(False))).alias("fin_packets"),
                   F.count_if(F.coalesce(flag("rst"), F.lit(False))).alias("rst_packets"),
                   F.avg(window).alias("avg_window_size"))


def dns_summary(df: DataFrame, query: str = "dns_query") -> DataFrame:
    """Total queries and distinct domains (one row); top domains by ``top_k``."""
    q = df.where(F.col(query).isNotNull())
    return q.agg(F.count(F.lit(1)).alias("total_queries"), F.countDistinct(query).alias("unique_domains"))


def http_summary(df: DataFrame, host: str = "http_host", method: str = "http_method") -> DataFrame:
    """A10: total requests and distinct hosts (one row); methods by ``value_counts``."""
    r = df.where(F.col(method).isNotNull())
    return r.agg(F.count(F.lit(1)).alias("total_requests"), F.countDistinct(host).alias("unique_hosts"))


def security_summary(df: DataFrame, score: str = "suspicious_score", patterns: str = "suspicious_patterns",
                     flow: str = "flow_id") -> DataFrame:
    """Suspicious packets, packets with score >= 5 (named as the
    reference names it) and the distinct flows among them (D12)."""
    s = df.where(F.col(score) > 0)
    return s.agg(F.count(F.lit(1)).alias("suspicious_packets"),
                 F.count_if(F.col(score) >= 5).alias("high_risk_flows"),
                 F.countDistinct(F.when(F.col(score) >= 5, F.col(flow))).alias("high_risk_flow_ids"))


def pattern_counts(df: DataFrame, patterns: str = "suspicious_patterns") -> DataFrame:
    """Occurrences of each pattern label."""
    return (df.where(F.col(patterns).isNotNull())
              .select(F.explode(F.split(F.col(patterns), r"\|")).alias("pattern"))
              .groupBy("pattern").agg(F.count(F.lit(1)).alias("count")))


# ---- registry (X1) --------------------------------------------------------

def _long(df: DataFrame, section: str, key_col: str | None = None) -> DataFrame:
    """Wide one-row (or keyed) result to (section, metric, key, value)."""
    metrics = [c for c in df.columns if c != key_col]
    key = F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])).alias("m")).select("section", "m.metric", "key", "m.value")


EXTRACTORS: dict[str, tuple[Sequence[str], Callable[[DataFrame], DataFrame]]] = {
    "basic": (("flow_id", "src_ip", "dst_ip", "packet_size"), lambda d: _long(basic_features(d), "basic")),
    "protocols": (("protocol",), lambda d: _long(value_counts(d, "protocol"), "protocols", "protocol")),
    "flow": (("flow_id", "packet_size", "timestamp"), lambda d: _long(flow_ops.flow_summary(d), "flow")),
    "statistical": (("packet_size",), lambda d: _long(column_statistics(d), "statistical", "column")),
    "hours": (("ts",), lambda d: _long(series.hour_distribution(d), "hours", "hour")),
    "port_scans": (("src_ip", "dst_port"), lambda d: _long(
        port_scan_sources(d).agg(F.count(F.lit(1)).alias("potential_port_scans")), "behavioral")),
    "tcp": (("protocol", "tcp_flags", "tcp_window"), lambda d: _long(tcp_features(d), "tcp")),
    "temporal": (("timestamp",), lambda d: _long(order_ops.gap_stats(d), "temporal")),
    "dns": (("dns_query",), lambda d: _long(dns_summary(d), "dns_analysis")),
    "http": (("http_method", "http_host"), lambda d: _long(http_summary(d), "http_analysis")),
    "http_methods": (("http_method",), lambda d: _long(value_counts(d, "http_method"), "http_methods", "http_method")),
    "security": (("suspicious_score", "suspicious_patterns", "flow_id"),
                 lambda d: _long(security_summary(d), "security_analysis")),
    "attack_patterns": (("suspicious_patterns",), lambda d: _long(pattern_counts(d), "attack_patterns", "pattern")),
}


def summarize(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Run extractors and union their long rows.  A missing input column
    gives a row ``(section, 'skipped', <missing columns>, NULL)``; an
    extractor that fails to plan gives ``(section, 'error', <message>, NULL)``,
    so one failing section never hides the others."""
    from pyspark.errors import PySparkException
    spark = df.sparkSession
    schema = "section string, metric string, key string, value double"
    parts = []
    for name in (names or list(EXTRACTORS)):
        needs, fn = EXTRACTORS[name]
        missing = [c for c in needs if c not in df.columns]
        if missing:
            parts.append(spark.createDataFrame([(name, "skipped", ",".join(missing), None)], schema))
            continue
        try:
            parts.append(fn(df))
        except (PySparkException, ValueError) as e:
            parts.append(spark.createDataFrame([(name, "error", f"{type(e).__name__}: {str(e)[:200]}", None)], schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The k rows with the smallest ``xxhash64(seed, key)``: the same rows
    whatever the partitioning (a bounded top-k, TakeOrderedAndProject)."""
    return (df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key)))
              .orderBy("__h", key).limit(k).drop("__h"))


def time_sorted(df: DataFrame, ts: str = "timestamp", partitions: int | None = None) -> DataFrame:
    """Rows in time order across the output: range partitioning on time,
    then a sort inside each partition (no single-task sort)."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(n, F.col(ts)).sortWithinPartitions(ts)


def require_rows(df: DataFrame, min_rows: int = 1, min_cols: int = 1) -> int:
    """Guard before a model: at least ``min_rows`` rows (counted with
    ``limit``, so a large table is not scanned) and ``min_cols`` columns."""
    if len(df.columns) < min_cols:
        raise ValueError(f"need at least {min_cols} columns, got {len(df.columns)}")
    n = df.limit(min_rows).count()
    if n < min_rows:
        raise ValueError(f"need at least {min_rows} rows, got {n}")
    return n


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int, salts: int = 64,
                    out: str = "rank") -> DataFrame:
    """Top k rows per group without a task per group: rank inside
    ``salts`` hash sub-groups first, then rank the at most k x salts
    survivors of each group.  ``order`` are sort columns (desc/asc applied)."""
    from pyspark.sql import Window
    group = list(group)
    salt = (F.abs(F.xxhash64(*[F.col(c) for c in df.columns])) % salts).alias("__salt")
    w1 = Window.partitionBy(*group, "__salt").orderBy(*order)
    cand = df.select("*", salt).withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (cand.drop("__salt", "__r1").withColumn(out, F.row_number().over(w2).cast("long"))
                .where(F.col(out) <= k))
