"""Threat operators: local reputation (F19, J5), verdict from engine results
(F18), packet threat score (F20, F21), indicator counts (A29), alert rows
(A17/A40 rules, F17), new-IP anti join (J12).

Threat lists are DataFrames with one ``ip`` column.  They are joined, not
collected: with AQE a small list becomes a broadcast hash join at run time
and a large feed stays a shuffle join, so no list size is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions import net, text

# Fixed values of the reference's rules.
REP_MALICIOUS_SCORE = 100
REP_TOR_SCORE = 70
W_MALICIOUS = 50
W_SUSPICIOUS = 20
W_TOR = 30
W_PORT = 10
W_CODE_EXEC = 30
W_SQLI = 40
HIGH_ABOVE = 60
MEDIUM_ABOVE = 30


def _ip_list(df: DataFrame, col: str = "ip") -> DataFrame:
    return df.select(F.trim(F.col(col)).alias("ip")).where(F.col("ip").isNotNull() & (F.col("ip") != "")).distinct()


def reputation(ips: DataFrame, malicious: DataFrame, tor: DataFrame, ip_col: str = "ip") -> DataFrame:
    """per distinct IP: reputation, score, is_tor, categories, source."""
    base = ips.select(F.col(ip_col).alias("ip")).where(F.col("ip").isNotNull()).distinct()
    m = _ip_list(malicious).withColumn("__mal", F.lit(True))
    t = _ip_list(tor).withColumn("__tor", F.lit(True))
    r = base.join(m, "ip", "left").join(t, "ip", "left")
    mal = F.coalesce("__mal", F.lit(False))
    tr = F.coalesce("__tor", F.lit(False))
    return r.select(
        "ip",
        F.when(mal, "malicious").when(tr, "suspicious").otherwise("unknown").alias("reputation"),
        F.when(mal, REP_MALICIOUS_SCORE).when(tr, REP_TOR_SCORE).otherwise(0).alias("score"),
        tr.alias("is_tor"),
        F.array_compact(F.array(F.when(mal, F.lit("malicious")), F.when(tr, F.lit("tor")))).alias("categories"),
        F.when(mal | tr, "local").otherwise("offline").alias("source"))


def with_endpoint_flags(df: DataFrame, malicious: DataFrame, tor: DataFrame,
                        src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """List membership of both ends as booleans.  The two lists become
    one (ip, malicious, tor) table, joined once per end."""
    m = _ip_list(malicious).withColumn("__m", F.lit(True))
    t = _ip_list(tor).withColumn("__t", F.lit(True))
    flags = m.join(t, "ip", "full").select("ip", F.coalesce("__m", F.lit(False)).alias("__m"),
                                           F.coalesce("__t", F.lit(False)).alias("__t"))
    out = df
    for end, col in (("src", src), ("dst", dst)):
        f = flags.select(F.col("ip").alias(f"__{end}_ip"), F.col("__m").alias(f"{end}_malicious"),
                         F.col("__t").alias(f"{end}_tor"))
        out = out.join(f, F.col(col) == F.col(f"__{end}_ip"), "left").drop(f"__{end}_ip")
        out = out.withColumns({f"{end}_malicious": F.coalesce(f"{end}_malicious", F.lit(False)),
                               f"{end}_tor": F.coalesce(f"{end}_tor", F.lit(False))})
    return out


def threat_scores(df: DataFrame, malicious: DataFrame, tor: DataFrame, src: str = "src_ip",
                  dst: str = "dst_ip", dst_port: str = "dst_port", payload: str | None = None) -> DataFrame:
    """score (capped at 100), level and indicator texts per row."""
    out = with_endpoint_flags(df, malicious, tor, src, dst)
    s_mal, s_tor = F.col("src_malicious"), F.col("src_tor")
    d_mal, d_tor = F.col("dst_malicious"), F.col("dst_tor")
    s_susp = ~s_mal & s_tor          # reputation 'suspicious' = Tor but not listed
    d_susp = ~d_mal & d_tor
    port_hit = net.is_suspicious_port(dst_port)
    parts = [
        (s_mal, W_MALICIOUS, F.concat(F.lit("Malicious source IP: "), F.col(src))),
        (s_susp, W_SUSPICIOUS, F.concat(F.lit("Suspicious source IP: "), F.col(src))),
        (s_tor, W_TOR, F.concat(F.lit("Tor exit node: "), F.col(src))),
        (d_mal, W_MALICIOUS, F.concat(F.lit("Malicious destination IP: "), F.col(dst))),
        (d_susp, W_SUSPICIOUS, F.concat(F.lit("Suspicious destination IP: "), F.col(dst))),
        (port_hit, W_PORT, F.concat(F.lit("Suspicious port: "), F.col(dst_port).cast("string"))),
    ]
    if payload is not None:
        parts += [(text.has_code_exec(payload), W_CODE_EXEC, F.lit("Code execution attempt detected")),
                  (text.has_sql_injection(payload), W_SQLI, F.lit("SQL injection attempt detected"))]
    raw = F.lit(0)
    for cond, w, _ in parts:
        raw = raw + F.when(cond, F.lit(w)).otherwise(F.lit(0))
    out = out.withColumn("__raw", raw)
    return (out.withColumn("threat_score", F.least(F.col("__raw"), F.lit(100)).cast("int"))
               .withColumn("threat_level", F.when(F.col("__raw") > HIGH_ABOVE, "high")
                           .when(F.col("__raw") > MEDIUM_ABOVE, "medium").otherwise("low"))
               .withColumn("threat_indicators", F.array_compact(F.array(*[F.when(c, t) for c, _, t in parts])))
               .drop("__raw"))


def indicator_counts(scored: DataFrame, col: str = "threat_indicators") -> DataFrame:
    """Occurrences of each indicator text (top-k via summary.top_k)."""
    return (scored.select(F.explode(col).alias("indicator"))
                  .groupBy("indicator").agg(F.count(F.lit(1)).alias("count")))


def verdict_from_engines(df: DataFrame, json_col: str = "json", ip_col: str = "ip") -> DataFrame:
    """Engine-verdict JSON -> share of engines saying malicious.

    Input JSON: {"data": {"attributes": {"reputation": n,
    "last_analysis_results": {engine: {"category": ...}}}}}."""
    schema = ("struct<data: struct<attributes: struct<reputation: bigint, "
              "last_analysis_results: map<string, struct<category: string>>>>>")
    p = df.select(F.col(ip_col).alias("ip"), F.from_json(F.col(json_col), schema).alias("j"))
    res = F.col("j.data.attributes.last_analysis_results")
    mal_map = F.map_filter(res, lambda k, v: v["category"] == "malicious")
    total = F.coalesce(F.size(res), F.lit(0))
    n_mal = F.coalesce(F.size(mal_map), F.lit(0))
    score = F.when(total > 0, n_mal * 100.0 / total).otherwise(F.lit(0.0))
    return p.select("ip",
                    F.when(score > 20, "malicious").when(score > 0, "suspicious").otherwise("clean").alias("reputation"),
                    F.coalesce(F.array_sort(F.map_keys(mal_map)), F.array().cast("array<string>")).alias("categories"),
                    score.alias("score"),
                    F.lit(False).alias("is_tor"),
                    F.lit("engines").alias("source"))


def new_ips(candidates: DataFrame, cache: DataFrame, col: str = "ip") -> DataFrame:
    """IPs not yet in the reputation cache."""
    return candidates.select(col).distinct().join(cache.select(col), col, "left_anti")


def severity_by_count(count_col, high_above: int) -> F.Column:
    """'high' when count > limit, else 'medium'."""
    c = F.col(count_col) if isinstance(count_col, str) else count_col
    return F.when(c > high_above, "high").otherwise("medium")


def run_alerts(spark, suspicious_count: DataFrame, pattern_counts: DataFrame,
               anomaly_count: DataFrame | None = None, top_patterns: int = 5) -> DataFrame:
    """Alert rows of a run: anomalies first, then suspicious payloads,
    then the top patterns.  Inputs are one-row counts and a pattern table."""
    parts = []
    if anomaly_count is not None:
        parts.append(anomaly_count.where(F.col("n") > 0).select(
            F.lit(0).alias("alert_order"), severity_by_count("n", 50).alias("severity"),
            F.lit("Anomalous traffic detected").alias("title"),
            F.format_string("Detected %d anomalous samples across models.", F.col("n")).alias("details")))
    parts.append(suspicious_count.where(F.col("n") > 0).select(
        F.lit(1).alias("alert_order"), severity_by_count("n", 10).alias("severity"),
        F.lit("Suspicious payload activity detected").alias("title"),
        F.format_string("Detected %d packets with suspicious payload patterns.", F.col("n")).alias("details")))
    top = pattern_counts.orderBy(F.desc("count"), F.asc("pattern")).limit(top_patterns)
    parts.append(top.select(
        (F.lit(1) + F.row_number().over(Window.orderBy(F.desc("count"), F.asc("pattern")))).alias("alert_order"),
        F.lit("medium").alias("severity"), F.lit("Attack pattern observed").alias("title"),
        F.format_string("Pattern %s seen %d times.", F.col("pattern"), F.col("count")).alias("details")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def capture_report(packets: DataFrame, scored: DataFrame, alerts: DataFrame, anomalies: DataFrame | None = None,
                   ts: str = "timestamp", top: int = 10) -> DataFrame:
    """A39 as long rows (section, pos, key, value): packets analysed and capture duration, number of alerts,
    the most frequent threat indicators of ``scored`` (from ``threat_scores``), and per model the
    anomalies of ``anomalies`` (model, anomalies), if given."""
    facts = packets.agg(F.count(F.lit(1)).cast("double").alias("analyzed_packets"),
                        F.coalesce(F.max(ts) - F.min(ts), F.lit(0.0)).cast("double").alias("duration"))
    facts = facts.crossJoin(F.broadcast(alerts.agg(F.count(F.lit(1)).cast("double").alias("threats_detected"))))    # one row each
    names = ["analyzed_packets", "duration", "threats_detected"]
    out = facts.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])).alias("pos", "x")) \
        .select(F.lit("summary").alias("section"), F.col("pos").cast("int").alias("pos"), "x.key", "x.value")

    def ranked(section: str, rows: DataFrame, *order) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), (F.row_number().over(Window.orderBy(*order)) - 1).cast("int").alias("pos"),
                           "key", F.col("value").cast("double").alias("value"))
    ind = indicator_counts(scored).orderBy(F.desc("count"), "indicator").limit(top).select(
        F.col("indicator").alias("key"), F.col("count").alias("value"))
    out = out.unionByName(ranked("top_threat_indicators", ind, F.desc("value"), F.asc("key")))
    if anomalies is not None:                   # one row per model
        out = out.unionByName(ranked("anomaly_summary", anomalies.select(
            F.col("model").alias("key"), F.col("anomalies").alias("value")), F.asc("key")))
    return out
