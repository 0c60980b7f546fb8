"""Plans for payload patterns, entropy, HTTP hosts and threat scoring
(F2, F3, F19-F21, F25, F27, A9-A11, A29, A40, T2, J5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions import net, text
from flowlake.functions.bytes import byte_entropy
from flowlake.operators import summary, threat
from flowlake.plans.packets import packets, with_packets
from flowlake.plans.registry import plan, rounded, table

# ---- payload text: pages.html and documents.text ---------------------------


def _payload_texts(spark, sf):
    pages = table(spark, sf, "pages", spread_scan=True).select(F.lit("pages").alias("source"),
                                             F.col("page_id").alias("item_id"), F.col("html").alias("payload"))
    docs = table(spark, sf, "documents", spread_scan=True).select(F.lit("documents").alias("source"),
                                                F.col("doc_id").alias("item_id"), F.col("text").alias("payload"))
    return pages.unionByName(docs)


_TEXTS_SQL = """texts AS (SELECT 'pages' AS source, page_id AS item_id, html AS payload FROM pages
  UNION ALL SELECT 'documents', doc_id, text FROM documents)"""


def _sql_hits():
    out = []
    for fam, pats, w in text.PATTERN_FAMILIES:
        for p in pats:
            q = p.replace("'", "''")
            out.append((f"{fam}:{p}".replace("'", "''"), w, f"coalesce(contains(lower(payload), '{q}'), false)"))
    return out


_SCORE_SQL = " + ".join(f"CASE WHEN {h} THEN {w} ELSE 0 END" for _, w, h in _sql_hits())
_LIST_SQL = "concat_ws('|', " + ", ".join(f"CASE WHEN {h} THEN '{lbl}' END" for lbl, _, h in _sql_hits()) + ")"
_SCORED_SQL = f"""scored AS (SELECT source, item_id, CAST({_SCORE_SQL} AS INTEGER) AS suspicious_score,
  {_LIST_SQL} AS suspicious_patterns FROM texts)"""


def _scored(spark, sf):
    return text.with_payload_patterns(_payload_texts(spark, sf), "payload").where(
        F.col("suspicious_score").isNotNull())


@plan("payload_patterns", f"""WITH {_TEXTS_SQL}, {_SCORED_SQL}
SELECT source, item_id, suspicious_score, suspicious_patterns FROM scored WHERE suspicious_score > 0""")
def payload_patterns(spark, sf):
    """F3 + F25 on every page and document (rows with a hit)."""
    return _scored(spark, sf).select("source", "item_id", "suspicious_score", "suspicious_patterns")


@plan("payload_pattern_counts", f"""WITH {_TEXTS_SQL}, {_SCORED_SQL}
SELECT pattern, count(*) AS count
FROM (SELECT unnest(string_split(suspicious_patterns, '|')) AS pattern FROM scored WHERE suspicious_score > 0) u
GROUP BY pattern""")
def payload_pattern_counts(spark, sf):
    """A11 counts per pattern."""
    return summary.pattern_counts(_scored(spark, sf))


@plan("security_summary", f"""WITH {_TEXTS_SQL}, {_SCORED_SQL}
SELECT count(*) AS suspicious_packets, count(*) FILTER (WHERE suspicious_score >= 5) AS high_risk_flows,
       count(DISTINCT CASE WHEN suspicious_score >= 5 THEN source || ':' || CAST(item_id AS VARCHAR) END) AS high_risk_flow_ids
FROM scored WHERE suspicious_score > 0""")
def security_summary(spark, sf):
    """A11 one-row summary (an item stands for a flow here)."""
    s = _scored(spark, sf).withColumn("flow_id", F.concat_ws(":", "source", F.col("item_id").cast("string")))
    return summary.security_summary(s)


@plan("payload_entropy", """
WITH p AS (SELECT 'pages' AS source, page_id AS item_id, html AS payload FROM pages
  UNION ALL SELECT 'documents', doc_id, text FROM documents),
b AS (SELECT source, item_id, unnest(regexp_extract_all(hex(encode(payload)), '..')) AS byte FROM p),
c AS (SELECT source, item_id, byte, count(*) AS n FROM b GROUP BY 1, 2, 3),
t AS (SELECT source, item_id, sum(n) AS tot FROM c GROUP BY 1, 2),
e AS (SELECT source, item_id, -sum((n / tot) * log2(n / tot)) AS h FROM c JOIN t USING (source, item_id) GROUP BY 1, 2)
SELECT source, item_id, round(CASE WHEN p.payload IS NULL THEN NULL ELSE coalesce(e.h, 0.0) END, 6) AS payload_entropy
FROM p LEFT JOIN e USING (source, item_id)""")
def payload_entropy(spark, sf):
    """F2 on every page and document (UTF-8 bytes)."""
    p = table(spark, sf, "pages", spread_scan=True).select(
        F.lit("pages").alias("source"), F.col("page_id").alias("item_id"), F.col("html").alias("payload"))
    d = table(spark, sf, "documents", spread_scan=True).select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("item_id"), F.col("text").alias("payload"))
    return rounded(p.unionByName(d).select("source", "item_id", byte_entropy("payload").alias("payload_entropy")))


# ---- HTTP requests from page URLs -------------------------------------------

_HOST_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)"


def _http(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(F.lit("GET").alias("http_method"),
                    F.try_parse_url("url", F.lit("HOST")).alias("http_host"),
                    F.try_parse_url("url", F.lit("PATH")).alias("http_uri"))


@plan("http_hosts", f"""SELECT {_HOST_SQL} AS http_host, count(*) AS count FROM pages
WHERE {_HOST_SQL} IS NOT NULL AND {_HOST_SQL} <> '' GROUP BY 1""")
def http_hosts(spark, sf):
    """F27 + A12: requests per host."""
    return summary.value_counts(_http(spark, sf).where(F.col("http_host") != ""), "http_host")


@plan("top_domains", f"""SELECT {_HOST_SQL} AS http_host, count(*) AS count FROM pages
WHERE {_HOST_SQL} IS NOT NULL AND {_HOST_SQL} <> '' GROUP BY 1 ORDER BY count DESC, http_host ASC LIMIT 10""")
def top_domains(spark, sf):
    """Ten most requested hosts (a top-k report)."""
    return summary.top_k(_http(spark, sf).where(F.col("http_host") != ""), "http_host", 10)


@plan("http_summary", f"""SELECT count(*) AS total_requests, count(DISTINCT {_HOST_SQL}) AS unique_hosts FROM pages""")
def http_summary(spark, sf):
    """A10."""
    return summary.http_summary(_http(spark, sf))


# ---- threat scoring on the packet view --------------------------------------

# Threat lists for the plans: fixed addresses chosen to hit every rule branch
# on the packet view (listed and Tor source, Tor-only source, listed and
# Tor-only destinations).
PLAN_MALICIOUS = ["10.0.0.7", "10.0.0.42", "9.9.9.9"]
PLAN_TOR = ["10.0.0.42", "10.0.0.99", "8.8.8.8"]


def _lists(spark):
    m = spark.createDataFrame([(x,) for x in PLAN_MALICIOUS], "ip string")
    t = spark.createDataFrame([(x,) for x in PLAN_TOR], "ip string")
    return m, t


def _sql_list(xs):
    return ", ".join(f"'{x}'" for x in xs)


_M, _T = _sql_list(PLAN_MALICIOUS), _sql_list(PLAN_TOR)
_THREAT_SQL = f"""
flags AS (SELECT *, coalesce(src_ip IN ({_M}), false) AS sm, coalesce(src_ip IN ({_T}), false) AS st,
                    coalesce(dst_ip IN ({_M}), false) AS dm, coalesce(dst_ip IN ({_T}), false) AS dt,
                    coalesce(dst_port IN ({', '.join(map(str, net.SUSPICIOUS_PORTS))}), false) AS sp FROM packets),
raw AS (SELECT *, (CASE WHEN sm THEN 50 ELSE 0 END) + (CASE WHEN NOT sm AND st THEN 20 ELSE 0 END)
                 + (CASE WHEN st THEN 30 ELSE 0 END) + (CASE WHEN dm THEN 50 ELSE 0 END)
                 + (CASE WHEN NOT dm AND dt THEN 20 ELSE 0 END) + (CASE WHEN sp THEN 10 ELSE 0 END) AS r,
               concat_ws('; ',
                 CASE WHEN sm THEN 'Malicious source IP: ' || src_ip END,
                 CASE WHEN NOT sm AND st THEN 'Suspicious source IP: ' || src_ip END,
                 CASE WHEN st THEN 'Tor exit node: ' || src_ip END,
                 CASE WHEN dm THEN 'Malicious destination IP: ' || dst_ip END,
                 CASE WHEN NOT dm AND dt THEN 'Suspicious destination IP: ' || dst_ip END,
                 CASE WHEN sp THEN 'Suspicious port: ' || CAST(dst_port AS VARCHAR) END) AS ind
        FROM flags)"""


def _threats(spark, sf):
    m, t = _lists(spark)
    return threat.threat_scores(packets(spark, sf, with_flow=False), m, t)


@plan("threat_scores", with_packets(f""",{_THREAT_SQL}
SELECT packet_id, CAST(least(r, 100) AS INTEGER) AS threat_score,
       CASE WHEN r > 60 THEN 'high' WHEN r > 30 THEN 'medium' ELSE 'low' END AS threat_level,
       ind AS threat_indicators FROM raw""", flows=False).replace("\n,", ",", 1))
def threat_scores(spark, sf):
    """F20 on every packet (indicators joined by '; ')."""
    return _threats(spark, sf).select("packet_id", "threat_score", "threat_level",
                                      F.array_join("threat_indicators", "; ").alias("threat_indicators"))


@plan("threat_indicators", with_packets(f""",{_THREAT_SQL}
SELECT indicator, count(*) AS count
FROM (SELECT unnest(string_split(ind, '; ')) AS indicator FROM raw WHERE ind <> '') u
GROUP BY 1 ORDER BY count DESC, indicator ASC LIMIT 10""", flows=False).replace("\n,", ",", 1))
def threat_indicators(spark, sf):
    """Ten most frequent indicators (a top-k report)."""
    return (threat.indicator_counts(_threats(spark, sf))
            .orderBy(F.desc("count"), F.asc("indicator")).limit(10))


@plan("threat_levels", with_packets(f""",{_THREAT_SQL}
SELECT CASE WHEN r > 60 THEN 'high' WHEN r > 30 THEN 'medium' ELSE 'low' END AS threat_level, count(*) AS count
FROM raw GROUP BY 1""", flows=False).replace("\n,", ",", 1))
def threat_levels(spark, sf):
    """P20: packets per threat level (non-low = threats, high = alerts)."""
    return summary.value_counts(_threats(spark, sf), "threat_level")


@plan("reputation", with_packets(f"""
SELECT ip, CASE WHEN m THEN 'malicious' WHEN t THEN 'suspicious' ELSE 'unknown' END AS reputation,
       CASE WHEN m THEN 100 WHEN t THEN 70 ELSE 0 END AS score, t AS is_tor,
       concat_ws(',', CASE WHEN m THEN 'malicious' END, CASE WHEN t THEN 'tor' END) AS categories,
       CASE WHEN m OR t THEN 'local' ELSE 'offline' END AS source
FROM (SELECT ip, coalesce(ip IN ({_M}), false) AS m, coalesce(ip IN ({_T}), false) AS t
      FROM (SELECT src_ip AS ip FROM packets UNION SELECT dst_ip FROM packets) u WHERE ip IS NOT NULL) x""",
                                  flows=False))
def reputation(spark, sf):
    """F19 + J5 over every address seen (both ends)."""
    m, t = _lists(spark)
    p = packets(spark, sf, with_flow=False)
    ips = p.select(F.col("src_ip").alias("ip")).unionAll(p.select(F.col("dst_ip").alias("ip")))
    r = threat.reputation(ips, m, t)
    return r.withColumn("categories", F.array_join("categories", ","))


@plan("alerts", f"""WITH {_TEXTS_SQL}, {_SCORED_SQL},
pc AS (SELECT pattern, count(*) AS count
       FROM (SELECT unnest(string_split(suspicious_patterns, '|')) AS pattern FROM scored WHERE suspicious_score > 0) u
       GROUP BY pattern),
n AS (SELECT count(*) AS n FROM scored WHERE suspicious_score > 0)
SELECT 1 AS alert_order, CASE WHEN n > 10 THEN 'high' ELSE 'medium' END AS severity,
       'Suspicious payload activity detected' AS title,
       'Detected ' || CAST(n AS VARCHAR) || ' packets with suspicious payload patterns.' AS details
FROM n WHERE n > 0
UNION ALL
SELECT CAST(1 + row_number() OVER (ORDER BY count DESC, pattern ASC) AS INTEGER), 'medium', 'Attack pattern observed',
       'Pattern ' || pattern || ' seen ' || CAST(count AS VARCHAR) || ' times.'
FROM (SELECT * FROM pc ORDER BY count DESC, pattern ASC LIMIT 5) t""")
def alerts(spark, sf):
    """A40 + F17: alert rows of a run over the payload table."""
    scored = _scored(spark, sf)
    n = scored.agg(F.count(F.lit(1)).alias("n"))
    return threat.run_alerts(spark, n, summary.pattern_counts(scored)).select(
        F.col("alert_order").cast("int").alias("alert_order"), "severity", "title", "details")


_HIGH_SQL = """high AS (SELECT count(*) AS n FROM raw WHERE r > 60),
al AS (SELECT 'Detected ' || CAST(n AS VARCHAR) || ' high severity threats' AS key, CAST(n AS DOUBLE) AS value FROM high WHERE n > 0)"""


@plan("capture_report", with_packets(f""",{_THREAT_SQL},
{_HIGH_SQL},
top AS (SELECT key, value FROM (SELECT key, CAST(count(*) AS DOUBLE) AS value FROM
  (SELECT unnest(string_split(ind, '; ')) AS key FROM raw WHERE ind <> '') u GROUP BY key) x ORDER BY value DESC, key LIMIT 10)
SELECT 'summary' AS section, 0 AS pos, 'analyzed_packets' AS key, CAST(count(*) AS DOUBLE) AS value FROM packets
UNION ALL SELECT 'summary', 1, 'duration', round(max("timestamp") - min("timestamp"), 6) FROM packets
UNION ALL SELECT 'summary', 2, 'threats_detected', CAST(count(*) AS DOUBLE) FROM al
UNION ALL SELECT 'top_threat_indicators', CAST(row_number() OVER (ORDER BY value DESC, key) - 1 AS INTEGER), key, value FROM top""",
                                     flows=False).replace("\n,", ",", 1))
def capture_report(spark, sf):
    """A39 over the packet view, without a detector."""
    from flowlake.streaming.monitor import batch_alerts
    p = packets(spark, sf, with_flow=False)
    m, t = _lists(spark)
    return rounded(threat.capture_report(p, threat.threat_scores(p, m, t), batch_alerts(p, 0, malicious=m, tor=t)))


@plan("traffic_report_full", with_packets(f""",{_THREAT_SQL},
{_HIGH_SQL},
tot AS (SELECT CAST(count(*) AS DOUBLE) AS p, CAST(sum(coalesce(packet_size, 0)) AS DOUBLE) AS b FROM packets),
pr AS (SELECT coalesce(protocol, 'Unknown') AS key, CAST(count(*) AS DOUBLE) AS value FROM packets GROUP BY 1),
tk AS (SELECT src_ip AS key, CAST(count(*) AS DOUBLE) AS value FROM packets WHERE src_ip <> '' GROUP BY 1 ORDER BY value DESC, key LIMIT 10)
SELECT 'totals' AS section, 0 AS pos, 'duration' AS key, 300.0::DOUBLE AS value
UNION ALL SELECT 'totals', 1, 'total_packets', p FROM tot UNION ALL SELECT 'totals', 2, 'total_bytes', b FROM tot
UNION ALL SELECT 'totals', 3, 'packets_per_second', round(p / 300.0::DOUBLE, 6) FROM tot
UNION ALL SELECT 'totals', 4, 'bytes_per_second', round(b / 300.0::DOUBLE, 6) FROM tot
UNION ALL SELECT 'protocol_distribution', CAST(row_number() OVER (ORDER BY value DESC, key) - 1 AS INTEGER), key, value FROM pr
UNION ALL SELECT 'top_talkers', CAST(row_number() OVER (ORDER BY value DESC, key) - 1 AS INTEGER), key, value FROM tk
UNION ALL SELECT 'recent_alerts', 0, key, value FROM al""", flows=False).replace("\n,", ",", 1))
def traffic_report_full(spark, sf):
    """A33 with every section, alerts from the threat rules."""
    from flowlake.operators import counters
    from flowlake.streaming.monitor import batch_alerts
    p = packets(spark, sf, with_flow=False)
    m, t = _lists(spark)
    return rounded(counters.traffic_report_rows(counters.counters(p), batch_alerts(p, 0, malicious=m, tor=t)))
