"""Plans for log features, counters, graph, locations, ensemble reports,
classification metrics and sequences (M7, M13, A25-A33, A36, J2, J3, J6-J8,
P17, T5, T7, W1, W4, F29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import counters, ensemble, graph, logfeatures, metrics, order
from flowlake.plans.packets import packets, with_packets
from flowlake.plans.registry import plan, rounded, table

# ---- traffic log view: the packet view as a packet-list export --------------


def _log(spark, sf):
    p = packets(spark, sf, with_flow=False, spread_scan=True)
    return p.select(
        F.col("packet_id").alias("No."), F.col("timestamp").alias("Time"),
        F.col("src_ip").alias("Source"), F.col("dst_ip").alias("Destination"),
        F.col("protocol").alias("Protocol"), F.col("packet_size").alias("Length"),
        F.concat(F.col("event_type"), F.lit(" user "), F.col("user_id").cast("string")).alias("Info"))


_LOG_FEATURES_SQL = """,
lg AS (SELECT packet_id AS no, timestamp AS t, src_ip AS source, dst_ip AS dest, protocol, packet_size AS length,
              event_type || ' user ' || CAST(user_id AS VARCHAR) AS info FROM packets),
sfreq AS (SELECT source, count(*) AS n FROM lg WHERE source IS NOT NULL GROUP BY 1),
dfreq AS (SELECT dest, count(*) AS n FROM lg WHERE dest IS NOT NULL GROUP BY 1),
pvar AS (SELECT source, count(DISTINCT protocol) AS v FROM lg WHERE source IS NOT NULL GROUP BY 1),
codes AS (SELECT protocol, CAST(row_number() OVER (ORDER BY protocol) - 1 AS INTEGER) AS code
          FROM (SELECT DISTINCT protocol FROM lg WHERE protocol IS NOT NULL) d),
feat AS (
  SELECT l.no, coalesce(CAST(l.length AS DOUBLE), 0.0) AS packet_length, coalesce(c.code, -1) AS protocol_encoded,
         coalesce(l.t - lag(l.t) OVER (ORDER BY l.no), 0.0) AS time_delta,
         CAST(coalesce(regexp_matches(l.dest, '(?i)Broadcast|255.255|ff:ff:ff:ff:ff:ff'), false) AS INTEGER) AS is_broadcast,
         s.n AS source_frequency, d.n AS dest_frequency, CAST(coalesce(v.v, 1) AS BIGINT) AS protocol_variety,
         CAST(length(coalesce(l.info, 'nan')) AS INTEGER) AS info_length,
         CAST(coalesce(regexp_matches(l.info, '(?i)error|fail|timeout|refused'), false) AS INTEGER) AS has_error
  FROM lg l LEFT JOIN codes c ON l.protocol = c.protocol LEFT JOIN sfreq s ON l.source = s.source
       LEFT JOIN dfreq d ON l.dest = d.dest LEFT JOIN pvar v ON l.source = v.source),
lab AS (SELECT feat.*, CAST((packet_length > ql) OR coalesce(source_frequency > qf, false) OR has_error > 0 AS INTEGER) AS label
        FROM feat, (SELECT quantile_cont(packet_length, 0.95) AS ql, quantile_cont(source_frequency, 0.90) AS qf FROM feat) q)"""


def _labelled(spark, sf):
    return logfeatures.heuristic_label(logfeatures.log_features(_log(spark, sf)))


@plan("log_features", with_packets(_LOG_FEATURES_SQL + """
SELECT no, packet_length, protocol_encoded, round(time_delta, 6) AS time_delta, is_broadcast, source_frequency,
       dest_frequency, protocol_variety, info_length, has_error FROM feat""", flows=False).replace("\n,", ",", 1))
def log_features(spark, sf):
    """M13 features (J2, J3, W1, F11, F12, P4, P12, P13) on the log view."""
    return rounded(logfeatures.log_features(_log(spark, sf)))


@plan("log_labels", with_packets(_LOG_FEATURES_SQL + """
SELECT no, label FROM lab""", flows=False).replace("\n,", ",", 1))
def log_labels(spark, sf):
    """P17 heuristic label per row."""
    return _labelled(spark, sf).select("no", "label")


@plan("label_rate", with_packets(_LOG_FEATURES_SQL + """
SELECT count(*) FILTER (WHERE label <> 0) AS positives, round(avg(CAST(label <> 0 AS INTEGER)), 6) AS rate
FROM lab""", flows=False).replace("\n,", ",", 1))
def label_rate(spark, sf):
    """A25 on the heuristic labels."""
    return rounded(metrics.label_rate(_labelled(spark, sf)))


# ---- counters and report ----------------------------------------------------

_COUNTERS_SQL = """
SELECT kind, key, count(*) AS packets, CAST(sum(sz) AS BIGINT) AS bytes FROM (
  SELECT 'total' AS kind, 'packets' AS key, coalesce(packet_size, 0) AS sz FROM pflows
  UNION ALL SELECT 'protocol', coalesce(protocol, 'Unknown'), coalesce(packet_size, 0) FROM pflows
  UNION ALL SELECT 'flow', coalesce(flow_id, 'unknown'), coalesce(packet_size, 0) FROM pflows
  UNION ALL SELECT 'src_ip', src_ip, coalesce(packet_size, 0) FROM pflows WHERE src_ip <> ''
  UNION ALL SELECT 'dst_ip', dst_ip, coalesce(packet_size, 0) FROM pflows WHERE dst_ip <> '') u
GROUP BY kind, key"""


@plan("counter_totals", with_packets(_COUNTERS_SQL))
def counter_totals(spark, sf):
    """Packets and bytes per (kind, key)."""
    return counters.counters(packets(spark, sf))


@plan("traffic_report", with_packets(f"""
SELECT 300.0::DOUBLE AS duration, packets AS total_packets, bytes AS total_bytes,
       round(packets / 300.0::DOUBLE, 6) AS packets_per_second, round(bytes / 300.0::DOUBLE, 6) AS bytes_per_second
FROM ({_COUNTERS_SQL}) c WHERE kind = 'total' AND key = 'packets'"""))
def traffic_report(spark, sf):
    """A33 + F28 over a 300 s window length."""
    return rounded(counters.traffic_report(counters.counters(packets(spark, sf)), 300.0))


@plan("top_talkers", with_packets(f"""
SELECT key AS ip, packets FROM ({_COUNTERS_SQL}) c WHERE kind = 'src_ip'
ORDER BY packets DESC, ip ASC LIMIT 10"""))
def top_talkers(spark, sf):
    """T5: ten busiest sources (a top-k report)."""
    return counters.top_talkers(counters.counters(packets(spark, sf)))


# ---- graph on lineitem: part and supplier nodes ------------------------------


def _edges(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"))
    return graph.edge_weights(li, "a", "b")


_EDGES_SQL = """edges AS (
  SELECT least(a, b) AS node_a, greatest(a, b) AS node_b, count(*) AS weight
  FROM (SELECT 'p' || CAST(l_partkey AS VARCHAR) AS a, 's' || CAST(l_suppkey AS VARCHAR) AS b FROM lineitem) x
  WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
deg AS (SELECT node, count(*) AS degree FROM (SELECT node_a AS node FROM edges UNION ALL SELECT node_b FROM edges) e
        GROUP BY node)"""


@plan("edge_weights", f"WITH {_EDGES_SQL} SELECT node_a, node_b, weight FROM edges")
def edge_weights(spark, sf):
    """A30 undirected weighted edges (every row; no row cap)."""
    return _edges(spark, sf)


@plan("node_degree", f"""WITH {_EDGES_SQL}
SELECT node, degree, 10 + 2 * degree AS node_size, 'other' AS node_class FROM deg""")
def node_degree(spark, sf):
    """A30 degree, node size and F24 class."""
    return graph.node_degree(_edges(spark, sf))


@plan("top_subgraph", f"""WITH {_EDGES_SQL},
top AS (SELECT node FROM deg ORDER BY degree DESC, node ASC LIMIT 150)
SELECT node_a, node_b, weight FROM edges
WHERE node_a IN (SELECT node FROM top) AND node_b IN (SELECT node FROM top)""")
def top_subgraph(spark, sf):
    """T7 + J8: edges among the 150 nodes of highest degree (the 100
    suppliers lead by degree, so 150 also takes in the busiest parts)."""
    return graph.top_subgraph(_edges(spark, sf), 150).select("node_a", "node_b", "weight")


@plan("ip_graph_nodes", with_packets("""
SELECT node, count(*) AS degree, 10 + 2 * count(*) AS node_size,
       CASE WHEN node LIKE '10.%' OR node LIKE '192.168.%' THEN 'private' ELSE 'public' END AS node_class
FROM (SELECT node_a AS node FROM e UNION ALL SELECT node_b FROM e) x GROUP BY node""", flows=False).replace(
    "\nSELECT node,", """,
e AS (SELECT least(src_ip, dst_ip) AS node_a, greatest(src_ip, dst_ip) AS node_b, count(*) AS weight FROM packets
      WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY 1, 2)
SELECT node,""", 1))
def ip_graph_nodes(spark, sf):
    """A30 + F24 on the packet view's address graph."""
    return graph.node_degree(graph.edge_weights(packets(spark, sf, with_flow=False)))


# ---- locations: customer nation and supplier nation of every line -----------


@plan("geo_counts", """
WITH ends AS (SELECT c.c_nationkey AS nk FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                JOIN customer c ON o.o_custkey = c.c_custkey
              UNION ALL SELECT s.s_nationkey FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey),
cnt AS (SELECT n.n_name AS country, n.n_regionkey AS region, count(*) AS count FROM ends JOIN nation n ON ends.nk = n.n_nationkey
        GROUP BY 1, 2)
SELECT country, region, count, round(5.0::DOUBLE + count / (SELECT max(count) FROM cnt) * 15, 6) AS radius,
       CASE WHEN count > (SELECT max(count) FROM cnt) * 0.7 THEN 'red' ELSE 'blue' END AS color FROM cnt""")
def geo_counts(spark, sf):
    """J6 + A31: both ends of every line mapped to a nation."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    ends = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
              .join(s, F.col("l_suppkey") == s.s_suppkey)
              .select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ip"), F.col("n_name").alias("country"),
                                                F.col("n_regionkey").alias("region"))
    return rounded(graph.location_counts(ends, nations, "src", "dst", "ip", ("country", "region")))


# ---- ensemble over rule votes on lineitem -------------------------------------

RULES = [("quantity_rule", "l_quantity > 45"), ("discount_rule", "l_discount > 0.08"),
         ("tax_rule", "l_tax > 0.06")]
MODELS = [m for m, _ in RULES]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _votes(spark, sf):
    li = table(spark, sf, "lineitem")
    v = li.select("l_orderkey", "l_linenumber", *FEATURES,
                  *[F.when(F.expr(r), F.lit(-1)).otherwise(F.lit(1)).alias(m) for m, r in RULES])
    v = ensemble.with_ensemble(v, MODELS, "soft", out="ensemble")
    return ensemble.with_ensemble(v, MODELS, "hard", out="ensemble_hard")


_VOTES_SQL = "votes AS (SELECT l_orderkey, l_linenumber, " + ", ".join(FEATURES) + ", " + ", ".join(
    f"CASE WHEN {r.replace('0.08', '0.08::DOUBLE').replace('0.06', '0.06::DOUBLE')} THEN -1 ELSE 1 END AS {m}"
    for m, r in RULES) + " FROM lineitem), ens AS (SELECT *, CASE WHEN (" + " + ".join(
    f"({m} + 1) / 2.0 * (1.0 / {len(MODELS)})" for m in MODELS) + ") > 0.5 THEN 1 ELSE -1 END AS ensemble, " + \
    "CASE WHEN (" + " + ".join(f"CASE WHEN {m} = 1 THEN 1 ELSE 0 END" for m in MODELS) + ") > (" + " + ".join(
    f"CASE WHEN {m} = -1 THEN 1 ELSE 0 END" for m in MODELS) + ") THEN 1 ELSE -1 END AS ensemble_hard FROM votes)"


@plan("ensemble_votes", f"WITH {_VOTES_SQL} SELECT l_orderkey, l_linenumber, ensemble, ensemble_hard FROM ens")
def ensemble_votes(spark, sf):
    """M7 soft and hard votes over three rule detectors."""
    return _votes(spark, sf).select("l_orderkey", "l_linenumber", "ensemble", "ensemble_hard")


_AGREE_SQL = "(" + " + ".join(f"CASE WHEN {m} = {MODELS[0]} THEN 1.0 ELSE 0.0 END" for m in MODELS) + f") / {len(MODELS)}.0"


@plan("model_agreement", f"WITH {_VOTES_SQL} SELECT round(avg({_AGREE_SQL}), 6) AS model_agreement FROM ens")
def model_agreement(spark, sf):
    """A27."""
    return rounded(ensemble.model_agreement(_votes(spark, sf), MODELS))


_SUMMARY_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS model, count(*) FILTER (WHERE {m} = -1) AS total_anomalies, "
    f"count(*) FILTER (WHERE {m} = -1) * 100.0::DOUBLE / count(*) AS anomaly_percentage, "
    f"count(*) - count(*) FILTER (WHERE {m} = -1) AS normal_samples FROM ens" for m in MODELS + ["ensemble"])


@plan("model_summary", f"""WITH {_VOTES_SQL}
SELECT model, total_anomalies, round(anomaly_percentage, 6) AS anomaly_percentage, normal_samples
FROM ({_SUMMARY_SQL}) s""")
def model_summary(spark, sf):
    """A26 per rule detector and the ensemble."""
    return rounded(ensemble.model_summary(_votes(spark, sf), MODELS + ["ensemble"]))


_GAPS_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CASE WHEN ensemble = -1 THEN {f} END) AS anomaly_mean, "
    f"avg(CASE WHEN ensemble = 1 THEN {f} END) AS normal_mean FROM ens" for f in FEATURES)


@plan("feature_gaps", f"""WITH {_VOTES_SQL}
SELECT feature, round(anomaly_mean, 6) AS anomaly_mean, round(normal_mean, 6) AS normal_mean,
       round(abs(anomaly_mean - normal_mean), 6) AS difference
FROM ({_GAPS_SQL}) g WHERE abs(anomaly_mean - normal_mean) IS NOT NULL
ORDER BY abs(anomaly_mean - normal_mean) DESC, feature LIMIT 10""")
def feature_gaps(spark, sf):
    """Features that separate ensemble anomalies from normal rows."""
    return rounded(ensemble.feature_gaps(_votes(spark, sf), FEATURES))


@plan("recommendations", f"""WITH {_VOTES_SQL},
agree AS (SELECT avg({_AGREE_SQL}) AS a FROM ens),
summ AS ({_SUMMARY_SQL}),
gaps AS ({_GAPS_SQL}),
top3 AS (SELECT feature, abs(anomaly_mean - normal_mean) AS d FROM gaps
         WHERE abs(anomaly_mean - normal_mean) IS NOT NULL ORDER BY d DESC, feature LIMIT 3)
SELECT 0 AS rec_order, '{ensemble.MSG_LOW_AGREEMENT}' AS recommendation FROM agree WHERE a < 0.7
UNION ALL
SELECT 1 + CASE model WHEN 'isolation_forest' THEN 1 WHEN 'one_class_svm' THEN 2 WHEN 'dbscan' THEN 3
                      WHEN 'autoencoder' THEN 4 WHEN 'ensemble' THEN 5 ELSE 0 END,
       CASE WHEN anomaly_percentage > 20 THEN 'High anomaly rate (' || printf('%.1f', anomaly_percentage) || '%) detected by ' || model || '. Review contamination parameters.'
            ELSE 'Very low anomaly rate (' || printf('%.1f', anomaly_percentage) || '%) detected by ' || model || '. Consider adjusting sensitivity.' END
FROM summ WHERE anomaly_percentage > 20 OR anomaly_percentage < 1
UNION ALL
SELECT 100, '{ensemble.MSG_FOCUS}' || string_agg(feature, ', ' ORDER BY d DESC, feature) FROM top3
HAVING count(*) > 0""")
def recommendations(spark, sf):
    """F29 rule rows over the rule ensemble."""
    v = _votes(spark, sf)
    agree = ensemble.model_agreement(v, MODELS)
    summ = ensemble.model_summary(v, MODELS + ["ensemble"])
    gaps = ensemble.feature_gaps(v, FEATURES)
    return ensemble.recommendations(agree, summ, gaps)


# ---- metrics: labels table, quality as truth, toxic as prediction -----------


@plan("confusion", """SELECT CAST(quality AS VARCHAR) AS label, CAST(toxic AS VARCHAR) AS prediction, count(*) AS count
FROM labels GROUP BY 1, 2""")
def confusion(spark, sf):
    """A36 confusion counts."""
    return metrics.confusion(table(spark, sf, "labels"), "quality", "toxic")


@plan("classification_report", """
WITH cm AS (SELECT CAST(quality AS VARCHAR) AS label, CAST(toxic AS VARCHAR) AS prediction, count(*) AS count
            FROM labels GROUP BY 1, 2),
cls AS (SELECT label AS c FROM cm WHERE label IS NOT NULL UNION SELECT prediction FROM cm WHERE prediction IS NOT NULL),
t AS (SELECT cls.c,
             coalesce((SELECT sum(count) FROM cm WHERE label = cls.c AND prediction = cls.c), 0) AS tp,
             coalesce((SELECT sum(count) FROM cm WHERE label = cls.c), 0) AS support,
             coalesce((SELECT sum(count) FROM cm WHERE prediction = cls.c), 0) AS predicted FROM cls),
m AS (SELECT c, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r, support, tp FROM t),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m)
SELECT c AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(spark, sf):
    """A36 per class and averages (zero division -> 0)."""
    return rounded(metrics.classification_report(table(spark, sf, "labels"), "quality", "toxic"))


# ---- sequences ----------------------------------------------------------------


@plan("sequence_windows", with_packets("""
SELECT user_id, packet_id, seq FROM (
  SELECT user_id, packet_id,
         string_agg(CAST(packet_size AS VARCHAR), ',') OVER (PARTITION BY user_id ORDER BY ts, packet_id
                                                          ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS seq,
         count(*) OVER (PARTITION BY user_id ORDER BY ts, packet_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS k
  FROM packets) w WHERE k = 10""", flows=False))
def sequence_windows(spark, sf):
    """Windows of 10 packets per user (step 1), full windows only."""
    p = packets(spark, sf, with_flow=False)
    s = order.sequences(p, "user_id", ["ts", "packet_id"], "packet_size", k=10)
    return s.select("user_id", "packet_id", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seq"))
