"""Plans for the smaller operators, each over a whole driver table: scalar functions (F5, F6, F10, F11,
F16, F18, F21-F23, F30), coercion and column choice (P4-P6, P16), list handling (J12, U2), summaries
(A9, A16, A37, A38, J7) and detector preparation (M1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions import net, text
from flowlake.functions.time import timestamp_to_epoch
from flowlake.operators import batch, cluster, encode, profile, series, summary, threat
from flowlake.operators.detect.prep import fit_prep
from flowlake.plans.packets import packets, with_packets
from flowlake.plans.registry import plan, rounded, table
from flowlake.plans.security import _HOST_SQL, PLAN_MALICIOUS, _http, _sql_list
from flowlake.sinks import results_json
from flowlake.sources.feeds import add_entries

_FEATURES = ["packet_size", "ip_ttl", "tcp_window", "src_port", "dst_port", "tcp_flags"]


@plan("flag_text", with_packets("""
SELECT packet_id, CAST(tcp_flags AS BIGINT) AS flags, CAST(NULL AS BIGINT) AS bad, (5 + packet_id % 3) * 4 AS header_bytes
FROM packets""", flows=False))
def flag_text(spark, sf):
    """F5 + F6: flag bits from hex text, header words to bytes."""
    p = packets(spark, sf, with_flow=False)
    hexed = F.concat(F.lit(" 0x"), F.hex("tcp_flags"))
    return p.select("packet_id", net.hex_to_int(hexed).alias("flags"), net.hex_to_int(F.concat(F.lit("flags "), hexed)).alias("bad"),
                    net.words_to_bytes(F.lit(5) + F.col("packet_id") % 3).alias("header_bytes"))


@plan("text_rules", """
SELECT doc_id, coalesce(contains(lower(text), 'eval(') OR contains(lower(text), 'exec('), false) AS code_exec,
       coalesce(contains(lower(text), 'union select') OR contains(lower(text), 'drop table'), false) AS sql_injection,
       CAST(length(coalesce(text, 'nan')) AS INTEGER) AS n_chars,
       upper(source[1]) || lower(source[2:]) || ' Name' AS display_name FROM documents""")
def text_rules(spark, sf):
    """F11 + F21 + F22 on every document."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.has_code_exec("text").alias("code_exec"), text.has_sql_injection("text").alias("sql_injection"),
                    text.text_length("text").alias("n_chars"),
                    text.display_name(F.concat("source", F.lit("_name"))).alias("display_name"))


@plan("byte_text", "SELECT page_id, md5(lower(html)) AS lowered FROM pages")
def byte_text(spark, sf):
    """bytes of every page to lower-case text, with bad bytes put in and dropped again."""
    p = table(spark, sf, "pages")
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("html", "UTF-8"), F.unhex(F.lit("C3")))
    return p.select("page_id", F.md5(text.bytes_to_text(raw).cast("binary")).alias("lowered"))


@plan("rate_text", """
SELECT lang, format('{:.2f}%', 100.0::DOUBLE * avg(l.quality)) AS quality_rate
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def rate_text(spark, sf):
    """F16: share of good documents per language as percent text."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.avg("quality").alias("q")).select("lang", text.percent_text("q").alias("quality_rate"))


@plan("epoch_seconds", "SELECT event_id, round(CAST(epoch_us(ts) AS DOUBLE) / 1000000.0::DOUBLE, 6) AS epoch FROM events")
def epoch_seconds(spark, sf):
    """F10 on every event."""
    e = table(spark, sf, "events")
    return rounded(e.select("event_id", timestamp_to_epoch(F.col("ts").cast("timestamp")).cast("double").alias("epoch")))


@plan("engine_verdicts", """
WITH m AS (SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS a, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS b FROM labels)
SELECT CAST(doc_id AS VARCHAR) AS ip, CASE WHEN a + b > 0 THEN 'malicious' ELSE 'clean' END AS reputation,
       concat_ws(',', CASE WHEN a = 1 THEN 'alpha' END, CASE WHEN b = 1 THEN 'beta' END) AS categories,
       round((a + b) * 100.0::DOUBLE / 3, 6) AS score FROM m""")
def engine_verdicts(spark, sf):
    """F18 + S10: three engines' answers per labelled row as JSON, scored."""
    said = lambda c: F.struct(F.when(c, "malicious").otherwise("harmless").alias("category"))
    answers = F.struct(said(F.col("quality") == 0).alias("alpha"), said(F.col("toxic") == 1).alias("beta"), said(F.lit(False)).alias("gamma"))
    body = F.struct(F.struct(F.struct(F.lit(0).alias("reputation"), answers.alias("last_analysis_results")).alias("attributes")).alias("data"))
    j = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("ip"), F.to_json(body["data"]).alias("d"))
    j = j.select("ip", F.concat(F.lit('{"data":'), "d", F.lit("}")).alias("json"))
    out = threat.verdict_from_engines(j)
    return rounded(out.select("ip", "reputation", F.array_join("categories", ",").alias("categories"), "score"))


@plan("unknown_ips", with_packets(f"""
SELECT DISTINCT ip FROM (SELECT src_ip AS ip FROM packets UNION ALL SELECT dst_ip FROM packets) u
WHERE ip NOT IN ({_sql_list(PLAN_MALICIOUS)}) AND ip NOT IN (SELECT dst_ip FROM packets)""", flows=False))
def unknown_ips(spark, sf):
    """J12 + U2: addresses that aren't yet in a list grown by a feed."""
    p = packets(spark, sf, with_flow=False)
    known = add_entries(spark.createDataFrame([(x,) for x in PLAN_MALICIOUS], "ip string"), p.select(F.col("dst_ip").alias("ip")))
    seen = p.select(F.col("src_ip").alias("ip")).union(p.select("dst_ip"))
    return threat.new_ips(seen, known)


@plan("clean_numbers", """
SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS DOUBLE) AS level, CAST(NULL AS DOUBLE) AS word, 0.0::DOUBLE AS cleaned
FROM orders""")
def clean_numbers(spark, sf):
    """P4 + P5: text to numbers, bad text missing, missing and infinite 0."""
    o = table(spark, sf, "orders")
    odd = F.when(F.col("o_orderkey") % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return o.select("o_orderkey", encode.to_number(F.substring("o_orderpriority", 1, 1)).alias("level"),
                    encode.to_number("o_orderpriority").alias("word"), encode.clean_number(odd).alias("cleaned"))


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@plan("varying_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\" FROM (SELECT var_samp({c}) AS v FROM lineitem) WHERE v IS NULL OR v <> 0" for c in _LINE))
def varying_columns(spark, sf):
    """P16 on lineitem with a constant column put in."""
    kept = profile.drop_constant_columns(table(spark, sf, "lineitem").withColumn("one", F.lit(1)))
    return spark.createDataFrame([(c,) for c in kept], "column string")


@plan("first_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def first_orders(spark, sf):
    """A preview of ten rows."""
    return profile.preview(table(spark, sf, "orders"), 10, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@plan("dns_summary", f"""SELECT count(*) AS total_queries, count(DISTINCT h) AS unique_domains
FROM (SELECT {_HOST_SQL} AS h FROM pages) x WHERE h IS NOT NULL AND h <> ''""")
def dns_summary(spark, sf):
    """A9, with each page's host as a query."""
    return summary.dns_summary(_http(spark, sf).where(F.col("http_host") != "").withColumnRenamed("http_host", "dns_query"))


def _scaled_sql() -> str:
    q = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) AS {c}_b" for c in _FEATURES)
    z = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in _FEATURES)
    s = ", ".join(f"round(({c} - {c}_m) / CASE WHEN {c}_b - {c}_a = 0 THEN 1.0::DOUBLE ELSE {c}_b - {c}_a END, 6) AS {c}" for c in _FEATURES)
    return with_packets(f""", z AS (SELECT packet_id, {z} FROM packets), q AS (SELECT {q} FROM z)
SELECT packet_id, {s} FROM z, q""", flows=False).replace("\n,", ",", 1)


@plan("scaled_packets", _scaled_sql())
def scaled_packets(spark, sf):
    """M1: the detectors' prepared features of every packet."""
    p = packets(spark, sf, with_flow=False).select("packet_id", *_FEATURES)
    m = fit_prep(p, exclude=("packet_id",))
    at = {c: i for i, c in enumerate(m.columns)}
    f = m.transform(p, keep=("packet_id",))
    return rounded(f.select("packet_id", *[F.col("features")[at[c]].alias(c) for c in _FEATURES]))


def _voted(spark, sf):
    p = packets(spark, sf, with_flow=False)
    return p.withColumn("prediction", F.when((F.col("packet_size") > 120) | (F.col("dst_port") == 22), -1).otherwise(1))


_VOTE_SQL = "v AS (SELECT *, CASE WHEN packet_size > 120 OR dst_port = 22 THEN -1 ELSE 1 END AS prediction FROM packets)"


@plan("votes_per_hour", with_packets(f""",{_VOTE_SQL}
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) FILTER (prediction = -1) AS anomalous, count(*) FILTER (prediction = 1) AS normal
FROM v GROUP BY 1""", flows=False).replace("\n,", ",", 1))
def votes_per_hour(spark, sf):
    """A16 + J7 on a rule's votes beside the packets."""
    return series.anomalies_per_hour(_voted(spark, sf))


@plan("run_summary", with_packets(f""",{_VOTE_SQL}
SELECT dst_ip AS source_file, 'success' AS status, count(*) AS packets, count(*) FILTER (prediction = -1) AS anomalies,
       format('{{:.2f}}%', count(*) FILTER (prediction = -1) * 100.0::DOUBLE / count(*)) AS anomaly_rate FROM v GROUP BY dst_ip
UNION ALL SELECT DISTINCT 'lost-' || dst_ip, 'error', 0, 0, NULL FROM v""", flows=False).replace("\n,", ",", 1))
def run_summary(spark, sf):
    """A row per group, and one per group that failed to read."""
    v = _voted(spark, sf).withColumn("source_file", F.col("dst_ip"))
    lost = v.select(F.concat(F.lit("lost-"), "source_file").alias("source_file")).union(v.select("source_file")).distinct()
    return batch.run_summary(v, "source_file", lost)


@plan("result_documents", """
SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'of': {'region': n_regionkey}}) AS json FROM nation""")
def result_documents(spark, sf):
    """rows as JSON documents."""
    n = table(spark, sf, "nation")
    return results_json(n.select("n_nationkey", "n_name", F.struct(F.col("n_regionkey").alias("region")).alias("of")))


@plan("order_documents", """
SELECT to_json({'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'of': {'customer': o_custkey, 'status': o_orderstatus}}) AS json
FROM orders""")
def order_documents(spark, sf):
    """F30 over a table that grows: every order as a nested JSON document."""
    o = table(spark, sf, "orders")
    of = F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    return results_json(o.select("o_orderkey", "o_orderpriority", of.alias("of")))


@plan("euclidean_silhouette", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL),
d AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM e a, e b GROUP BY a.vec_id, a.label, b.label),
r AS (SELECT vec_id, own, max(n) FILTER (WHERE label = own) AS n, max(s / (n - 1)) FILTER (WHERE label = own AND n > 1) AS a,
             min(s / n) FILTER (WHERE label <> own) AS b FROM d GROUP BY vec_id, own)
SELECT vec_id, CAST(own AS BIGINT) AS label, round(a, 6) AS within, round(b, 6) AS nearest,
       round(CASE WHEN b IS NULL THEN NULL WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette
FROM r""")
def euclidean_silhouette(spark, sf):
    """The Euclidean silhouette of every embedding under its given label."""
    return rounded(cluster.silhouette_points(table(spark, sf, "embeddings"), "vec_id", "embedding", "label"))


@plan("label_silhouette", """
WITH e AS (SELECT label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
i AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM e),
a AS (SELECT label, k, avg(v) AS v FROM i GROUP BY label, k),
c AS (SELECT a.label, list(a.v ORDER BY k) AS m, any_value(s.n) AS n, any_value(s.p) AS p
      FROM a JOIN (SELECT label, count(*) AS n, avg(list_dot_product(x, x)) AS p FROM e GROUP BY label) s ON a.label = s.label GROUP BY a.label),
r AS (SELECT row_number() OVER () AS id, * FROM e),
d AS (SELECT r.id, r.label = c.label AS own, c.n, list_dot_product(r.x, r.x) + c.p - 2 * list_dot_product(r.x, c.m) AS d FROM r, c),
s AS (SELECT id, max(CASE WHEN own THEN n END) AS n, max(CASE WHEN own AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN NOT own THEN d END) AS b
      FROM d GROUP BY id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette FROM s""")
def label_silhouette(spark, sf):
    """Mean silhouette of the embeddings under their given labels."""
    e = table(spark, sf, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("c"))
    s = cluster.silhouette(cluster.assemble(e, array_col="x", standardize=False), pred="c")
    return rounded(spark.createDataFrame([(float(s),)], "silhouette double"))
