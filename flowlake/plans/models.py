"""Model plans: detectors (M1-M5, M7-M11), DBSCAN (M4, A35), K-means and
PCA (M17, M18, A37), random forest (M12).  Learned models have no SQL twin
except DBSCAN, which DuckDB can state with a recursive CTE."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import cluster, ensemble, supervised
from flowlake.operators.detect import dbscan
from flowlake.operators.detect.detector import AnomalyDetector, DetectorConfig, surrogate_importance
from flowlake.plans.packets import packets
from flowlake.plans.registry import plan, rounded, table
from flowlake.session import ensure_checkpoint_dir

PACKET_FEATURES = ["packet_size", "ip_ttl", "tcp_window", "src_port", "dst_port", "tcp_flags"]


def _packet_table(spark, sf):
    return packets(spark, sf, with_flow=False, spread_scan=True).select("packet_id", *PACKET_FEATURES)


def _detector(spark, sf, models):
    p = _packet_table(spark, sf)
    return AnomalyDetector(DetectorConfig(models=models)).fit(p, "packet_id").complete(), p


@plan("isolation_forest")
def isolation_forest(spark, sf):
    """M1 + M2 on the packet features: prediction and score per packet."""
    m, p = _detector(spark, sf, ("isolation_forest",))
    f = m.features(p)
    return rounded(m.models["isolation_forest"].predict(f, keep=("packet_id",)))


@plan("one_class_svm")
def one_class_svm(spark, sf):
    """M3 on the packet features."""
    m, p = _detector(spark, sf, ("one_class_svm",))
    return rounded(m.models["one_class_svm"].predict(m.features(p), keep=("packet_id",)))


@plan("reconstruction_flags")
def reconstruction_flags(spark, sf):
    """M5: reconstruction error and flag per packet."""
    m, p = _detector(spark, sf, ("autoencoder",))
    return rounded(m.models["autoencoder"].predict(m.features(p), keep=("packet_id",)))


@plan("detector_ensemble")
def detector_ensemble(spark, sf):
    """M7 + M8 + M9: three detectors and the soft vote per packet."""
    m, p = _detector(spark, sf, ("isolation_forest", "one_class_svm", "autoencoder"))
    return m.transform(p)


@plan("detector_summary")
def detector_summary(spark, sf):
    """A26 + M11 summary of the detectors and the ensemble."""
    m, p = _detector(spark, sf, ("isolation_forest", "autoencoder"))
    scored = m.transform(p)
    return rounded(ensemble.model_summary(scored, m.model_names + ["ensemble"]))


@plan("surrogate_importance")
def surrogate_importance_plan(spark, sf):
    """Surrogate forest on the isolation forest's labels."""
    m, p = _detector(spark, sf, ("isolation_forest",))
    return rounded(surrogate_importance(m, p, num_trees=100, seed=42))


# ---- DBSCAN on the first three embedding dimensions ------------------------

DB_EPS, DB_MIN = 0.05, 5


def _emb3(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.array(*[F.col("embedding")[i].cast("double") for i in range(3)]).alias("features"))


def _dbscan(spark, sf):
    ensure_checkpoint_dir(spark)
    return dbscan.fit_dbscan(_emb3(spark, sf), "vec_id", DB_EPS, DB_MIN)


_DBSCAN_SQL = f"""
WITH RECURSIVE pts AS (
  SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
         CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
u AS (SELECT x, y, z, count(*) AS w, min(id) AS pid FROM pts GROUP BY x, y, z),
pairs AS (SELECT a.pid AS p, b.pid AS q, b.w AS qw FROM u a JOIN u b
          ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {DB_EPS * DB_EPS!r}),
core AS (SELECT p FROM pairs GROUP BY p HAVING sum(qw) >= {DB_MIN}),
ce AS (SELECT p, q FROM pairs WHERE p IN (SELECT p FROM core) AND q IN (SELECT p FROM core)),
cc(node, label) AS (SELECT p, p FROM core UNION SELECT ce.q, cc.label FROM cc JOIN ce ON cc.node = ce.p),
comp AS (SELECT node, min(label) AS label FROM cc GROUP BY node),
border AS (SELECT pairs.p, min(comp.label) AS bl FROM pairs JOIN comp ON pairs.q = comp.node GROUP BY pairs.p),
plabel AS (SELECT u.x, u.y, u.z, coalesce(comp.label, border.bl, -1) AS cluster
           FROM u LEFT JOIN comp ON u.pid = comp.node LEFT JOIN border ON u.pid = border.p)"""


@plan("dbscan_clusters", _DBSCAN_SQL + """
SELECT pts.id AS vec_id, CAST(plabel.cluster AS BIGINT) AS cluster
FROM pts JOIN plabel ON pts.x = plabel.x AND pts.y = plabel.y AND pts.z = plabel.z""")
def dbscan_clusters(spark, sf):
    """M4: cluster label per vector (smallest core id; noise -1)."""
    return _dbscan(spark, sf).labels.select(F.col("id").alias("vec_id"), F.col("cluster").cast("long"))


@plan("dbscan_cluster_sizes", _DBSCAN_SQL + """
SELECT CAST(plabel.cluster AS BIGINT) AS cluster, count(*) AS count
FROM pts JOIN plabel ON pts.x = plabel.x AND pts.y = plabel.y AND pts.z = plabel.z GROUP BY 1""")
def dbscan_cluster_sizes(spark, sf):
    """Cluster sizes, noise included as -1."""
    lab = _dbscan(spark, sf).labels
    return dbscan.cluster_sizes(lab.withColumn("cluster", F.col("cluster").cast("long")))


# ---- K-means, PCA, silhouette on embeddings ----------------------------------


def _emb(spark, sf):
    return cluster.assemble(table(spark, sf, "embeddings"), array_col="embedding")


@plan("kmeans_clusters")
def kmeans_clusters(spark, sf):
    """M17 + A35: K-means (k=5, seed 42) cluster sizes and the silhouette."""
    _, out = cluster.kmeans(_emb(spark, sf), k=5, seed=42)
    sil = cluster.silhouette(out)
    return rounded(cluster.cluster_sizes(out, "kmeans_cluster").withColumn("silhouette", F.lit(sil)))


@plan("pca_projection")
def pca_projection(spark, sf):
    """Two principal components per vector."""
    return rounded(cluster.pca2(_emb(spark, sf)).select("vec_id", "pca1", "pca2"))


# ---- random forest on documents with labels -----------------------------------


@plan("random_forest")
def random_forest(spark, sf):
    """Forest predicting quality from document columns (70/30 by hash of
    doc_id); importances with the test accuracy."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    data = d.join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    res = supervised.train_forest(data, ["lang", "source", "n_chars", "toxic"], "quality", "doc_id",
                                  test_fraction=0.3, num_trees=100, seed=42)
    return rounded(res["importances"].withColumn("accuracy", F.lit(float(res["accuracy"]))))


# ---- batch over groups (M20, A38) ----------------------------------------------


@plan("per_group_forest")
def per_group_forest(spark, sf):
    """M20 + A38: one isolation forest per event type (the group stands in
    for a capture file), trained in one job; per-group run summary."""
    from flowlake.operators.batch import fit_per_group, run_summary
    from flowlake.operators.detect.prep import fit_prep
    p = packets(spark, sf, with_flow=False, spread_scan=True).select("packet_id", "event_type", *PACKET_FEATURES)
    prep = fit_prep(p, exclude=("packet_id",))
    X = prep.transform(p, keep=("packet_id", "event_type"))
    pred = fit_per_group(X, "event_type", "packet_id", n_trees=100, contamination=0.1, seed=42)
    return run_summary(pred, group="event_type")


@plan("per_group_detectors")
def per_group_detectors(spark, sf):
    """M20 + A38: forest, SVM, DBSCAN and reconstruction for each event type (the group stands in for a
    capture file), each on its own scaling; anomalies of every model and of the vote per group."""
    from flowlake.operators.detect.grouped import fit_detectors_per_group
    p = packets(spark, sf, with_flow=False, spread_scan=True).select("packet_id", "event_type", *PACKET_FEATURES)
    votes = fit_detectors_per_group(p, "event_type", "packet_id", PACKET_FEATURES)
    names = ["isolation_forest", "one_class_svm", "dbscan", "autoencoder", "ensemble"]
    return votes.groupBy("event_type").agg(F.count(F.lit(1)).alias("packets"), *[F.count_if(F.col(m) == -1).alias(m) for m in names])


# ---- DBSCAN on every embedding column ---------------------------------------

ALL_EPS, ALL_MIN = 1.18, 4


@plan("dbscan_all_columns", f"""
WITH RECURSIVE pts AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
u AS (SELECT x, count(*) AS w, min(id) AS pid FROM pts GROUP BY x),
pairs AS (SELECT a.pid AS p, b.pid AS q, b.w AS qw FROM u a JOIN u b
          ON list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) <= {ALL_EPS * ALL_EPS!r}),
core AS (SELECT p FROM pairs GROUP BY p HAVING sum(qw) >= {ALL_MIN}),
ce AS (SELECT p, q FROM pairs WHERE p IN (SELECT p FROM core) AND q IN (SELECT p FROM core)),
cc(node, label) AS (SELECT p, p FROM core UNION SELECT ce.q, cc.label FROM cc JOIN ce ON cc.node = ce.p),
comp AS (SELECT node, min(label) AS label FROM cc GROUP BY node),
border AS (SELECT pairs.p, min(comp.label) AS bl FROM pairs JOIN comp ON pairs.q = comp.node GROUP BY pairs.p),
plabel AS (SELECT u.x, coalesce(comp.label, border.bl, -1) AS cluster
           FROM u LEFT JOIN comp ON u.pid = comp.node LEFT JOIN border ON u.pid = border.p)
SELECT pts.id AS vec_id, CAST(plabel.cluster AS BIGINT) AS cluster FROM pts JOIN plabel ON pts.x = plabel.x""")
def dbscan_all_columns(spark, sf):
    """M4 over all embedding columns."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    return dbscan.fit_dbscan(e, "vec_id", ALL_EPS, ALL_MIN).labels.select(F.col("id").alias("vec_id"), F.col("cluster").cast("long"))
