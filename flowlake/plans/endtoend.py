"""End-to-end pipelines: replay batches (W5, W6), the extractor registry
(X1), generic anomaly pipeline (M19), traffic-log forest (M13), sequence
reconstruction (M6), anomalies per hour (A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import batch, logfeatures, order, series, summary, supervised
from flowlake.operators.detect import recon
from flowlake.operators.detect.detector import AnomalyDetector, DetectorConfig
from flowlake.operators.detect.prep import fit_prep
from flowlake.plans.models import PACKET_FEATURES
from flowlake.plans.packets import packets, with_packets
from flowlake.plans.registry import plan, rounded, table
from flowlake.session import ensure_checkpoint_dir


@plan("replay_batches", with_packets("""
SELECT packet_id, CAST(floor((row_number() OVER (ORDER BY ts, packet_id) - 1) / 1000) AS BIGINT) AS batch_id
FROM packets""", flows=False))
def replay_batches(spark, sf):
    """Packets numbered into replay batches of 1,000 in time order
    (bucketed global row number, no single-task window)."""
    p = packets(spark, sf, with_flow=False).select("packet_id", "ts")
    return order.batch_numbers(p, ["ts", "packet_id"], size=1000).select("packet_id", "batch_id")


@plan("batch_heads", with_packets("""
SELECT batch_id, packet_id FROM (
  SELECT batch_id, packet_id, row_number() OVER (PARTITION BY batch_id ORDER BY ts, packet_id) AS rn FROM (
    SELECT packet_id, ts, CAST(floor((row_number() OVER (ORDER BY ts, packet_id) - 1) / 1000) AS BIGINT) AS batch_id
    FROM packets) b) h
WHERE rn <= 20""", flows=False))
def batch_heads(spark, sf):
    """The first 20 packets of every replay batch."""
    p = packets(spark, sf, with_flow=False).select("packet_id", "ts")
    b = order.batch_numbers(p, ["ts", "packet_id"], size=1000)
    return order.first_rows_per_batch(b, "batch_id", ["ts", "packet_id"], 20).select("batch_id", "packet_id")


@plan("capture_summary")
def capture_summary(spark, sf):
    """Every registered extractor over the packet view as long rows."""
    return rounded(summary.summarize(packets(spark, sf)))


@plan("generic_anomaly")
def generic_anomaly(spark, sf):
    """M19 on orders: dates to seconds, capped one-hot categories, forest of
    200 trees at contamination 0.05; summary with rate text and severity."""
    res = batch.generic_anomaly(table(spark, sf, "orders", spread_scan=True), "o_orderkey")
    return res["summary"]


@plan("log_model")
def log_model(spark, sf):
    """M13 + M12: traffic-log features, heuristic label, forest (70/30 by
    hash of the row number); importances with the test accuracy."""
    from flowlake.plans.analytics import _log
    ensure_checkpoint_dir(spark)
    lab = logfeatures.heuristic_label(logfeatures.log_features(_log(spark, sf)).checkpoint())     # joins and lag once, for two thresholds and the rows
    res = supervised.train_forest(lab, logfeatures.FEATURES, "label", "no", test_fraction=0.3, num_trees=100)
    return rounded(res["importances"].withColumn("accuracy", F.lit(float(res["accuracy"]))))


@plan("sequence_recon")
def sequence_recon(spark, sf):
    """M6: reconstruction error of 10-packet windows per user (flattened
    scaled features), flag at the window's last packet."""
    p = packets(spark, sf, with_flow=False, spread_scan=True).select("packet_id", "user_id", "ts", *PACKET_FEATURES)
    ensure_checkpoint_dir(spark)
    prep = fit_prep(p.drop("user_id"), exclude=("packet_id",))
    X = prep.transform(p, keep=("packet_id", "user_id", "ts"))
    seqs = recon.sequence_vectors(X, "user_id", ["ts", "packet_id"], k=10).select("packet_id", "seq_features").checkpoint()   # read by five passes
    model = recon.fit_recon(seqs, features="seq_features", keep=("packet_id",))
    return rounded(model.predict(seqs, keep=("packet_id",), out="sequence_autoencoder"))


@plan("anomalies_per_hour")
def anomalies_per_hour(spark, sf):
    """Isolation-forest anomalies and normal packets per hour of day."""
    p = packets(spark, sf, with_flow=False, spread_scan=True).select("packet_id", "ts", *PACKET_FEATURES)
    m = AnomalyDetector(DetectorConfig(models=("isolation_forest",))).fit(p.drop("ts"), "packet_id")
    X = m.prep.transform(p, keep=("packet_id", "ts"))          # the time goes along: no join back
    pred = m.models["isolation_forest"].predict(X, keep=("packet_id", "ts"), out="prediction")
    return series.anomalies_per_hour(pred, ts="ts", pred="prediction")
