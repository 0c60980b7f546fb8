"""Sinks K1-K7: CSV and JSON writers, model persistence, report lines.

Reports are DataFrames of ``(line_no, line)`` built from the summary tables
(each a handful of rows), written as text; nothing is assembled from
collected data.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.functions.text import display_name

# Fixed report texts (K4, K5).
REPORT_TITLE = "NETWORK TRAFFIC ANALYSIS REPORT"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: table as CSV with a header, no index."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: results as JSON lines; nested results stay struct/map columns."""
    df.write.mode(mode).json(path)


def _lines(spark: SparkSession, section: int, texts: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(section, i, t) for i, t in enumerate(texts)], "section int, pos int, line string")


def text_report(spark: SparkSession, total_packets: DataFrame | None = None, feature_count: int | None = None,
                accuracy: str | None = None, anomalies: DataFrame | None = None,
                recommendations: DataFrame | None = None, max_recs: int = 10) -> DataFrame:
    """K4: plain-text report lines.  ``total_packets``: one row with column
    ``total_packets``; ``anomalies``: (model, total_anomalies);
    ``recommendations``: (rec_order, recommendation)."""
    parts = [_lines(spark, 0, [REPORT_TITLE, "=" * 40]),
             spark.range(1).select(F.lit(0).alias("section"), F.lit(2).alias("pos"),
                                   F.concat(F.lit("Generated: "),
                                            F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).alias("line")),
             _lines(spark, 0, ["", ""]).where("pos = 0").withColumn("pos", F.lit(3))]
    if total_packets is not None:
        parts.append(total_packets.select(F.posexplode(F.array(
            F.lit("PCAP ANALYSIS SUMMARY:"), F.format_string("Total Packets: %d", F.col("total_packets")),
            F.lit(f"Features: {feature_count if feature_count is not None else 'N/A'}"), F.lit(""))).alias("pos", "line"))
            .select(F.lit(1).alias("section"), F.col("pos").cast("int").alias("pos"), "line"))
    if accuracy:
        parts.append(_lines(spark, 2, ["MODEL PERFORMANCE:", f"Accuracy: {accuracy}", ""]))
    if anomalies is not None:
        body = anomalies.select(F.lit(3).alias("section"),
                                (F.lit(1) + F.row_number().over(Window.orderBy("model"))).alias("pos"),
                                F.format_string("  %s: %d anomalies", display_name("model"),
                                                F.col("total_anomalies")).alias("line"))
        parts += [_lines(spark, 3, ["ANOMALY DETECTION:"]), body,
                  _lines(spark, 3, [""]).withColumn("pos", F.lit(10_000))]
    if recommendations is not None:
        top = recommendations.orderBy("rec_order").limit(max_recs)
        body = top.select(F.lit(4).alias("section"),
                          F.row_number().over(Window.orderBy("rec_order", "recommendation")).alias("pos"),
                          F.col("recommendation"))
        body = body.select("section", "pos", F.format_string("  %d. %s", F.col("pos"), F.col("recommendation")).alias("line"))
        parts += [_lines(spark, 4, ["SECURITY RECOMMENDATIONS:"]), body,
                  _lines(spark, 4, [""]).withColumn("pos", F.lit(10_000))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.row_number().over(Window.orderBy("section", "pos")).alias("line_no"), "line")


def narrative(spark: SparkSession, alerts: DataFrame, protocols: DataFrame, dns: DataFrame, http: DataFrame,
              security: DataFrame, patterns: DataFrame, total_anomalies: DataFrame) -> DataFrame:
    """K5: one row per sentence of the report narrative (alerts: severity,
    title, details; protocols: protocol, count; dns: total_queries,
    unique_domains; http: total_requests, unique_hosts; security:
    suspicious_packets, high_risk_flows; patterns: pattern, count;
    total_anomalies: n)."""
    order = ["alert_order"] if "alert_order" in alerts.columns else ["severity", "title", "details"]
    a = alerts.orderBy(*order).limit(10)
    a = (a.withColumn("pos", F.row_number().over(Window.orderBy(*order)))           # ten rows at most
          .select(F.lit(1).alias("section"), "pos", F.format_string(
              "- [%s] %s: %s", F.upper("severity"), F.col("title"), F.col("details")).alias("line")))
    an = total_anomalies.select(F.lit(2).alias("section"), F.format_string(
        "Detected %d anomalous samples across available detectors.", F.col("n")).alias("line"))
    top5 = protocols.orderBy(F.desc("count"), "protocol").limit(5).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("count"), F.col("protocol"), F.col("count")))),
                                 lambda s: F.format_string("%s: %d", s["protocol"], s["count"])), ", ").alias("items"))
    pr = top5.select(F.lit(3).alias("section"), F.format_string("Top protocols by packet count: %s.", "items").alias("line"))
    d = dns.select(F.lit(4).alias("section"), F.format_string(
        "Observed %d DNS queries across %d unique domains.", "total_queries", "unique_domains").alias("line"))
    h = http.select(F.lit(5).alias("section"), F.format_string(
        "Captured %d HTTP requests to %d hosts.", "total_requests", "unique_hosts").alias("line"))
    s = security.select(F.lit(6).alias("section"), F.format_string(
        "Flagged %d suspicious packets and %d high-risk flows.", "suspicious_packets", "high_risk_flows").alias("line"))
    top_p = patterns.orderBy(F.desc("count"), "pattern").limit(5).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("count"), F.col("pattern"), F.col("count")))),
                                 lambda x: F.format_string("%s: %d", x["pattern"], x["count"])), ", ").alias("items"))
    p = top_p.where(F.col("items") != "").select(F.lit(7).alias("section"),
                                                F.format_string("Top detected attack patterns: %s.", "items").alias("line"))
    out = a
    for part in (an, pr, d, h, s, p):                       # one row each
        out = out.unionByName(part.withColumn("pos", F.lit(1)))
    return out.select(F.row_number().over(Window.orderBy("section", "pos")).alias("line_no"), "line")


def write_text(lines: DataFrame, path: str) -> None:
    """K4/K5: report lines as one text file (a report is a few dozen rows)."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


# ---- K3: detector persistence ---------------------------------------------------

def _put(spark: SparkSession, path: str, payload: dict) -> None:
    spark.createDataFrame([(json.dumps(payload),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def save_detector(model, path: str) -> None:
    """Config, prep (columns + scaler), isolation forest nodes, PCA and SVM weights as JSON; DBSCAN's
    core points and labels, which grow with the rows, as Parquet beside it."""
    spark = SparkSession.getActiveSession()
    meta = {"id_col": model.id_col, "prep": json.loads(model.prep.to_json()), "models": list(model.models),
            "config": dataclasses.asdict(model.config), "failures": model.failures}
    for name, m in model.models.items():
        if name == "isolation_forest":
            meta[name] = {"psi": m.psi, "threshold": m.threshold,
                          "nodes": m.nodes.to_dict(orient="list")}
        elif name == "autoencoder":
            meta[name] = {"mean": m.mean.tolist(), "components": m.components.tolist(), "threshold": m.threshold}
        elif name == "one_class_svm":
            meta[name] = {"W": m.W.tolist(), "b": m.b.tolist(), "w": m.w.tolist(), "rho": m.rho}
        elif name == "dbscan":
            meta[name] = {"eps": m.eps, "min_samples": m.min_samples, "dims": list(m.dims), "features": m.features}
            m.core.write.mode("overwrite").parquet(f"{path}-dbscan/core")
            m.labels.write.mode("overwrite").parquet(f"{path}-dbscan/labels")
        else:
            raise ValueError(f"no way to save the model {name!r}")
    _put(spark, path, meta)


def load_detector(path: str):
    from flowlake.operators.detect.dbscan import DbscanModel
    from flowlake.operators.detect.detector import DetectorModel, load_config
    from flowlake.operators.detect.iforest import IsolationForestModel
    from flowlake.operators.detect.ocsvm import OcsvmModel
    from flowlake.operators.detect.prep import PrepModel
    from flowlake.operators.detect.recon import ReconModel
    spark = SparkSession.getActiveSession()
    meta = _get(spark, path)
    dm = DetectorModel(meta["id_col"], PrepModel(**meta["prep"]), failures=meta["failures"], config=load_config(meta["config"]))
    if "dbscan" in meta:
        m = meta["dbscan"]
        dm.models["dbscan"] = DbscanModel(m["eps"], m["min_samples"], m["dims"], spark.read.parquet(f"{path}-dbscan/core"),
                                          spark.read.parquet(f"{path}-dbscan/labels"), m["features"])
    if "isolation_forest" in meta:
        m = meta["isolation_forest"]
        dm.models["isolation_forest"] = IsolationForestModel(pd.DataFrame(m["nodes"]), m["psi"], m["threshold"])
    if "autoencoder" in meta:
        m = meta["autoencoder"]
        dm.models["autoencoder"] = ReconModel(np.array(m["mean"]), np.array(m["components"]), m["threshold"])
    if "one_class_svm" in meta:
        m = meta["one_class_svm"]
        dm.models["one_class_svm"] = OcsvmModel(np.array(m["W"]), np.array(m["b"]), np.array(m["w"]), m["rho"])
    return dm


def results_json(df: DataFrame, out: str = "json") -> DataFrame:
    """each result row as one JSON document (nested structs, arrays and
    maps kept as JSON objects and lists)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(out))
