"""Batch analysis over many captures (M20, A38) and the generic anomaly
pipeline (M19).

``fit_per_group`` trains one isolation forest per group (e.g. per capture
file) in a single job; ``detect.grouped`` trains every detector so.  Rows are
scored where they meet their group's trees, so the number of groups has no limit, and
a group above ``rows_per_task`` rows is dealt to several tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators.detect.detector import IForestConfig
from flowlake.operators.detect.grouped import grown_forests, walk
from flowlake.operators.quantiles import exact_quantiles


def fit_per_group(X: DataFrame, group: str, id_col: str, n_trees: int = 100, max_samples: int = 256,
                  contamination: float = 0.1, seed: int = 42, features: str = "features",
                  rows_per_task: int = 20_000) -> DataFrame:
    """M20, the forest alone, on features that are prepared already; returns (group, id, score, prediction).
    ``grouped.fit_detectors_per_group`` prepares each group and has all detectors."""
    row = X.select(features).first()
    if row is None:
        raise ValueError("empty input")
    cols = [f"x{i}" for i in range(len(row[0]))]
    cfg = IForestConfig(n_trees, max_samples, contamination, seed)
    sizes = X.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__g", F.monotonically_increasing_id()).checkpoint()
    parts = F.ceil(F.col("__n") / rows_per_task).cast("int")
    rows = X.select(group, id_col, *[F.col(features)[i].cast("double").alias(c) for i, c in enumerate(cols)]).join(sizes, group) \
        .withColumn("__part", F.pmod(F.xxhash64(id_col), parts).cast("int")).checkpoint()
    models = sizes.select("__g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part")).join(grown_forests(rows, cols, id_col, cfg), "__g")

    def score(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"__g": [], id_col: [], "score": []})
        return pd.DataFrame({"__g": pdf["__g"], id_col: pdf[id_col], "score": walk(pdf[cols].to_numpy(dtype="float64"), model["forest"].iloc[0])})
    models = models.withColumnsRenamed({"__g": "__mg", "__part": "__mpart"})
    scored = rows.groupBy("__g", "__part").cogroup(models.groupBy("__mg", "__mpart")).applyInPandas(
        score, f"__g long, `{id_col}` {X.schema[id_col].dataType.simpleString()}, score double").checkpoint()
    thr = exact_quantiles(scored.withColumn("ns", -F.col("score")), "ns", [contamination], by=["__g"], names=["thr"])
    return (scored.join(thr, "__g").join(sizes.select("__g", group), "__g")
                  .select(group, id_col, "score", F.when(-F.col("score") < F.col("thr"), -1).otherwise(1).alias("prediction")))


def run_summary(predictions: DataFrame, group: str = "source_file", failures: DataFrame | None = None) -> DataFrame:
    """Per group: status, packets, anomalies, rate text; failed groups
    (from the reader's side table) get status 'error'."""
    ok = predictions.groupBy(group).agg(F.count(F.lit(1)).alias("packets"),
                                        F.count_if(F.col("prediction") == -1).alias("anomalies"))
    ok = ok.select(group, F.lit("success").alias("status"), "packets", "anomalies",
                   F.format_string("%.2f%%", F.col("anomalies") * 100.0 / F.col("packets")).alias("anomaly_rate"))
    if failures is None:
        return ok
    bad = failures.join(ok.select(group), group, "left_anti").select(
        group, F.lit("error").alias("status"), F.lit(0).cast("long").alias("packets"),
        F.lit(0).cast("long").alias("anomalies"), F.lit(None).cast("string").alias("anomaly_rate"))
    return ok.unionByName(bad)


def generic_features(df: DataFrame, id_col: str, top: int = 50) -> DataFrame:
    """M19 features: timestamps to epoch seconds (F10), text columns capped
    at ``top`` levels (A24) and one-hot encoded with the first level dropped
    (F13), other columns coerced to numbers (P4), missing / inf -> 0 (P5).
    Returns (id, features array) and the feature names."""
    from flowlake.functions.time import timestamp_to_epoch
    from flowlake.operators.encode import cap_categories, clean_number, levels_of, to_number
    out = df
    cols = []
    for f in df.schema.fields:
        if f.name == id_col:
            continue
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out = out.withColumn(f.name, F.floor(timestamp_to_epoch(F.col(f.name).cast("timestamp"))))
            cols.append((f.name, [f.name]))
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            out = cap_categories(out, f.name, top=top)
            lv = levels_of(out, f.name)[1:]   # at most top + 1 levels; first dropped
            names = [f"{f.name}_{v}" for v in lv]
            out = out.withColumns({n: (F.col(f.name) == F.lit(v)).cast("double") for n, v in zip(names, lv)})
            cols.append((f.name, names))
        else:
            cols.append((f.name, [f.name]))
    names = [n for _, ns in cols for n in ns]
    feats = F.array(*[clean_number(to_number(F.col(f"`{n}`"))) for n in names])
    return out.select(F.col(id_col), feats.alias("features")), names


def generic_anomaly(df: DataFrame, id_col: str, n_trees: int = 200, contamination: float = 0.05,
                    seed: int = 42) -> dict:
    """Generic table -> isolation forest -> summary row and alert row
    (F16 rate text, F17 severity: medium under 50 anomalies, else high)."""
    from flowlake.operators.detect.iforest import fit_iforest
    X, names = generic_features(df, id_col)
    if len(names) < 2:
        raise ValueError("not enough features for anomaly detection")
    model = fit_iforest(X, id_col, n_trees=n_trees, contamination=contamination, seed=seed)
    pred = model.predict(X, keep=(id_col,))
    summ = pred.agg(F.count_if(F.col("isolation_forest") == -1).alias("anomalies"),
                    F.count(F.lit(1)).alias("rows"))
    summ = summ.select(F.lit("IsolationForest").alias("model"), "anomalies", "rows",
                       F.format_string("%.2f%%", F.col("anomalies") * 100.0 / F.col("rows")).alias("anomaly_rate"),
                       F.when(F.col("anomalies") < 50, "medium").otherwise("high").alias("severity"))
    return {"model": model, "predictions": pred, "summary": summ, "features": names}
