"""M5 / M6: reconstruction-error detectors.

The best linear autoencoder of code size k spans the top-k principal
subspace (Baldi and Hornik, 1989), so the dense autoencoder is re-aimed as
PCA: MLlib fits the components (a d x d covariance aggregated by tree
reduce), each row's error is the mean squared residual after projecting
its centred vector, and the threshold is the exact 95th percentile of the
errors; errors strictly above it are anomalies.  k = min(32, ceil(d / 2)),
since a code as wide as the input would reconstruct it exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators.quantiles import quantile_values


@dataclass
class ReconModel:
    mean: np.ndarray
    components: np.ndarray      # d x k
    threshold: float | None = None
    features: str = "features"

    def errors(self, df: DataFrame, keep: tuple = (), out: str = "recon_error") -> DataFrame:
        mean, P = self.mean, self.components
        feat = self.features

        @F.pandas_udf(T.DoubleType())
        def err(s: pd.Series) -> pd.Series:
            if len(s) == 0:
                return pd.Series([], dtype="float64")
            X = np.stack(s.to_numpy()).astype("float64") - mean
            R = X - (X @ P) @ P.T
            return pd.Series(np.mean(R * R, axis=1))
        return df.select(*keep, err(F.col(feat)).alias(out))

    def per_feature_error(self, df: DataFrame) -> np.ndarray:
        """Share of the total squared error carried by each feature."""
        mean, P, feat = self.mean, self.components, self.features
        d = len(mean)

        def run(batches):
            acc = np.zeros(d)
            for pdf in batches:
                if len(pdf):
                    X = np.stack(pdf[feat].to_numpy()).astype("float64") - mean
                    R = X - (X @ P) @ P.T
                    acc += (R * R).sum(axis=0)
            yield pd.DataFrame({"i": np.arange(d), "e": acc})
        part = df.select(feat).mapInPandas(run, "i long, e double").groupBy("i").agg(F.sum("e").alias("e"))
        tot = np.zeros(d)
        for r in part.collect():  # d rows
            tot[r["i"]] = r["e"]
        s = tot.sum()
        return tot / s if s > 0 else tot

    def predict(self, df: DataFrame, keep: tuple = (), out: str = "autoencoder") -> DataFrame:
        e = self.errors(df, keep)
        return e.withColumn(out, F.when(F.col("recon_error") > F.lit(self.threshold), -1).otherwise(1))


def fit_recon(df: DataFrame, features: str = "features", code_size: int = 32, percentile: float = 95.0,
              keep: tuple = ()) -> ReconModel:
    row = df.select(features).first()
    if row is None:
        raise ValueError("empty input")
    d = len(row[0])
    k = max(1, min(code_size, math.ceil(d / 2), d))
    vec = df.select(array_to_vector(F.col(features)).alias("__v"))
    pca = PCA(k=k, inputCol="__v", outputCol="__p").fit(vec)
    mean = np.asarray(vec.select(Summarizer.mean(F.col("__v")).alias("m")).first()["m"].toArray())
    comps = pca.pc.toArray()
    model = ReconModel(mean, comps, None, features)
    errs = model.errors(df, keep)
    (t,) = quantile_values(errs, "recon_error", [percentile / 100.0])
    model.threshold = float(t)
    return model


def sequence_vectors(df: DataFrame, key: str, order_cols, features: str = "features", k: int = 10,
                     out: str = "seq_features", hot_rows: int = 1_000_000) -> DataFrame:
    """M6 input: the k-row window ending at each row, flattened (full windows
    only).  Built by ``order.sequences``, which splits hot keys."""
    from flowlake.operators.order import sequences
    s = sequences(df, key, order_cols, features, k=k, out="__win", hot_rows=hot_rows)
    return s.withColumn(out, F.flatten("__win")).drop("__win")
