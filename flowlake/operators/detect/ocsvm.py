"""M3: one-class SVM with an RBF kernel, approximated for scale.

Random Fourier features (Rahimi and Recht, 2007) map x to
z = sqrt(2 / D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi), with
gamma = 1 / (d * variance of all entries) (the 'scale' rule).  The primal
objective 0.5 |w|^2 + mean(max(0, rho - w.z)) / nu - rho (Schoelkopf et
al., 2001) is minimised by full-batch subgradient steps: each step is one
pass in which every partition returns its violator count and the sum of
its violators' z (D + 1 numbers), so no row leaves its task.  rho is
finally set to the nu-quantile of w.z over all rows.  Approximate by design.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators.quantiles import quantile_values


@dataclass
class OcsvmModel:
    W: np.ndarray
    b: np.ndarray
    w: np.ndarray
    rho: float
    features: str = "features"

    def _z(self, X: np.ndarray) -> np.ndarray:
        D = self.W.shape[1]
        Z = X @ self.W
        Z += self.b
        np.cos(Z, out=Z)
        Z *= np.sqrt(2.0 / D)
        return Z

    def decision(self, df: DataFrame, keep: tuple = (), out: str = "ocsvm_score") -> DataFrame:
        model = self

        @F.pandas_udf(T.DoubleType())
        def f(s: pd.Series) -> pd.Series:
            if len(s) == 0:
                return pd.Series([], dtype="float64")
            X = np.stack(s.to_numpy()).astype("float64")
            return pd.Series(model._z(X) @ model.w - model.rho)
        return df.select(*keep, f(F.col(self.features)).alias(out))

    def predict(self, df: DataFrame, keep: tuple = (), out: str = "one_class_svm") -> DataFrame:
        d = self.decision(df, keep)
        return d.withColumn(out, F.when(F.col("ocsvm_score") < 0, -1).otherwise(1))


def fit_ocsvm(X: DataFrame, id_col: str, nu: float = 0.1, n_features: int = 128, steps: int = 30,
              seed: int = 42, tol: float = 2e-3, features: str = "features") -> OcsvmModel:
    row = X.select(features).first()
    if row is None:
        raise ValueError("empty input")
    d = len(row[0])
    cols = [f"f{i}" for i in range(d)]
    # one double column per feature: the columnar cache and Arrow move plain
    # columns far faster than an array column, and every step re-reads them
    data = X.select(*[F.col(features)[i].alias(c) for i, c in enumerate(cols)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        st = data.agg(F.sum(sum(F.col(c) for c in cols)).alias("s"),
                      F.sum(sum(F.col(c) * F.col(c) for c in cols)).alias("ss"),
                      F.count(F.lit(1)).alias("n")).first()
        n = st["n"]
        if not n:
            raise ValueError("empty input")
        m = n * d
        var = st["ss"] / m - (st["s"] / m) ** 2
        gamma = 1.0 / (d * var) if var > 0 else 1.0
        rng = np.random.default_rng(seed)
        W = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(d, n_features))
        b = rng.uniform(0.0, 2 * np.pi, size=n_features)
        model = OcsvmModel(W, b, np.zeros(n_features), 0.0, features)

        def pass_stats(w, rho, first=False):
            def run(batches):
                cnt, acc, zsum = 0, np.zeros(n_features), np.zeros(n_features)
                for pdf in batches:
                    if len(pdf):
                        Z = model._z(pdf[cols].to_numpy(dtype="float64"))
                        viol = Z @ w < rho
                        cnt += int(viol.sum())
                        acc += Z[viol].sum(axis=0)
                        if first:
                            zsum += Z.sum(axis=0)
                yield pd.DataFrame({"cnt": [cnt], "acc": [acc.tolist()], "zsum": [zsum.tolist()]})
            rows = data.mapInPandas(run, "cnt long, acc array<double>, zsum array<double>").collect()
            return (sum(r["cnt"] for r in rows), np.sum([r["acc"] for r in rows], axis=0),
                    np.sum([r["zsum"] for r in rows], axis=0))

        _, _, zsum = pass_stats(np.zeros(n_features), -1.0, first=True)
        w = zsum / n                       # start at the mean embedding
        rho = 0.0
        for t in range(steps):
            cnt, acc, _ = pass_stats(w, rho)
            eta = 1.0 / (t + 2)
            move = eta * (w - acc / (nu * n))
            w = w - move
            rho = rho - eta * (cnt / (nu * n) - 1.0)
            if np.linalg.norm(move) <= tol * np.linalg.norm(w):     # settled
                break
        model.w = w

        @F.pandas_udf(T.DoubleType())
        def score(*cs: pd.Series) -> pd.Series:
            Xb = np.column_stack([c.to_numpy(dtype="float64") for c in cs])
            return pd.Series(model._z(Xb) @ model.w)
        (q,) = quantile_values(data.select(score(*[F.col(c) for c in cols]).alias("__s")), "__s", [nu])
        model.rho = float(q)
        return model
    finally:
        data.unpersist()
