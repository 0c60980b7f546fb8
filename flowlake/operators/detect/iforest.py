"""M2: Isolation Forest (Liu, Ting, Zhou, ICDM 2008) as Spark jobs.

* Sampling: tree t takes the psi = min(256, n) rows with the smallest
  ``xxhash64(seed, t, row_id)``.  One pass keeps (tree, row) pairs whose
  hash is under a generous threshold (about 4 psi per tree), then a window
  per tree keeps the psi smallest.  Deterministic by seed and row id,
  independent of partitioning.
* Building: ``groupBy(tree).applyInPandas`` grows each tree from its psi
  rows (random feature, uniform split, depth limit ceil(log2 psi)).
* Scoring: at most trees x (2 psi - 1) node rows are gathered once and
  shipped with the task closure; ``mapInPandas`` walks all trees with NumPy.
* Threshold: exact quantile of the normality score (-s) at the
  contamination; a row is -1 when strictly below it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators.quantiles import quantile_values

EULER = 0.5772156649015329


def avg_path(n) -> np.ndarray:
    """c(n): mean path length of an unsuccessful search in a BST of n keys."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


NODE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("tree", T.IntegerType()), ("node", T.IntegerType()), ("feature", T.IntegerType()),
    ("split", T.DoubleType()), ("left", T.IntegerType()), ("right", T.IntegerType()),
    ("size", T.LongType()), ("depth", T.IntegerType())]])


def _grow(X: np.ndarray, rng: np.random.Generator, max_depth: int) -> list:
    nodes: list = []
    stack = [(np.arange(len(X)), 0, -1, 0)]  # (rows, depth, parent, side)
    while stack:
        idx, depth, parent, side = stack.pop()
        nid = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx), depth])
        if parent >= 0:
            nodes[parent][2 + side] = nid
        if depth >= max_depth or len(idx) <= 1:
            continue
        Xi = X[idx]
        lo, hi = Xi.min(axis=0), Xi.max(axis=0)
        cand = np.nonzero(hi > lo)[0]
        if len(cand) == 0:
            continue
        f = int(rng.choice(cand))
        s = float(rng.uniform(lo[f], hi[f]))
        go_left = Xi[:, f] < s
        nodes[nid][0], nodes[nid][1] = f, s
        stack.append((idx[~go_left], depth + 1, nid, 1))
        stack.append((idx[go_left], depth + 1, nid, 0))
    return nodes


def _builder(seed: int, max_depth: int, feat: str):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        X = np.stack(pdf[feat].to_numpy()).astype("float64")
        rng = np.random.default_rng([seed, tree])
        nodes = _grow(X, rng, max_depth)
        arr = np.array(nodes, dtype=object)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(nodes), dtype="int32"),
                             "feature": arr[:, 0].astype("int32"), "split": arr[:, 1].astype("float64"),
                             "left": arr[:, 2].astype("int32"), "right": arr[:, 3].astype("int32"),
                             "size": arr[:, 4].astype("int64"), "depth": arr[:, 5].astype("int32")})
    return build


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame           # one row per node (small: trees x (2 psi - 1) at most)
    psi: int
    threshold: float | None = None   # on the normality score -s
    features: str = "features"

    def _packed(self):
        packs = []
        for _, g in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            leaf_h = g["depth"].to_numpy() + avg_path(g["size"].to_numpy())
            left, right, inner = g["left"].to_numpy(), g["right"].to_numpy(), g["feature"].to_numpy() >= 0
            at, kids = np.zeros(len(g), dtype="int64"), np.flatnonzero(inner)       # siblings side by side
            at[left[kids]], at[right[kids]] = 2 * np.arange(len(kids)) + 1, 2 * np.arange(len(kids)) + 2
            fe, sp, kid, lh = np.zeros(len(g), dtype="int64"), np.full(len(g), np.nan), np.arange(len(g)), np.empty(len(g))
            fe[at[kids]], sp[at[kids]], kid[at[kids]] = g["feature"].to_numpy()[kids], g["split"].to_numpy()[kids], at[left[kids]]
            lh[at] = leaf_h
            packs.append((fe, sp, kid, lh))         # a leaf's split is no number: nothing is beyond it, it leads to itself
        return packs, float(avg_path([self.psi])[0]), int(self.nodes["depth"].max())

    def score(self, df: DataFrame, keep: tuple = (), out: str = "iforest_score") -> DataFrame:
        """Anomaly score s = 2^(-E[h] / c(psi)) per row (higher = more anomalous)."""
        packs, cpsi, steps = self._packed()
        feat = self.features
        keep = list(keep)

        def run(batches):
            for pdf in batches:
                X = np.stack(pdf[feat].to_numpy()).astype("float64") if len(pdf) else np.zeros((0, 1))
                m = len(pdf)
                total = np.zeros(m)
                X = np.where(np.isnan(X), np.inf, X)        # on the right of every split, as no number is
                rows, flat = np.arange(m) * X.shape[1], X.ravel()
                for fe, sp, kid, lh in packs:
                    node = np.zeros(m, dtype="int64")
                    for _ in range(steps):
                        right = flat.take(rows + fe.take(node)) >= sp.take(node)
                        node = kid.take(node) + right
                    total += lh.take(node)
                s = np.power(2.0, -(total / len(packs)) / cpsi) if cpsi > 0 else np.full(m, 0.5)
                res = pdf[keep].copy()
                res[out] = s
                yield res

        schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(out, T.DoubleType())])
        cols = keep + ([feat] if feat not in keep else [])
        return df.select(*cols).mapInPandas(run, schema)

    def predict(self, df: DataFrame, keep: tuple = (), out: str = "isolation_forest") -> DataFrame:
        scored = self.score(df, keep)
        return scored.withColumn(out, F.when(-F.col("iforest_score") < F.lit(self.threshold), -1).otherwise(1))



def fit_iforest(df: DataFrame, id_col: str, n_trees: int = 100, max_samples: int = 256,
                contamination: float = 0.1, seed: int = 42, features: str = "features") -> IsolationForestModel:
    n = df.count()
    psi = int(min(max_samples, n))
    if psi < 1:
        raise ValueError("empty input")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    thr = min(1.0, 4.0 * psi / n + 1e-12) if n > 0 else 1.0

    def u(t):
        h = F.xxhash64(F.lit(seed), t, F.col(id_col))
        return (h.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).cast("double") / F.lit(float(2 ** 63)))

    cand = df.select(F.col(id_col), features, F.explode(
        F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: u(t) < F.lit(thr))).alias("tree"))
    cand = cand.withColumn("__u", u(F.col("tree")))
    w = Window.partitionBy("tree").orderBy("__u", id_col)
    sample = cand.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= psi)
    nodes = (sample.select("tree", features).groupBy("tree")
                   .applyInPandas(_builder(seed, max_depth, features), NODE_SCHEMA)).toPandas()
    model = IsolationForestModel(nodes, psi, None, features)
    scored = model.score(df, keep=(id_col,))
    (thr_v,) = quantile_values(scored.select((-F.col("iforest_score")).alias("ns")), "ns", [contamination])
    model.threshold = float(thr_v)
    return model
