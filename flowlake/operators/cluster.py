"""Clustering and projection: K-means (M17), PCA to 2 components (M18),
cluster sizes (A35), silhouette (A37: squared Euclidean by MLlib, Euclidean by
blocks)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, cols: Sequence[str] | None = None, array_col: str | None = None,
             standardize: bool = True, out: str = "fv") -> DataFrame:
    """Vector column from numeric columns or an array column; optional
    standard scaling (mean 0, population-free unit variance)."""
    if array_col:
        v = df.withColumn("__raw", array_to_vector(F.col(array_col)))
    else:
        v = VectorAssembler(inputCols=list(cols), outputCol="__raw", handleInvalid="keep").transform(df)
    if standardize:
        return StandardScaler(inputCol="__raw", outputCol=out, withMean=True, withStd=True).fit(v).transform(v).drop("__raw")
    return v.withColumnRenamed("__raw", out)


def kmeans(df: DataFrame, k: int = 5, seed: int = 42, features: str = "fv", out: str = "kmeans_cluster") -> tuple:
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol=out).fit(df)
    return model, model.transform(df)


def pca2(df: DataFrame, features: str = "fv", k: int = 2) -> DataFrame:
    model = PCA(k=k, inputCol=features, outputCol="__pca").fit(df)
    out = model.transform(df).withColumn("__arr", vector_to_array(F.col("__pca")))
    return out.select("*", *[F.col("__arr")[i].alias(f"pca{i + 1}") for i in range(k)]).drop("__pca", "__arr")


def cluster_sizes(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def silhouette(df: DataFrame, features: str = "fv", pred: str = "kmeans_cluster") -> float:
    return ClusteringEvaluator(featuresCol=features, predictionCol=pred, metricName="silhouette",
                               distanceMeasure="squaredEuclidean").evaluate(df)


_NEAR = 1e-6  # of the squared lengths: below it a distance is taken from the differences, as the products cancel


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` to all rows of ``y``."""
    scale = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    sq = scale - 2.0 * (x @ y.T)
    i, j = np.nonzero(sq <= _NEAR * scale)
    for a in range(0, len(i), 8192):
        part = x[i[a:a + 8192]] - y[j[a:a + 8192]]
        sq[i[a:a + 8192], j[a:a + 8192]] = (part * part).sum(1)
    return np.sqrt(sq)


TILE, BLOCKS, LARGEST = 1024, 16, 65_536    # rows of a matrix held at a time; blocks of a table that is large enough; rows of a block
ENTRIES = 1 << 21                           # sums of a block: rows times clusters


def _sums(ids, own, total: np.ndarray, names: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """A row for each id and cluster of the other block: the distances' sum and count."""
    k = len(names)
    return pd.DataFrame({"__id": np.repeat(ids, k), "__own": np.repeat(own, k), "__other": np.tile(names, len(ids)),
                         "__sum": total.ravel(), "__n": np.tile(n, len(ids))})


def _block_pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Distance sums per row and cluster, both ways; the rows are sorted by cluster and the distances taken in tiles."""
    sides = []
    for pdf in (left, right):
        pdf = pdf.sort_values("__own", kind="stable")
        x, own = np.stack(pdf["__x"].tolist()), pdf["__own"].to_numpy()
        names, code, n = np.unique(own, return_inverse=True, return_counts=True)
        sides.append((pdf["__id"].to_numpy(), own, x, names, code, n.astype("int64")))
    (ids, own, x, names, code, n), (ids2, own2, y, names2, code2, n2) = sides
    same = left["__b"].iat[0] == right["__b"].iat[0]
    total, back = np.zeros((len(x), len(names2))), None if same else np.zeros((len(y), len(names)))

    def add(to, d, codes):              # columns of d by cluster
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        to[:, codes[first]] += np.add.reduceat(d, first, axis=1)
    for i in range(0, len(x), TILE):
        for j in range(0, len(y), TILE):
            d = _distances(x[i:i + TILE], y[j:j + TILE])
            add(total[i:i + TILE], d, code2[j:j + TILE])
            if not same:
                add(back[j:j + TILE], d.T, code[i:i + TILE])
    out = _sums(ids, own, total, names2, n2)
    return out if same else pd.concat([out, _sums(ids2, own2, back, names, n)], ignore_index=True)


def silhouette_points(df: DataFrame, id_col: str, x: str, pred: str, block_rows: int | None = None) -> DataFrame:
    """Exact Euclidean silhouette of every row: (``id_col``, ``pred``, within, nearest, silhouette).

    ``id_col`` holds unique whole numbers, ``pred`` whole-number clusters, ``x`` arrays of one length without nulls;
    rows that lack any of them are left out.  Rows are dealt by a hash of their id to ``BLOCKS`` blocks, or more where one
    would hold over ``LARGEST`` rows, or over ``ENTRIES`` rows times clusters (``block_rows`` fixes the size);
    a task takes a pair of blocks, each pair once, and gives distance sums per row and cluster, never pairs of rows.
    A mean of distances has no shorter form, so the work is the square of the rows; the shuffle is the rows times the
    blocks, in proportion to the rows up to ``BLOCKS * LARGEST``.  ``silhouette`` costs one pass.  A row alone in its cluster has 0, as have rows whose distances
    are all 0; with one cluster ``nearest`` and ``silhouette`` are null."""
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(pred).cast("long").alias("__own"),
                     F.col(x).cast("array<double>").alias("__x")).dropna()
    if block_rows is None:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("__own").alias("k")).first()
        most = min(LARGEST, max(TILE, ENTRIES // max(1, size["k"])))
        block_rows, n = max(TILE, min(most, -(-size["n"] // BLOCKS))), size["n"]
    else:
        n = rows.count()
    blocks = max(1, -(-n // block_rows))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int"))
    left = rows.withColumn("__c", F.explode(F.sequence(F.col("__b"), F.lit(blocks - 1)))).withColumn("__a", F.col("__b"))
    right = rows.withColumn("__a", F.explode(F.sequence(F.lit(0), F.col("__b")))).withColumn("__c", F.col("__b"))
    sums = left.groupBy("__a", "__c").cogroup(right.groupBy("__a", "__c")).applyInPandas(
        lambda a, b: _block_pair(a, b) if len(a) and len(b) else pd.DataFrame(columns=["__id", "__own", "__other", "__sum", "__n"]),
        "__id long, __own long, __other long, __sum double, __n long")
    per = sums.groupBy("__id", "__own", "__other").agg(F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))
    mine = F.col("__own") == F.col("__other")
    per = per.groupBy("__id", "__own").agg(
        F.max(F.when(mine, F.col("__n"))).alias("__n"),
        F.max(F.when(mine & (F.col("__n") > 1), F.col("__sum") / (F.col("__n") - 1))).alias("within"),
        F.min(F.when(~mine, F.col("__sum") / F.col("__n"))).alias("nearest"))
    most = F.greatest("within", "nearest")
    value = (F.when(F.col("nearest").isNull(), F.lit(None).cast("double")).when((F.col("__n") == 1) | (most == 0), 0.0)
              .otherwise((F.col("nearest") - F.col("within")) / most))
    return per.select(F.col("__id").alias(id_col), F.col("__own").alias(pred), "within", "nearest", value.alias("silhouette"))
