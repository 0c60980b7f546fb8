"""Training rows are dealt over the cores, and inputs that several passes read are made once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators import supervised
from flowlake.operators.detect import detector, iforest
from flowlake.operators.detect.detector import AnomalyDetector, DetectorConfig


def test_training_rows_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(supervised, "FEW_ROWS", 100)
    monkeypatch.setattr(supervised, "MOST_ROWS", 300)
    df = spark.range(3000).coalesce(1)
    made = supervised.spread_rows(df, "id", 3000, 1)
    sizes = made.groupBy(F.spark_partition_id()).count().collect()
    assert made.rdd.getNumPartitions() == 10 and sum(r["count"] for r in sizes) == 3000
    assert supervised.spread_rows(df, "id", 90, 1) is df and supervised.spread_rows(df, "id", 3000, 10) is df


def test_forest_trains_on_more_than_one_partition(spark, monkeypatch):
    monkeypatch.setattr(supervised, "FEW_ROWS", 50)
    seen, deal = [], supervised.spread_rows
    monkeypatch.setattr(supervised, "spread_rows", lambda *a: (seen.append(deal(*a)), seen[-1])[1])
    df = spark.range(400).coalesce(1).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    res = supervised.train_forest(df, ["x"], "y", "id", num_trees=5, max_depth=4)
    assert seen[0].rdd.getNumPartitions() == 4 and res["accuracy"] == 1.0


def test_surrogate_rows_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(supervised, "MOST_ROWS", 100)
    seen, deal = [], supervised.spread_rows
    monkeypatch.setattr(detector, "spread_rows", lambda *a: (seen.append(deal(*a)), seen[-1])[1])
    df = spark.range(1000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).checkpoint()
    m = AnomalyDetector(DetectorConfig(models=("isolation_forest",))).fit(df, "id")
    assert detector.surrogate_importance(m, df, num_trees=3).count() == 2 and seen[0].rdd.getNumPartitions() == 10


def test_trainers_share_the_kept_features(spark, monkeypatch):
    from flowlake.operators.detect import iforest as module
    seen, fit = [], module.fit_iforest
    monkeypatch.setattr(module, "fit_iforest", lambda X, *a: (seen.append(X.storageLevel.useMemory), fit(X, *a))[1])
    df = spark.range(300).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).checkpoint()
    m = AnomalyDetector(DetectorConfig(models=("isolation_forest",))).fit(df, "id")
    assert seen == [True] and m.model_names == ["isolation_forest"]


def test_tree_walk_follows_the_nodes(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    x[5, 1] = np.nan
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    model = iforest.fit_iforest(df.where("id <> 5"), "id", n_trees=7, max_samples=64)
    got = dict(model.score(df, keep=("id",)).collect())
    c = float(iforest.avg_path([model.psi])[0])
    for i in (0, 5, 77, 299):
        height = []
        for _, t in model.nodes.groupby("tree"):
            t, n = t.set_index("node"), 0
            while t.loc[n, "feature"] >= 0:
                n = int(t.loc[n, "left" if x[i][int(t.loc[n, "feature"])] < t.loc[n, "split"] else "right"])
            height.append(t.loc[n, "depth"] + iforest.avg_path([t.loc[n, "size"]])[0])
        assert got[i] == pytest.approx(2.0 ** (-np.mean(height) / c))
