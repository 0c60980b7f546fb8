"""Detectors per group equal those fitted on each group alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators.detect import dbscan, iforest, ocsvm, recon
from flowlake.operators.detect.detector import DetectorConfig, IForestConfig
from flowlake.operators.detect.grouped import fit_detectors_per_group, prepare

CFG = DetectorConfig(isolation_forest=IForestConfig(n_trees=20, max_samples=64))
NAMES = ["isolation_forest", "one_class_svm", "dbscan", "autoencoder"]
COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        g = "hot" if i % 3 else ("u" if i % 2 else "v")
        x = rng.normal(0, 1 if g == "hot" else 3, 3) + (i % 50 == 0) * 9
        rows.append((i, g, float(x[0]), float(x[1]), 7.0 if g == "u" else float(x[2])))      # c doesn't vary in u
    rows += [(2000, None, 1.0, 1.0, 1.0), (2001, "one", None, float("nan"), float("inf"))]
    return spark.createDataFrame(rows, "id long, g string, a double, b double, c double").withColumn("ensemble", F.lit("x"))


def test_equal_to_each_group_alone(spark, table):
    out = fit_detectors_per_group(table, "g", "id", COLS, CFG, rows_per_task=100).toPandas()
    assert list(out.columns) == ["g", "id", *NAMES, "ensemble"]
    assert len(out) == 901 and set(out["g"]) == {"hot", "u", "v", "one"}
    for g in ("hot", "u"):
        P = prepare(table.where(F.col("g") == g), "g", "id", COLS)
        own = ["x0", "x1"] if g == "u" else ["x0", "x1", "x2"]
        X = P.select("id", F.array(*own).alias("features")).checkpoint()
        c = CFG
        models = {"isolation_forest": iforest.fit_iforest(X, "id", c.isolation_forest.n_trees, c.isolation_forest.max_samples,
                                                          c.isolation_forest.contamination, c.isolation_forest.seed),
                  "one_class_svm": ocsvm.fit_ocsvm(X, "id", c.one_class_svm.nu, c.one_class_svm.n_features, c.one_class_svm.steps, c.one_class_svm.seed),
                  "dbscan": dbscan.fit_dbscan(X, "id", c.dbscan.eps, c.dbscan.min_samples),
                  "autoencoder": recon.fit_recon(X, code_size=c.autoencoder.code_size, percentile=c.autoencoder.percentile, keep=("id",))}
        mine = out[out["g"] == g].set_index("id")
        for name, m in models.items():
            alone = m.predict(X, keep=("id",), out=name).toPandas().set_index("id")[name]
            differ = int((mine[name].loc[alone.index] != alone).sum())
            # the forest's features are drawn by number: a constant column moves no draw; only rounding at a bar may differ
            assert differ <= (1 if name in ("one_class_svm", "autoencoder") else 0), (g, name, differ)


def test_many_groups_in_one_plan(spark):
    df = spark.range(4000).select("id", (F.col("id") % 200).alias("g"), *[F.rand(i).alias(c) for i, c in enumerate(COLS)])
    got = fit_detectors_per_group(df, "g", "id", COLS, CFG).groupBy("g").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(m) == -1).alias(m) for m in NAMES]).collect()
    assert len(got) == 200 and all(r["n"] == 20 and 0 < r["isolation_forest"] <= 2 and 0 < r["autoencoder"] <= 2 for r in got)


def test_empty_table(spark, table):
    assert fit_detectors_per_group(table.limit(0), "g", "id", COLS, CFG).count() == 0


def test_detectors_refuse_an_empty_table(spark):
    X = spark.createDataFrame([], "id long, features array<double>")
    for fit in (lambda: dbscan.fit_dbscan(X, "id"), lambda: ocsvm.fit_ocsvm(X, "id"), lambda: recon.fit_recon(X)):
        with pytest.raises(ValueError, match="empty input"):
            fit()


def test_sequences_of_a_hot_key_with_the_default_buckets(spark):
    from flowlake.operators import order
    rows = [(1 if i % 10 else 2, i, float(i)) for i in range(600)] + [(3, i, float(i)) for i in range(5)] + [(None, i, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, t long, v double")
    for k in (1, 2, 10):
        plain = sorted((str(r.k), r.t, tuple(r.seq)) for r in order.sequences(df, "k", ["t"], "v", k=k).collect())
        for hot in (5, 60):
            assert sorted((str(r.k), r.t, tuple(r.seq)) for r in order.sequences(df, "k", ["t"], "v", k=k, hot_rows=hot).collect()) == plain
    assert len(plain) == (540 - 9) + (60 - 9) + 3


@pytest.mark.parametrize("d, eps", [(1, 0.05), (3, 0.4), (12, 2.9)])
def test_near_boxes_equal_brute_force(spark, d, eps):
    from flowlake.operators.detect.boxjoin import near_boxes
    rng = np.random.default_rng(d)
    lo = np.concatenate([rng.normal(size=(150, d)), np.zeros((40, d))])
    hi = lo + rng.uniform(0, 0.1, size=lo.shape) * (rng.random((len(lo), 1)) < 0.5)
    df = spark.createDataFrame([(i, i % 5 + 1, lo[i].tolist(), hi[i].tolist()) for i in range(len(lo))],
                               "cid long, weight long, lo array<double>, hi array<double>").checkpoint()
    got = sorted(tuple(r) for r in near_boxes(df, eps, block=16).collect())
    want = []
    for i in range(len(lo)):
        for j in range(len(lo)):
            gap = np.maximum(np.maximum(lo[j] - hi[i], lo[i] - hi[j]), 0)
            if (gap ** 2).sum() <= eps * eps:
                want.append((i, j, i % 5 + 1, j % 5 + 1, bool((np.maximum(hi[j] - lo[i], hi[i] - lo[j]) ** 2).sum() <= eps * eps)))
    assert got == sorted(want) and near_boxes(df.limit(0), eps).count() == 0


@pytest.mark.parametrize("alone, wave", [(50_000, 256), (500, 1)])
def test_svm_of_a_large_group_is_trained_on_all_rows(spark, monkeypatch, alone, wave):
    """12,000 rows a group: one task's training, the passes over large groups and the SVM of that group alone agree."""
    from flowlake.operators.detect import grouped
    monkeypatch.setattr(grouped._svms, "__defaults__", (alone, wave))
    df = spark.range(24_000).select("id", (F.col("id") % 2).alias("g"), *[(F.randn(i) * (F.col("id") % 2 + 1)).alias(c) for i, c in enumerate(COLS)]).checkpoint()
    cfg = DetectorConfig(models=("one_class_svm",))
    mine = fit_detectors_per_group(df, "g", "id", COLS, cfg, rows_per_task=5000).toPandas().set_index("id")["one_class_svm"]
    assert len(mine) == 24_000
    for g in (0, 1):
        X = prepare(df.where(F.col("g") == g), "g", "id", COLS).select("id", F.array("x0", "x1", "x2").alias("features")).checkpoint()
        c = cfg.one_class_svm
        alone_ = ocsvm.fit_ocsvm(X, "id", c.nu, c.n_features, c.steps, c.seed).predict(X, keep=("id",)).toPandas().set_index("id")["one_class_svm"]
        assert (alone_ == -1).sum() == 1200 and (mine.loc[alone_.index] != alone_).sum() <= 1
