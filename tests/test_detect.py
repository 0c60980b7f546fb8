"""Property tests of the detectors and report operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators import ensemble
from flowlake.operators.detect import dbscan
from flowlake.operators.detect.detector import AnomalyDetector, DetectorConfig


def _table(spark, n=1000, seed=42):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, size=(n, 4))
    x[:50] += rng.normal(6, 1, size=(50, 4))
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "rid long, a double, b double, c double, d double")


def test_iforest_rate_and_planted(spark):
    df = _table(spark)
    m = AnomalyDetector(DetectorConfig(models=("isolation_forest",))).fit(df, "rid")
    out = m.transform(df)
    flagged = {r.rid for r in out.where("isolation_forest = -1").collect()}
    assert 80 <= len(flagged) <= 100          # contamination 0.1, strict threshold
    assert len(flagged & set(range(50))) >= 45  # planted shift is found


def test_iforest_independent_of_partitioning(spark):
    df = _table(spark, 400)
    a = AnomalyDetector(DetectorConfig(models=("isolation_forest",))).fit(df, "rid")
    b = AnomalyDetector(DetectorConfig(models=("isolation_forest",))).fit(df.repartition(7), "rid")
    pa = sorted(map(tuple, a.transform(df).select("rid", "isolation_forest").collect()))
    pb = sorted(map(tuple, b.transform(df).select("rid", "isolation_forest").collect()))
    assert pa == pb


def test_recon_threshold(spark):
    df = _table(spark)
    m = AnomalyDetector(DetectorConfig(models=("autoencoder",))).fit(df, "rid")
    n = m.transform(df).where("autoencoder = -1").count()
    assert n == 50  # strictly above the 95th percentile of 1,000 distinct errors


def test_soft_vote_ties(spark):
    df = spark.createDataFrame([(1, 1, -1, None), (1, -1, None, None), (1, 1, -1, -1)],
                               "m1 int, m2 int, m3 int, m4 int")
    r1 = df.select(ensemble.soft_vote(["m1", "m2", "m3"]).alias("v")).first().v
    r2 = df.select(ensemble.soft_vote(["m1", "m2"]).alias("v")).collect()[1].v
    r3 = df.select(ensemble.soft_vote(["m1", "m2", "m3", "m4"]).alias("v")).collect()[2].v
    assert (r1, r2, r3) == (1, -1, -1)


def test_agreement(spark):
    df = spark.createDataFrame([(1, 1, -1), (1, 1, 1)], "a int, b int, c int")
    v = ensemble.model_agreement(df, ["a", "b", "c"]).first()[0]
    assert v == pytest.approx((2 / 3 + 1) / 2)


def _brute_dbscan(X, eps, min_s):
    n = len(X)
    d2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    nb = d2 <= eps * eps
    core = nb.sum(1) >= min_s
    label = np.full(n, -1)
    comp = list(range(n))

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i
    for i in range(n):
        for j in range(n):
            if core[i] and core[j] and nb[i, j]:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    for i in range(n):
        if core[i]:
            label[i] = min(k for k in range(n) if core[k] and find(k) == find(i))
    for i in range(n):
        if not core[i]:
            ls = [label[j] for j in range(n) if core[j] and nb[i, j]]
            label[i] = min(ls) if ls else -1
    return label


def test_dbscan_brute_force_and_repartition(spark):
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(0, 0.2, (80, 2)), rng.normal(3, 0.2, (80, 2)), rng.uniform(-2, 5, (40, 2))])
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    want = _brute_dbscan(X, 0.3, 5)
    for d in (df, df.repartition(5)):
        got = dict(dbscan.fit_dbscan(d, "id", 0.3, 5).labels.select("id", "cluster").collect())
        assert [got[i] for i in range(len(X))] == list(want)


def test_dbscan_hot_spot_matches_brute_force(spark):
    """A third of the points inside one tiny region (one pure cell) plus a
    spread: same labels as brute force, in 2 and 3 columns."""
    rng = np.random.default_rng(5)
    for d in (2, 3):
        X = np.concatenate([rng.normal(0, 0.01, (150, d)), rng.uniform(-1, 1, (300, d))])
        rows = [(i, [float(v) for v in x]) for i, x in enumerate(X)]
        df = spark.createDataFrame(rows, "id long, features array<double>")
        want = _brute_dbscan(X, 0.2, 6)
        got = dict(dbscan.fit_dbscan(df, "id", 0.2, 6).labels.select("id", "cluster").collect())
        assert [got[i] for i in range(len(X))] == list(want)


def _labels_by_definition(rows, eps, k):
    import numpy as np
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= k
    label = {i: i for i in range(len(ids)) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in label:
            m = min(label[j] for j in label if near[i, j])
            if m < label[i]:
                label[i], changed = m, True
    out = {}
    for i in range(len(ids)):
        c = label.get(i, min((label[j] for j in label if near[i, j]), default=None))
        out[ids[i]] = -1 if c is None else ids[c]
    return out


def test_dbscan_of_any_width_matches_brute_force(spark):
    import random

    from flowlake.operators.detect import dbscan
    rng = random.Random(12)
    for d, eps in ((1, 0.1), (2, 0.25), (3, 0.3), (6, 0.9), (12, 1.6)):
        spots = [[rng.uniform(-2, 2) for _ in range(d)] for _ in range(4)] + [[0.0] * d]
        rows = [(i, [v + rng.gauss(0, rng.choice((0.01, 0.2))) for v in rng.choice(spots)]) for i in range(180)]
        # two slabs that face each other just beyond eps
        rows += [(500 + i, [3.0 + 0.001 * i] + [0.0] * (d - 1)) for i in range(12)] + [(600 + i, [3.0 + 0.0111 + eps + 0.001 * i] + [0.0] * (d - 1)) for i in range(12)]
        df = spark.createDataFrame(rows, "id long, features array<double>")
        got = dict(dbscan.fit_dbscan(df, "id", eps, 5).labels.select("id", "cluster").collect())
        assert got == _labels_by_definition(rows, eps, 5), d


def test_dbscan_spot_on_a_corner_stores_no_pairs(spark):
    from pyspark.sql import functions as F

    from flowlake.operators.detect import dbscan
    # all pairs would be 1.6e9
    df = spark.range(40_000).select("id", F.array(*[(F.rand(s) - 0.5) * 0.1 for s in (1, 2, 3)]).alias("features"))
    out = dbscan.fit_dbscan(df, "id", 0.5, 5).labels.groupBy("cluster").count().collect()
    assert [(r["cluster"], r["count"]) for r in out] == [(0, 40_000)]
