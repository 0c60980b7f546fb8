"""DBSCAN's counts and links by blocks: nothing is written per pair within eps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators.detect import dbscan, unitpairs
from tests.test_detect import _brute_dbscan


def _units(spark, x):
    rows = [(i, 1, 1, False, v.tolist(), v.tolist(), v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "u long, w long, wr long, dense boolean, rep array<double>, lo array<double>, hi array<double>")


@pytest.mark.parametrize("d", [2, 24])
def test_counts_and_links_leave_no_pairs(spark, monkeypatch, d):
    monkeypatch.setattr(unitpairs, "BLOCK", 40)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.05, (250, d)), rng.normal(9, 0.05, (150, d)), [[50.0] * d]])
    blocks = unitpairs.packed_blocks(_units(spark, x), len(x), d)
    assert blocks.count() > 4
    pairs = unitpairs.near_blocks(blocks, 2.0)
    k = unitpairs.counts(blocks, pairs, 2.0).checkpoint()
    assert [r.k for r in k.orderBy("u").collect()] == [250] * 250 + [150] * 150 + [1]
    blocks = unitpairs.with_cores(blocks, k.where("k >= 5").select("block", "u"), 2.0)
    made = unitpairs.links(blocks, pairs, 2.0)
    assert made.count() <= 2 * pairs.count()         # 85,000 pairs lie within eps
    node = blocks.select(F.explode("comp").alias("node")).distinct()
    comp = dbscan.connected_components(node, made.where("not border").select("a", "b"))
    assert comp.select("label").distinct().count() == 2


@pytest.mark.parametrize("eps, least", [(0.25, 4), (0.5, 9)])
def test_dbscan_over_many_small_blocks(spark, monkeypatch, eps, least):
    monkeypatch.setattr(unitpairs, "BLOCK", 16)
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 0.04, (120, 3)), rng.uniform(-1.2, 1.2, (160, 3)), rng.normal(1.0, 0.3, (80, 3)) * [1, 1, 0]])
    x = np.concatenate([x, x[:30]])                  # copies weigh
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = dict(dbscan.fit_dbscan(df, "id", eps, least).labels.collect())
    assert [got[i] for i in range(len(x))] == list(_brute_dbscan(x, eps, least))


def test_vectors_without_a_number_disturb_no_others(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.uniform(-2, 2, (60, 2))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(200 + i, [None, None]) for i in range(6)] + [(300, [float("nan"), 0.0]), (301, [None, 1.0]), (302, None)]
    got = dict(dbscan.fit_dbscan(spark.createDataFrame(rows + odd, "id long, features array<double>"), "id", 0.3, 5).labels.collect())
    assert [got[i] for i in range(len(x))] == list(_brute_dbscan(x, 0.3, 5))
    assert [got[200 + i] for i in range(6)] == [200] * 6 and got[300] == got[301] == -1


def test_a_point_that_has_enough_neighbours_looks_no_further(spark, monkeypatch):
    """Equal decisions with and without the bar, and only the undecided leave their block."""
    monkeypatch.setattr(unitpairs, "BLOCK", 40)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.3, (400, 3)), rng.uniform(-3, 3, (60, 3))])
    blocks = unitpairs.packed_blocks(_units(spark, x), len(x), 3)
    pairs = unitpairs.near_blocks(blocks, 0.5)
    whole = {r.u: r.least for r in unitpairs.counts(blocks, pairs, 0.5).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert [whole[i] for i in range(len(x))] == (d2 <= 0.25).sum(axis=1).tolist()
    probed = []
    over = unitpairs._over
    monkeypatch.setattr(unitpairs, "_over", lambda b, p, *a: (probed.extend(u for r in b.collect() for u in r.probe or []), over(b, p, *a))[1])
    short = {r.u: r.least for r in unitpairs.counts(blocks, pairs, 0.5, 5).collect()}
    assert all((short[u] >= 5) == (n >= 5) and short[u] <= n and (n >= 5 or short[u] == n) for u, n in whole.items())
    assert 0 < len(probed) < len(x) / 2


def test_unlike_meets_every_unequal_pair_once():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, y = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 9))
        met = [(i, j) for r, c in unitpairs._unlike(x, y) for i in r for j in c]
        assert len(met) == len(set(met)) and {(i, j) for i in range(len(x)) for j in range(len(y)) if x[i] != y[j]} <= set(met)


def test_quantile_buckets_by_halving(spark):
    from flowlake.operators.quantiles import _below
    rng = np.random.default_rng(1)
    rows = [(sorted(float(v) for v in rng.integers(0, 30, n)), float(v)) for n in (1, 2, 63, 255) for v in (-1, 0, 7, 15, 29, 31)] + [([], 1.0)]
    got = spark.createDataFrame(rows, "b array<double>, v double").select("b", "v", _below("b", "v").alias("n")).collect()
    assert [r.n for r in got] == [sum(x < r.v for x in r.b) for r in got]
