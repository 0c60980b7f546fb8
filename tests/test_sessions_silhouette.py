"""Append-mode sessions (ST11) and the Euclidean silhouette."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators import cluster
from flowlake.streaming import monitor

SCHEMA = "flow_id string, ts timestamp, packet_size int"


def _land(spark, path, rows):
    df = spark.createDataFrame(rows, "flow_id string, s long, packet_size int")
    df.select("flow_id", F.timestamp_seconds("s").alias("ts"), "packet_size").coalesce(1).write.mode("append").parquet(path)


def _run(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    agg = monitor.flow_sessions(stream, gap="60 seconds", watermark="10 seconds")
    return monitor.sessions_to_table(agg, f"{tmp_path}/out", f"{tmp_path}/ck")


def _by_hand(rows, gap=60):
    out, last = [], {}
    for flow, s, size in sorted(rows, key=lambda r: (r[0], r[1])):
        if flow in last and s <= out[last[flow]][2] + gap:  # Spark joins a row that lies just the gap away
            e = out[last[flow]]
            e[2], e[3], e[4] = s, e[3] + 1, e[4] + (size or 0)
        else:
            last[flow] = len(out)
            out.append([flow, s, s, 1, size or 0])
    return sorted((f, a, b + gap, n, size) for f, a, b, n, size in out)


def _collected(df):
    return sorted(tuple(r) for r in df.select("flow_id", F.unix_timestamp("session.start"), F.unix_timestamp("session.end"),
                                              "packets", "bytes").collect())


def test_sessions_over_three_runs_with_a_hot_flow(spark, tmp_path):
    rng = np.random.default_rng(3)
    seen = []
    for part in range(3):
        rows = [("hot", int(s), 10) for s in range(part * 1000, part * 1000 + 400)]
        rows += [(f"f{int(f)}", int(s), None if f == 3 else 7) for f, s in zip(rng.integers(0, 9, 300), rng.integers(part * 1000, part * 1000 + 990, 300))]
        seen += rows
        _land(spark, f"{tmp_path}/in", rows)
        assert _run(spark, tmp_path) == 0
        got = monitor.all_sessions(spark, f"{tmp_path}/out", f"{tmp_path}/ck")
        assert _collected(got) == _by_hand(seen)
        # the state holds the sessions that the watermark has not passed, not every session so far
        still = monitor.open_sessions(spark, f"{tmp_path}/ck").count()
        assert still == sum(end > max(r[1] for r in seen) - 10 for _, _, end, _, _ in _by_hand(seen))
        assert got.where("closed").count() == got.count() - still
    assert spark.conf.get(monitor._MERGE_LOCALLY, "false") == "false"


def test_late_rows_are_counted(spark, tmp_path):
    _land(spark, f"{tmp_path}/in", [("a", 5000, 1), ("b", 5001, 1)])
    assert _run(spark, tmp_path) == 0
    _land(spark, f"{tmp_path}/in", [("a", 10, 1), ("b", 5002, 1)])
    assert _run(spark, tmp_path) == 1


def _silhouettes(x, own):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        same = (own == own[i]) & (np.arange(len(x)) != i)
        b = min(d[i, own == c].mean() for c in set(own.tolist()) - {own[i]})
        a = d[i, same].mean() if same.any() else 0.0
        out.append(0.0 if not same.any() or max(a, b) == 0 else (b - a) / max(a, b))
    return out


@pytest.mark.parametrize("block_rows", [16, 1024])
def test_euclidean_silhouette_is_exact(spark, block_rows):
    rng = np.random.default_rng(8)
    own = rng.integers(0, 4, 120)
    own[0] = 77  # alone in its cluster
    x = rng.normal(size=(120, 5)) + own[:, None] * 0.7 + 1000.0
    x[5:25] = x[5]  # copies, far from the origin: products of such rows cancel
    rows = [(int(i), v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, own))]
    df = spark.createDataFrame(rows + [(500, None, 1), (501, x[1].tolist(), None)], "id long, x array<double>, c int")
    got = cluster.silhouette_points(df, "id", "x", "c", block_rows=block_rows).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(120))
    assert [r["silhouette"] for r in got] == pytest.approx(_silhouettes(x, own), abs=1e-9)


def test_euclidean_silhouette_of_little(spark):
    schema = "id long, x array<double>, c int"
    none = cluster.silhouette_points(spark.createDataFrame([], schema), "id", "x", "c")
    assert none.columns == ["id", "c", "within", "nearest", "silhouette"] and none.count() == 0
    one = cluster.silhouette_points(spark.createDataFrame([(1, [0.0], 4), (2, [1.0], 4)], schema), "id", "x", "c").collect()
    assert [(r["within"], r["nearest"], r["silhouette"]) for r in one] == [(1.0, None, None)] * 2
    same = cluster.silhouette_points(spark.createDataFrame([(i, [2.0], i % 2) for i in range(6)], schema), "id", "x", "c").collect()
    assert [r["silhouette"] for r in same] == [0.0] * 6


def test_euclidean_silhouette_deals_rows_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TILE", 8)
    rng = np.random.default_rng(3)
    x, own = rng.normal(size=(600, 4)), rng.integers(0, 5, 600)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, own))], "id long, x array<double>, c int")
    seen = spark.sparkContext.accumulator(0)
    pair = cluster._block_pair
    monkeypatch.setattr(cluster, "_block_pair", lambda a, b: (seen.add(len(a)), pair(a, b))[1])
    got = cluster.silhouette_points(df, "id", "x", "c").orderBy("id").collect()
    assert [r["silhouette"] for r in got] == pytest.approx(_silhouettes(x, own), abs=1e-9)
    assert 0 < seen.value <= 600 * (cluster.BLOCKS + 1)        # with blocks of a tile: 600 * 75 / 2
