"""Pairs of boxes within a distance, for any number of columns: the join behind DBSCAN.

A tree of median cuts, fitted on a bounded sample, deals the boxes over leaves; each leaf is cut further into
blocks of ``BLOCK`` boxes at most, wherever it spreads most.  A block travels as one row of packed numbers
with its own bounding box.  Blocks whose bounding boxes lie further apart than the distance never meet (first
leaves, then blocks); the others are compared pair by pair in NumPy, a bounded matrix at a time.  So the work
follows the blocks that touch, on three columns as on sixty-four, and a task holds two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024                    # boxes in one block
LEAVES, SAMPLE = 4096, 50_000   # leaves of the tree, and the rows at most that fit it
CELLS = 1 << 18                 # entries of the matrix held at a time


def _cuts(A: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (column, value, left, right) of median cuts across the widest column; column -1 is a leaf named by ``left``."""
    nodes: list = [None]
    todo, named = [(0, A, leaves)], 0
    while todo:
        at, rows, n = todo.pop()
        wide = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(A.shape[1])
        j = int(wide.argmax()) if len(wide) else 0
        v = float(np.median(rows[:, j])) if n > 1 and wide.max(initial=0) > 0 else 0.0
        left = rows[:, j] < v if n > 1 and wide.max(initial=0) > 0 else np.zeros(len(rows), dtype=bool)
        if not left.any():
            nodes[at] = (-1, 0.0, named, 0)
            named += 1
            continue
        nodes[at] = (j, v, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(nodes[at][2], rows[left], n // 2), (nodes[at][3], rows[~left], n - n // 2)]
    return nodes


def _leaf_of(A: np.ndarray, nodes: list) -> np.ndarray:
    col, val, lo, hi = (np.array(x) for x in zip(*nodes, strict=True))
    at, rows = np.zeros(len(A), dtype=np.int64), np.arange(len(A))
    while (col[at] >= 0).any():
        j = col[at]
        at = np.where(j >= 0, np.where(A[rows, np.maximum(j, 0)] < val[at], lo[at], hi[at]), at)
    return lo[at]


def _parts(A: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of parts of ``size`` at most, cut at medians across the widest column."""
    out, todo = [], [np.arange(len(A))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        j = int(np.ptp(A[rows], axis=0).argmax())
        by, half = np.argsort(A[rows, j], kind="stable"), len(rows) // 2
        todo += [rows[by[:half]], rows[by[half:]]]
    return out


def _gap2(alo, ahi, blo, bhi) -> np.ndarray:
    """Least squared distances of all boxes of one block to all of the other."""
    out = np.zeros((len(alo), len(blo)))
    for j in range(alo.shape[1]):
        g = np.maximum(blo[None, :, j] - ahi[:, None, j], alo[:, None, j] - bhi[None, :, j])
        np.maximum(g, 0.0, out=g)
        out += g * g
    return out


def _span2(alo, ahi, blo, bhi) -> np.ndarray:
    """Greatest squared distances of given pairs of boxes."""
    g = np.maximum(bhi - alo, ahi - blo)
    out = np.zeros(len(alo))
    for j in range(alo.shape[1]):
        out += g[:, j] * g[:, j]
    return out


def near_boxes(boxes: DataFrame, eps: float, block: int = BLOCK) -> DataFrame:
    """``boxes`` (cid, weight, lo, hi) to pairs (c, n, cW, nW, full) in both directions, each box with itself too:
    boxes at most ``eps`` apart; ``full`` if no two of their points lie further apart than that.

    ``boxes`` should be written or checkpointed.  No box gives no pair.
    """
    spark = boxes.sparkSession
    n = boxes.count()
    take = boxes.select("lo") if n <= SAMPLE else boxes.select("lo").where(F.rand(7) < SAMPLE / n)
    sample = np.array([r[0] for r in take.limit(SAMPLE).collect()], dtype="float64").reshape(min(n, 1) and -1, len(boxes.select("lo").first()[0]) if n else 1)
    nodes = _cuts(sample, max(1, min(LEAVES, math.ceil(n / block))))
    e2 = eps * eps

    def deal(batches):
        for pdf in batches:
            pdf["leaf"] = _leaf_of(np.stack(pdf["lo"].to_numpy()), nodes) if len(pdf) else np.zeros(0, dtype=np.int64)
            yield pdf

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, leaf = np.stack(pdf["lo"].to_numpy()), np.stack(pdf["hi"].to_numpy()), int(pdf["leaf"].iloc[0])
        cid, w, rows = pdf["cid"].to_numpy(dtype="int64"), pdf["weight"].to_numpy(dtype="int64"), []
        for k, p in enumerate(_parts(lo, block)):
            rows.append((leaf, (leaf << 32) + k, lo[p].min(axis=0).tolist(), hi[p].max(axis=0).tolist(),
                         b"".join(x[p].tobytes() for x in (cid, w, lo, hi))))
        return pd.DataFrame(rows, columns=["leaf", "block", "blo", "bhi", "packed"])
    dealt = boxes.select("cid", "weight", "lo", "hi").mapInPandas(deal, "cid long, weight long, lo array<double>, hi array<double>, leaf long")
    blocks = dealt.groupBy("leaf").applyInPandas(pack, "leaf long, block long, blo array<double>, bhi array<double>, packed binary").checkpoint()
    d = sample.shape[1]
    side = lambda f, c: F.array(*[f(F.col(c)[j]) for j in range(d)])
    tops = blocks.groupBy("leaf").agg(side(F.min, "blo").alias("lo"), side(F.max, "bhi").alias("hi")).collect()      # LEAVES rows at most
    leaf = np.array([r["leaf"] for r in tops], dtype=np.int64)
    lo, hi = (np.array([r[c] for r in tops], dtype="float64").reshape(len(tops), d) for c in ("lo", "hi"))
    close: list = []
    for i in range(len(tops)):
        j = np.flatnonzero((_gap2(lo[i:i + 1], hi[i:i + 1], lo, hi)[0] <= e2) & (leaf >= leaf[i]))
        close += [(int(leaf[i]), int(leaf[k])) for k in j]
    gap = F.zip_with(F.zip_with("blo2", "bhi", lambda x, y: x - y), F.zip_with("blo", "bhi2", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    outer = blocks.select("leaf", "block", "blo", "bhi")
    other = outer.toDF("leaf2", "block2", "blo2", "bhi2")
    pairs = (outer.join(spark.createDataFrame(close, "leaf long, leaf2 long"), "leaf").join(other, "leaf2")
             .where("block <= block2").where(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v) <= e2).select("block", "block2").checkpoint())
    work = (pairs.join(blocks.select("block", F.col("packed").alias("p")), "block")
            .join(blocks.select(F.col("block").alias("block2"), F.col("packed").alias("q")), "block2")
            .repartition(max(1, math.ceil(pairs.count() / 8)), "block", "block2").select("block", "block2", "p", "q"))

    def unpack(raw: bytes):
        m = len(raw) // (16 + 16 * d)
        ints, flo = np.frombuffer(raw, dtype=np.int64, count=2 * m), np.frombuffer(raw, dtype=np.float64, offset=16 * m)
        return ints[:m], ints[m:], flo[:m * d].reshape(m, d), flo[m * d:].reshape(m, d)

    def compare(batches):
        for batch in batches:
            for b1, b2, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (ca, wa, alo, ahi), (cb, wb, blo, bhi) = unpack(p), unpack(q)
                step = max(1, CELLS // len(cb))
                for s in range(0, len(ca), step):
                    i, j = np.nonzero(_gap2(alo[s:s + step], ahi[s:s + step], blo, bhi) <= e2)
                    i += s
                    full = _span2(alo[i], ahi[i], blo[j], bhi[j]) <= e2
                    cols = [ca[i], cb[j], wa[i], wb[j], full]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["c", "n", "cW", "nW", "full"])
                    if b1 != b2:
                        yield pa.RecordBatch.from_arrays([pa.array(cols[k]) for k in (1, 0, 3, 2, 4)], ["c", "n", "cW", "nW", "full"])
    return work.mapInArrow(compare, "c long, n long, cW long, nW long, full boolean")
