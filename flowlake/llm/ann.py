"""Approximate nearest neighbours: stable projections, kd-trees and a chi-square stopping test.

Method.  Unit vectors are projected to ``M`` dimensions by a seeded Gaussian
matrix.  For two vectors at distance d, the squared projected distance divided by d^2
is chi-square with M degrees of freedom.  A kd-tree over the projections
returns candidates in the order of projected distance, each is verified on the original
vectors, and the search of a query stops once every unseen vector lies so far away in
the projection (at least r) that a vector nearer than the k-th found would show
such a distance with probability 1 - ``CONFIDENCE`` at most: chi2_cdf(r^2 / d_k^2) >= CONFIDENCE.

Scale.  The top of the tree, at most ``CELLS`` cells, is fitted on a bounded sample of
projections (``SAMPLE`` rows) and every row is indexed in its cell.  A cell larger than
``POINTS`` rows is dealt to several trees.  Each query first searches its own
cell; the distance found there and the same test decide which other cells it
visits.  Vectors that are equal have equal neighbours at any rank, so only
the k + 1 least ids of a group of copies are indexed (the rest can't be among k
nearest); Spark applies that limit before the shuffle, so a hot vector isn't gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.llm.common import Scratch, query, read

M, SEED = 8, 20
CONFIDENCE = 0.999
SAMPLE, CELLS, POINTS, LEAF = 20_000, 4096, 8192, 64
K, QUERY_STEP = 5, 50


def chi2_cdf(x: float, m: int) -> float:
    """For an even number of degrees of freedom."""
    h, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= h / (i + 1)
    return 1 - math.exp(-h) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def projection(d: int, m: int = M, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, d]).standard_normal((d, m))


def _matrix(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Usable rows of a vector column: their places and the vectors in double precision."""
    keep, out = [], []
    for i, v in enumerate(col):
        if v.is_valid and len(v.values) and v.values.null_count == 0:
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
            n = np.sqrt((x * x).sum())
            if np.isfinite(x).all() and np.isfinite(n) and n > 0:
                keep.append(i)
                out.append(x)
    return np.array(keep, dtype=np.int64), out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, p, d): usable vectors, their projections and dimensions.

    Null ids, null, empty or zero vectors and null or non-finite components take no part.
    """
    def run(batches):
        mats: dict[int, np.ndarray] = {}
        for batch in batches:
            keep, xs = _matrix(batch.column(1))
            ps = []
            for x in xs:
                r = mats.setdefault(len(x), projection(len(x)))
                ps.append((x / np.sqrt((x * x).sum())) @ r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(xs, pa.list_(pa.float64())), pa.array(ps, pa.list_(pa.float64())),
                 pa.array([len(x) for x in xs], pa.int32())], ["vec_id", "v", "p", "d"])
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null")
    return v.mapInArrow(run, "vec_id long, v array<double>, p array<double>, d int")


class Cells:
    """The top of the kd-tree: boxes of the projected space, split at medians of a sample."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.lo, self.hi = [np.full(M, -np.inf)], [np.full(M, np.inf)]
        parts = [sample]
        while len(parts) < cells:
            big = max(range(len(parts)), key=lambda i: len(parts[i]))
            x = parts[big]
            if len(x) < 2:
                break
            dim = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            cut = float(np.median(x[:, dim]))
            left = x[:, dim] < cut
            if not left.any() or left.all():
                break
            lo, hi = self.lo[big].copy(), self.hi[big].copy()
            lo[dim], hi[dim] = cut, cut
            parts[big], self_hi = x[left], self.hi[big].copy()
            self_hi[dim] = cut
            parts.append(x[~left])
            self.lo.append(lo)
            self.hi.append(self.hi[big])
            self.hi[big] = self_hi
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def near(self, p: np.ndarray) -> np.ndarray:
        """Least squared projected distance from ``p`` to each cell."""
        gap = np.maximum(np.maximum(self.lo - p, p - self.hi), 0)
        return (gap * gap).sum(axis=1)

    def home(self, p: np.ndarray) -> int:
        return int(np.flatnonzero(((p >= self.lo) & (p < self.hi)).all(axis=1))[0])


class Tree:
    """A kd-tree over the projections of one task's vectors: leaves as runs of rows with their boxes."""

    def __init__(self, p: np.ndarray):
        todo, leaves = [np.arange(len(p))], []
        while todo:
            rows = todo.pop()
            x = p[rows]
            span = x.max(axis=0) - x.min(axis=0)
            if len(rows) <= LEAF or span.max() == 0:
                leaves.append(rows)
                continue
            order = np.argsort(x[:, int(np.argmax(span))], kind="stable")
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2:]]]
        self.leaves = leaves
        self.lo, self.hi = (np.array([f(p[r], axis=0) for r in leaves]) for f in (np.min, np.max))

    def nearest_first(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Leaves by least squared projected distance, in growing batches, each with that of the next."""
        gap = np.maximum(np.maximum(self.lo - q, q - self.hi), 0)
        d = (gap * gap).sum(axis=1)
        order, i, n = np.argsort(d, kind="stable"), 0, 2
        while i < len(order):
            j = min(len(order), i + n)
            while j < len(order) and d[order[j]] <= 0:          # copies of the query lie in all of these
                j += 1
            yield (float(d[order[j]]) if j < len(order) else math.inf), np.concatenate([self.leaves[o] for o in order[i:j]])
            i, n = j, 2 * n


def _search(points: pd.DataFrame, queries: pd.DataFrame, k: int, bar: float) -> pd.DataFrame:
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(points) and len(queries):
        v = np.stack(points["v"].to_numpy())
        ids, norm = points["vec_id"].to_numpy(), np.sqrt((v * v).sum(axis=1))
        unit, tree = v / norm[:, None], Tree(np.stack(points["p"].to_numpy()))
        for qid, qv, qp, worst in zip(queries["vec_id"], queries["v"], queries["p"], queries["worst"], strict=True):
            qn = np.sqrt((qv * qv).sum())
            best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
            for nxt, rows in tree.nearest_first(np.asarray(qp)):
                rows = rows[ids[rows] != qid]
                least = best_s[k - 1] if len(best_s) >= k else worst
                rows = rows[unit[rows] @ (qv / qn) >= least - 1e-9]
                if len(rows):
                    s = (v[rows] * qv).sum(axis=1) / (norm[rows] * qn)
                    s, i = np.concatenate([best_s, s]), np.concatenate([best_i, ids[rows]])
                    top = np.lexsort((i, -s))[:k]
                    best_s, best_i = s[top], i[top]
                least = max(worst, best_s[k - 1] if len(best_s) >= k else -2.0)
                if least > -2 and nxt >= bar * max(0.0, 2 - 2 * least):
                    break
            out["query_id"].append(np.full(len(best_i), qid))
            out["vec_id"].append(best_i)
            out["score"].append(best_s)
    return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64"})


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, confidence: float = CONFIDENCE,
               sample: int = SAMPLE, points: int = POINTS) -> DataFrame:
    """The ``k`` nearest found of each query by cosine: query_id, rank, vec_id, score.

    Both inputs have vec_id and embedding; a query's own id is no candidate.  Ties go to
    the smaller vec_id.  Queries that can't take part, or find no candidate, have no
    rows.  Vectors of another length than the query's are no candidates.  Rows
    that repeat id and vector are one.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    sc = Scratch(spark)
    bar = chi2_quantile(confidence, M)
    every = sc.keep(usable(vectors).distinct())
    # k + 1 least ids of equal vectors: the query's own may be one of them
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = every.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1).drop("r")
    asked = sc.keep(usable(queries).dropDuplicates(["vec_id"]))
    n = every.groupBy("d").agg(F.count("*").alias("n")).collect()       # a row per vector length
    cells: dict[int, Cells] = {}
    for r in n:
        rows = every.filter(F.col("d") == r["d"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("p").collect()
        cells[r["d"]] = Cells(np.array([x["p"] for x in rows]), min(CELLS, max(1, math.ceil(r["n"] / points))))
    shared = spark.sparkContext.broadcast(cells)                        # at most CELLS boxes per vector length

    def place(batches):
        for batch in batches:
            home = [shared.value[d].home(np.array(p)) if d in shared.value else -1
                    for p, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], ["vec_id", "v", "p", "d", "cell"])
    placed = "vec_id long, v array<double>, p array<double>, d int, cell int"
    index = sc.keep(kept.mapInArrow(place, placed))
    # cells above the limit are dealt to several trees
    trees = sc.keep(index.groupBy("d", "cell").agg(F.ceil(F.count("*") / points).cast("int").alias("trees")))
    index = sc.keep(index.join(F.broadcast(trees), ["d", "cell"]).withColumn(
        "tree", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("trees")).cast("int")).drop("trees"))

    def search(q: DataFrame) -> DataFrame:
        q = q.join(F.broadcast(trees), ["d", "cell"]).withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))).drop("trees")
        return (index.groupBy("d", "cell", "tree").cogroup(q.groupBy("d", "cell", "tree"))
                .applyInPandas(lambda a, b: _search(a, b, k, bar), "query_id long, vec_id long, score double"))
    first = sc.keep(search(asked.mapInArrow(place, placed).withColumn("worst", F.lit(-2.0))))
    worst = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))) \
        .filter(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))
    again = asked.join(worst, "vec_id", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))

    def visit(batches):
        for batch in batches:
            rows, cell = [], []
            for i, (p, d, w) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                c = shared.value.get(d)
                if c is None:
                    continue
                p = np.array(p)
                far = c.near(p)
                go = np.flatnonzero((far < bar * max(0.0, 2 - 2 * w)) | (far <= 0) | (w <= -2))
                go = go[go != c.home(p)]
                rows += [i] * len(go)
                cell += go.tolist()
            t = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell, pa.int32())], ["vec_id", "v", "p", "d", "worst", "cell"])
    more = again.select("vec_id", "v", "p", "d", "worst").mapInArrow(
        visit, "vec_id long, v array<double>, p array<double>, d int, worst double, cell int")
    found = first.unionByName(search(more))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op7_approximate_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbours of every fiftieth vector, among all vectors."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(v, v.filter(F.col("vec_id") % QUERY_STEP == 0))
