"""M4: DBSCAN (Ester et al., KDD 1996) as Spark joins, one form for any number of columns.

1. Equal vectors collapse into one point with a weight.
2. Fine cells of side eps / sqrt(d) over all d columns: points of one cell are
   within eps of each other.  A cell of weight >= min_samples ("dense") holds
   core points only, so nothing is counted there.
3. Units are the points of the other, sparse cells and the dense cells.  Blocks of units from a tree of median
   cuts meet if their bounding boxes do, two in a task, and are compared in NumPy (``unitpairs``).
4. A sparse point counts the points and whole cells within eps.  Only one that this leaves undecided looks
   into the dense cells which the distance crosses.
5. Core units are linked by one known point each, merged inside a block, then between the components
   of two blocks, so the pairs within eps are never written.  Units of different components whose boxes are near
   seek a witness by linear passes: the point of one nearest to the other's box, the
   point there nearest to it, and back.  Only pairs that this leaves open compare
   points, and only those near the other's box, by sub-cells.
6. Clusters = connected components over core units; a border point
   takes the smallest label among its core neighbours, everything else is noise
   (-1).  Labels are the smallest row id of a core point in the cluster.

A dense spot therefore costs passes over its points and no pairs among them,
also where it straddles a corner of cells.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators.detect import unitpairs
from flowlake.session import ensure_checkpoint_dir


def _dist2(a: str, b: str):
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, v: acc + v)


@dataclass
class DbscanModel:
    eps: float
    min_samples: int
    dims: list
    core: DataFrame          # (pid, features, cell) of core points, checkpointed
    labels: DataFrame        # (id, cluster) of the fitted rows
    features: str = "features"

    def predict(self, df: DataFrame, keep: tuple = (), out: str = "dbscan") -> DataFrame:
        """Fitted rows keep their fit label; a new row is normal iff it is
        within eps of a fitted core point (M9)."""
        id_col = keep[0]
        x = _with_cell(df.select(id_col, self.features), self.features, self.dims, self.eps)
        nb = _neighbour_keys(x, len(self.dims))
        c = self.core.select(F.col("cell").alias("ncell"), F.col(self.features).alias("__cf"))
        near = (nb.join(c, "ncell").where(_dist2(self.features, "__cf") <= self.eps * self.eps)
                  .select(id_col).distinct().withColumn("__near", F.lit(True)))
        fitted = self.labels.select(F.col("id").alias(id_col), F.col("cluster").alias("__fit"))
        res = df.select(id_col).join(fitted, id_col, "left").join(near, id_col, "left")
        normal = F.when(F.col("__fit").isNotNull(), F.col("__fit") != -1).otherwise(F.coalesce("__near", F.lit(False)))
        return res.select(id_col, F.when(normal, 1).otherwise(-1).alias(out))


def _with_cell(df: DataFrame, feat: str, dims: list, eps: float) -> DataFrame:
    return df.withColumn("cell", F.array(*[F.floor(F.col(feat)[j] / F.lit(eps)).cast("long") for j in dims]))


def _neighbour_keys(df: DataFrame, k: int) -> DataFrame:
    offs = [list(o) for o in itertools.product((-1, 0, 1), repeat=k)]
    off_arr = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offs])
    return df.withColumn("__off", F.explode(off_arr)).withColumn(
        "ncell", F.zip_with("cell", "__off", lambda a, b: a + b)).drop("__off")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label=min node id in its component).  ``edges`` (a, b) undirected.
    Rounds go on until no label changes, however long the longest chain is."""
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    e = e.checkpoint()
    lab = nodes.select(F.col("node"), F.col("node").alias("label")).checkpoint()
    while True:
        prop = (e.join(lab.withColumnRenamed("node", "a"), "a")
                 .groupBy(F.col("b").alias("node")).agg(F.min("label").alias("cand")))
        new = (lab.join(prop, "node", "left")
                  .select("node", F.least("label", F.coalesce("cand", "label")).alias("label")))
        # pointer jumping: take the label of the label
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("l2"))
        new = new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("l2", "label")).alias("label"))
        new = new.checkpoint()
        changed = new.join(lab.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old")).count()
        lab = new
        if changed == 0:
            break
    return lab


def _box_near(alo, ahi, blo, bhi):
    """Least squared distance of two boxes given as arrays (a point is its own box)."""
    gap = F.zip_with(F.zip_with(blo, ahi, lambda x, y: x - y), F.zip_with(alo, bhi, lambda x, y: x - y),
                     lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v)


def fit_dbscan(X: DataFrame, id_col: str, eps: float = 0.5, min_samples: int = 5,
               features: str = "features", max_dims: int = 3) -> DbscanModel:
    """Exact DBSCAN for any number of columns."""
    spark = X.sparkSession
    ensure_checkpoint_dir(spark)
    row = X.select(features).first()
    if row is None:
        raise ValueError("empty input")
    d = len(row[0])
    x = lambda j: F.col(features)[j]
    rng = X.agg(*[(F.max(x(j)) - F.min(x(j))).alias(f"r{j}") for j in range(d)]).first()
    dims = sorted(range(d), key=lambda j: (-(rng[f"r{j}"] or 0.0), j))[:min(max_dims, d)]
    side, e2 = F.lit(eps / math.sqrt(d)), F.lit(eps * eps)
    pts = X.groupBy(features).agg(F.count(F.lit(1)).alias("w"), F.min(id_col).alias("pid"))
    pts = _with_cell(pts, features, dims, eps).withColumn("fc", F.transform(features, lambda v: F.when(~F.isnan(v), F.floor(v / side).cast("long"))))
    pts = pts.withColumn("u", F.monotonically_increasing_id()).checkpoint()
    cells = pts.groupBy("fc").agg(
        F.sum("w").alias("weight"), F.min("u").alias("cid"), F.min_by(features, "u").alias("rep"), F.min_by("w", "u").alias("wr"),
        F.array(*[F.min(x(j)) for j in range(d)]).alias("lo"), F.array(*[F.max(x(j)) for j in range(d)]).alias("hi")).checkpoint()
    dense = F.col("weight") >= min_samples
    P = pts.join(cells.select("fc", "cid", dense.alias("dense")), "fc")
    P = P.select("u", "pid", features, "w", F.when(F.col("dense"), F.col("cid")).otherwise(F.col("u")).alias("unit"), "dense").checkpoint()

    # vectors that lack a number are near nothing: they stay out of the blocks, and only copies make them core
    real = lambda c: F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    lone = cells.where(dense & ~real("rep")).select(F.lit(-1).cast("long").alias("block"), F.col("cid").alias("u"), F.col("cid").alias("comp"))
    spots = cells.where(dense & real("rep")).select(F.col("cid").alias("u"), F.col("weight").alias("w"), "wr", F.lit(True).alias("dense"), "rep", "lo", "hi")
    units = spots.unionByName(P.where(~F.col("dense") & real(features)).select(
        "u", "w", F.col("w").alias("wr"), "dense", *[F.col(features).alias(c) for c in ("rep", "lo", "hi")]))
    blocks = unitpairs.packed_blocks(units, units.count(), d)
    pairs = unitpairs.near_blocks(blocks, eps)

    # counts; only points that they leave undecided look into the cells which the distance crosses
    k = unitpairs.counts(blocks, pairs, eps, min_samples).checkpoint()
    enough, more = F.col("least") >= min_samples, None
    probe = k.where(~enough & (F.col("crossing") > 0)).select("block", "u")
    if not probe.isEmpty():
        inside = P.where("dense").select(F.col("unit").alias("n"), F.col(features).alias("g"), F.col("w").alias("qw"))
        more = (unitpairs.crossed_cells(blocks, pairs, probe, eps).join(P.select("u", F.col(features).alias("f")), "u").join(inside, "n")
                .where(_dist2("f", "g") <= e2).groupBy("u", "n").agg(F.sum("qw").alias("more")).checkpoint())
        k = k.join(more.groupBy("u").agg(F.sum("more").alias("more")), "u", "left")
        enough = enough | (F.col("k") + F.coalesce("more", F.lit(0)) >= min_samples)
    blocks = unitpairs.with_cores(blocks, k.where(enough).select("block", "u"), eps)
    local = blocks.select("block", F.explode(F.arrays_zip("core", "comp")).alias("z")).select("block", "z.core", "z.comp").toDF("block", "u", "comp").unionByName(lone).checkpoint()

    # components of units: by their known points, then between components by any point of a dense cell
    linked = unitpairs.links(blocks, pairs, eps).checkpoint()
    comp = connected_components(local.select(F.col("comp").alias("node")).distinct(), linked.where("not border").select("a", "b"))
    whole = local.join(comp.withColumnRenamed("node", "comp"), "comp").select("block", "u", F.col("label").alias("comp")).checkpoint()
    if not spots.isEmpty():
        left = unitpairs.open_pairs(blocks, pairs, whole, eps).checkpoint()
        if not left.isEmpty():
            at = lambda c, n: whole.select(F.col("u").alias(c), F.col("comp").alias(n))
            edges = _dense_edges(P, left, units, features, eps, d).join(at("c", "a"), "c").join(at("n", "b"), "n").select("a", "b")
            comp = connected_components(whole.select(F.col("comp").alias("node")).distinct(), edges)
            whole = whole.join(comp.withColumnRenamed("node", "comp"), "comp").select("u", F.col("label").alias("comp")).checkpoint()
    core_pts = P.join(whole.select(F.col("u").alias("unit"), "comp"), "unit").select("u", "pid", "unit", "comp")
    name = core_pts.groupBy("comp").agg(F.min("pid").alias("label")).checkpoint()
    core_label = core_pts.join(name, "comp").select("u", F.col("label").alias("clabel"))
    beside = linked.where("border").select(F.col("a").alias("u"), F.col("b").alias("unit"))
    if more is not None:
        beside = beside.unionByName(more.select("u", F.col("n").alias("unit")))
    border = (beside.join(whole.select(F.col("u").alias("unit"), "comp"), "unit").join(name, "comp")
              .groupBy("u").agg(F.min("label").alias("blabel")))
    plabel = (P.select("u", features).join(core_label, "u", "left").join(border, "u", "left")
              .select(features, F.coalesce("clabel", "blabel", F.lit(-1)).alias("cluster")))
    labels = X.select(F.col(id_col).alias("id"), features).join(plabel, features).select("id", "cluster")
    core_out = pts.join(core_pts.select("u"), "u", "left_semi").select("pid", features, "cell").checkpoint()
    return DbscanModel(eps, min_samples, dims, core_out, labels.checkpoint(), features)


def _dense_edges(P: DataFrame, left: DataFrame, units: DataFrame, features: str, eps: float, d: int) -> DataFrame:
    """(c, n): those pairs of units ``left`` with two points within eps."""
    e2 = F.lit(eps * eps)
    box = lambda c, x: units.select(F.col("u").alias(c), F.col("lo").alias(f"{x}lo"), F.col("hi").alias(f"{x}hi"))
    open_ = left.join(box("c", "a"), "c").join(box("n", "b"), "n").select("c", "n", "alo", "ahi", "blo", "bhi")
    A, B = P.select(F.col("unit").alias("c"), F.col(features).alias("f")), P.select(F.col("unit").alias("n"), F.col(features).alias("g"))
    to_b = _box_near(F.col("f"), F.col("f"), F.col("blo"), F.col("bhi"))
    first = open_.join(A, "c").groupBy("c", "n").agg(F.min_by("f", to_b).alias("f0"))
    there = first.join(B, "n").groupBy("c", "n").agg(F.min(_dist2("f0", "g")).alias("d1"), F.min_by("g", _dist2("f0", "g")).alias("g0")).checkpoint()
    done = there.where(F.col("d1") <= e2).select("c", "n")
    back = there.where(F.col("d1") > e2).select("c", "n", "g0").join(A, "c").groupBy("c", "n").agg(F.min(_dist2("f", "g0")).alias("d2")).checkpoint()
    done = done.unionByName(back.where(F.col("d2") <= e2).select("c", "n"))
    # still open: points near the other's box, by sub-cells of a quarter's side
    left = back.where(F.col("d2") > e2).select("c", "n").join(open_, ["c", "n"])
    sub = F.lit(eps / math.sqrt(d) / 4)
    cut = lambda f: F.transform(f, lambda v: F.floor(v / sub).cast("long"))
    fa = left.join(A, "c").where(to_b <= e2).select("c", "n", "f", cut("f").alias("sf"))
    fb = left.join(B, "n").where(_box_near(F.col("g"), F.col("g"), F.col("alo"), F.col("ahi")) <= e2).select("c", "n", "g", cut("g").alias("sg"))
    lo, hi = (lambda c: F.transform(c, lambda v: v * sub)), (lambda c: F.transform(c, lambda v: (v + 1) * sub))
    subs = fa.select("c", "n", "sf").distinct().join(fb.select("c", "n", "sg").distinct(), ["c", "n"]).where(
        _box_near(lo("sf"), hi("sf"), lo("sg"), hi("sg")) <= e2 * (1 + 1e-9))
    found = subs.join(fa, ["c", "n", "sf"]).join(fb, ["c", "n", "sg"]).where(_dist2("f", "g") <= e2).select("c", "n").distinct()
    return done.unionByName(found)


def cluster_sizes(labels: DataFrame, col: str = "cluster") -> DataFrame:
    """Rows per cluster (noise is -1)."""
    return labels.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
