"""Every detector for every group (one capture file, one day, ...) in one run of jobs.

Each group has its own preparation (M1), forest (M2), one-class SVM (M3), DBSCAN (M4), reconstruction
error (M5) and ensemble vote (M7), as if it were fitted alone; no job runs per group.

* Preparation: variances as one grouped aggregate, medians and quartiles as exact quantiles by (group, column).
* Forest: the rows of least ``xxhash64(seed, tree, id)`` in a group are a tree's sample; a task grows one tree.
* SVM: random Fourier features and subgradient steps as in ``ocsvm``, over every row of a group.  Rows are packed once, a part of a
  group in a row.  A group of ``ALONE`` rows at most is trained by one task; of larger ones, ``WAVE`` at a time, every step is one pass
  in which each part gives its violators' sum.  The bar is the exact quantile of all scores of the group.
* Reconstruction: sums and cross products of a part of a group are added over its parts; the components are the
  leading eigenvectors of that covariance.
* DBSCAN: the group's number, times more than eps, is one more coordinate, so that it enters every cell key
  and no two groups touch.
* Scoring: a group is dealt to parts of ``rows_per_task`` rows, and each part meets one row with its group's
  models.  So neither a hot group nor the number of groups has a limit, and models are never collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators import ensemble
from flowlake.operators.detect.dbscan import fit_dbscan
from flowlake.operators.detect.detector import DetectorConfig
from flowlake.operators.detect.iforest import _grow, avg_path
from flowlake.operators.encode import clean_number
from flowlake.operators.quantiles import exact_quantiles
from flowlake.session import ensure_checkpoint_dir

ALONE, WAVE = 50_000, 256       # rows of a group that one task trains an SVM on, and larger groups that take their steps together
PACKS = 8                       # packed parts of groups in a task
TASK_ROWS, FEW_GROUPS = 500_000, 10_000         # rows of the prepared table in a task; groups whose numbers, some 500 bytes each, are broadcast
WALK = 1 << 21                  # tree places looked at together


def _unit_hash(seed: int, *parts):
    h = F.xxhash64(F.lit(seed), *parts)
    return h.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).cast("double") / F.lit(float(2 ** 63))


def _least(rows: DataFrame, by: list, size, u, order: str) -> DataFrame:
    """The ``size`` rows of least ``u`` in each group ``by``; four times as many at most are sorted on average."""
    rows = rows.withColumn("__u", u).where(F.col("__u") < F.lit(4.0) * size / F.col("__n") + 64.0 / F.col("__n"))
    w = Window.partitionBy(*by).orderBy("__u", order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= size)


def prepare(df: DataFrame, group: str, id_col: str, columns: list) -> DataFrame:
    """(group, id, x0.., __n, __g, __d): cleaned columns scaled by the group's own medians and quartile ranges.

    A column that doesn't vary in a group is 0 there; ``__d`` counts the others.  ``__g`` numbers the groups.
    """
    own = [f"x{i}" for i in range(len(columns))]
    clean = df.select(group, id_col, *[clean_number(F.col(f"`{c}`")).alias(x) for c, x in zip(columns, own, strict=True)])
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / TASK_ROWS))
    clean = clean.repartition(tasks, id_col).checkpoint()       # read by every pass of the quantiles; few bytes would be drawn into few tasks
    long = clean.select(group, F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("value")) for x in own])).alias("s")) \
        .select(group, "s.column", "s.value")
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=[group, "column"], names=["q1", "med", "q3"])
    scale = F.when(F.col("q3") - F.col("q1") != 0, F.col("q3") - F.col("q1")).otherwise(F.lit(1.0))
    q = q.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("med", scale.alias("scale"))))).alias("__q"))
    stats = clean.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.array(*[F.coalesce(F.var_samp(x) != 0, F.lit(True)) for x in own]).alias("__varies"))
    stats = stats.join(q, group).withColumn("__g", F.monotonically_increasing_id()).checkpoint()
    out = clean.join(F.broadcast(stats) if stats.count() <= FEW_GROUPS else stats, group)        # else a few groups would make a few tasks
    scaled = [F.when(F.col("__varies")[i], (F.col(x) - F.col("__q")[x]["med"]) / F.col("__q")[x]["scale"]).otherwise(0.0).alias(x)
              for i, x in enumerate(own)]
    return out.select(group, id_col, *scaled, "__n", "__g", F.size(F.filter("__varies", lambda v: v)).alias("__d"))


def grown_forests(X: DataFrame, cols: list, id_col: str, cfg) -> DataFrame:
    """(__g, forest): the nodes of all trees of a group as one row of arrays."""
    size = F.least(F.col("__n"), F.lit(cfg.max_samples))
    thr = F.lit(4.0) * size / F.col("__n") + 64.0 / F.col("__n")
    cand = X.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_trees - 1)))).where(     # compiled, unlike a filter inside an array
        _unit_hash(cfg.seed, F.col("tree"), F.col(id_col)) < thr)
    sample = _least(cand, ["__g", "tree"], size, _unit_hash(cfg.seed, F.col("tree"), F.col(id_col)), id_col)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, X_ = int(pdf["tree"].iloc[0]), pdf.sort_values("__rn")[cols].to_numpy(dtype="float64")
        nodes = _grow(X_, np.random.default_rng([cfg.seed, tree]), int(math.ceil(math.log2(max(len(X_), 2)))))
        f, s, lo, hi, n, depth = (np.array(x) for x in zip(*nodes, strict=True))
        return pd.DataFrame({"__g": [pdf["__g"].iloc[0]], "tree": [tree], "feature": [f.tolist()], "split": [s.astype(float).tolist()],
                             "left": [lo.tolist()], "right": [hi.tolist()], "height": [(depth + avg_path(n)).tolist()],
                             "psi": [len(X_)], "depth": [int(depth.max())]})
    trees = sample.select("__g", "tree", "__rn", *cols).groupBy("__g", "tree").applyInPandas(
        build, "__g long, tree int, feature array<int>, split array<double>, left array<int>, right array<int>, "
               "height array<double>, psi long, depth int")
    return trees.groupBy("__g").agg(F.array_sort(F.collect_list(F.struct("tree", "feature", "split", "left", "right", "height", "psi", "depth"))).alias("forest"))


def walk(X: np.ndarray, forest: list) -> np.ndarray:
    """Anomaly scores 2^(-mean height / c(psi)); a tree's siblings stand side by side, so that a step is one comparison."""
    c = float(avg_path([forest[0]["psi"]])[0])
    if c <= 0:
        return np.full(len(X), 0.5)
    packs = []
    for t in forest:
        left, right, inner = np.asarray(t["left"]), np.asarray(t["right"]), np.asarray(t["feature"]) >= 0
        n, kids = len(inner), np.flatnonzero(inner)
        at = np.zeros(n, dtype="int64")
        at[left[kids]], at[right[kids]] = 2 * np.arange(len(kids)) + 1, 2 * np.arange(len(kids)) + 2
        fe, sp, kid, h = np.zeros(n, dtype="int64"), np.full(n, np.nan), np.arange(n), np.empty(n)
        fe[at[kids]], sp[at[kids]], kid[at[kids]] = np.asarray(t["feature"])[kids], np.asarray(t["split"])[kids], at[left[kids]]
        h[at] = np.asarray(t["height"])
        packs.append((fe, sp, kid, h, t["depth"]))          # a leaf's split is no number: nothing is beyond it, it leads to itself
    out, step = np.empty(len(X)), max(1, WALK // len(forest))
    for i in range(0, len(X), step):
        rows = np.where(np.isnan(X[i:i + step]), np.inf, X[i:i + step])         # on the right of every split, as no number is
        base, flat, heights = np.arange(len(rows)) * rows.shape[1], rows.ravel(), np.empty((len(rows), len(packs)))
        for j, (fe, sp, kid, h, depth) in enumerate(packs):
            node = np.zeros(len(rows), dtype="int64")
            for _ in range(depth):
                node = kid.take(node) + (flat.take(base + fe.take(node)) >= sp.take(node))
            heights[:, j] = h.take(node)
        out[i:i + step] = np.power(2.0, -heights.mean(axis=1) / c)
    return out


def _fourier(d: int, n_features: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(d, n_features))
    return W, rng.uniform(0.0, 2 * np.pi, size=n_features)


def _lift(X: np.ndarray, W: np.ndarray, b: np.ndarray) -> np.ndarray:
    Z = X @ W
    Z += b
    np.cos(Z, out=Z)
    Z *= np.sqrt(2.0 / W.shape[1])
    return Z


def _packed(X: DataFrame, cols: list) -> DataFrame:
    """(__g, __n, __d, block): the numbers of a part of a group as one row, ``PACKS`` parts a task, checkpointed."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"__g": pdf["__g"].iloc[:1], "__n": pdf["__n"].iloc[:1], "__d": pdf["__d"].iloc[:1],
                             "block": [pdf[cols].to_numpy(dtype="float64").tobytes()]})
    packs = X.select("__g", "__part", "__n", "__d", *cols).groupBy("__g", "__part").applyInPandas(
        pack, "__g long, __n long, __d int, block binary").checkpoint()
    tasks = max(X.sparkSession.sparkContext.defaultParallelism, math.ceil(packs.count() / PACKS))
    return packs.repartition(tasks).checkpoint()


def _kernel(n: int, total: float, squares: float, nonzero: np.ndarray, d: int) -> tuple[np.ndarray, float]:
    """The columns a group's SVM looks at, of which ``d`` vary, and its gamma by the 'scale' rule."""
    kept = np.flatnonzero(nonzero) if d < len(nonzero) else np.arange(len(nonzero))
    m = n * len(kept)
    var = squares / m - (total / m) ** 2 if m else 0.0
    return kept, 1.0 / (len(kept) * var) if var > 0 else 1.0


class _Steps:
    """Subgradient steps of one group: what it needs of its rows comes in as sums over all of them."""

    def __init__(self, n: int, gamma: float, kept: np.ndarray, cfg):
        self.n, self.gamma, self.kept, self.cfg, self.w, self.rho, self.t, self.done = n, gamma, kept, cfg, None, 0.0, 0, cfg.steps == 0

    def take(self, count: int, violators: np.ndarray) -> None:
        if self.w is None:                  # start at the mean embedding
            self.w = violators / self.n
            return
        eta = 1.0 / (self.t + 2)
        move = eta * (self.w - violators / (self.cfg.nu * self.n))
        self.w, self.rho, self.t = self.w - move, self.rho - eta * (count / (self.cfg.nu * self.n) - 1.0), self.t + 1
        self.done = self.t >= self.cfg.steps or bool(np.linalg.norm(move) <= 2e-3 * np.linalg.norm(self.w))

    def sums(self, Z: np.ndarray) -> tuple[int, np.ndarray]:
        if self.w is None:
            return len(Z), Z.sum(axis=0)
        bad = Z @ self.w < self.rho
        return int(bad.sum()), Z[bad].sum(axis=0)


def _svms(X: DataFrame, cols: list, cfg, alone: int = ALONE, wave: int = WAVE) -> DataFrame:
    """(__g, gamma, w, kept), trained on every row of each group."""
    packs, spark = _packed(X, cols), X.sparkSession
    schema = "__g long, gamma double, w array<double>, kept array<int>"
    open_ = lambda raw: np.frombuffer(raw).reshape(-1, len(cols))
    row = lambda g, s: (int(g), float(s.gamma), s.w.tolist(), s.kept.tolist())

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        A = np.concatenate([open_(x) for x in pdf["block"]])
        kept, gamma = _kernel(len(A), A.sum(), (A * A).sum(), A.any(axis=0), int(pdf["__d"].iloc[0]))
        s, Z = _Steps(len(A), gamma, kept, cfg), _lift(A[:, kept], *_fourier(len(kept), cfg.n_features, gamma, cfg.seed))
        while s.w is None or not s.done:
            s.take(*s.sums(Z))
        return pd.DataFrame([row(pdf["__g"].iloc[0], s)], columns=["__g", "gamma", "w", "kept"])
    out = packs.where(F.col("__n") <= alone).groupBy("__g").applyInPandas(train, schema)

    def first(batches):
        for pdf in batches:
            for g, raw in zip(pdf["__g"], pdf["block"], strict=True):
                A = open_(raw)
                yield pd.DataFrame({"__g": [g], "s": [A.sum()], "ss": [(A * A).sum()], "nz": [A.any(axis=0).astype(int).tolist()]})
    large = packs.where(F.col("__n") > alone)
    sizes = large.groupBy("__g").agg(F.first("__n").alias("n"), F.first("__d").alias("d")).orderBy("__g").collect()      # a row per large group
    for i in range(0, len(sizes), wave):
        state, own = {}, large.where(F.col("__g").isin([r["__g"] for r in sizes[i:i + wave]]))
        stats = own.mapInPandas(first, "__g long, s double, ss double, nz array<int>").groupBy("__g").agg(
            F.sum("s").alias("s"), F.sum("ss").alias("ss"), *[F.max(F.col("nz")[j]).alias(f"z{j}") for j in range(len(cols))])
        seen = {r["__g"]: r for r in stats.collect()}
        for r in sizes[i:i + wave]:
            st = seen[r["__g"]]
            kept, gamma = _kernel(r["n"], st["s"], st["ss"], np.array([st[f"z{j}"] for j in range(len(cols))]), r["d"])
            state[r["__g"]] = _Steps(r["n"], gamma, kept, cfg)
        while going := {g: s for g, s in state.items() if s.w is None or not s.done}:
            def step(batches, going=going):
                sums, kernels = {}, {}
                for pdf in batches:
                    for g, raw in zip(pdf["__g"], pdf["block"], strict=True):
                        s = going[g]
                        if g not in kernels:
                            kernels[g] = _fourier(len(s.kept), cfg.n_features, s.gamma, cfg.seed)
                        count, acc = s.sums(_lift(open_(raw)[:, s.kept], *kernels[g]))
                        sums[g] = (sums[g][0] + count, sums[g][1] + acc) if g in sums else (count, acc)
                yield pd.DataFrame([(int(g), c, a.tolist()) for g, (c, a) in sums.items()], columns=["__g", "count", "acc"])
            found: dict = {}
            for r in own.where(F.col("__g").isin(list(going))).mapInPandas(step, "__g long, count long, acc array<double>").collect():
                found.setdefault(r["__g"], []).append(r)
            for g, rows in found.items():
                state[g].take(sum(r["count"] for r in rows), np.sum([r["acc"] for r in rows], axis=0))
        out = out.unionByName(spark.createDataFrame([row(g, s) for g, s in state.items()], schema))
    return out


def _components(X: DataFrame, cols: list, cfg) -> DataFrame:
    """(__g, mean, axes, width): the leading eigenvectors of each group's covariance, flattened."""
    d = len(cols)

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        A = pdf[cols].to_numpy(dtype="float64")
        return pd.DataFrame({"__g": [pdf["__g"].iloc[0]], "n": [len(A)], "width": [int(pdf["__d"].iloc[0])],
                             "s": [A.sum(axis=0).tolist()], "c": [(A.T @ A).ravel().tolist()]})

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = pdf["n"].sum(), np.sum(pdf["s"].tolist(), axis=0)
        C = np.sum(pdf["c"].tolist(), axis=0).reshape(d, d) / n - np.outer(s, s) / n ** 2
        width = int(pdf["width"].iloc[0])
        k = max(1, min(cfg.code_size, math.ceil(width / 2), width))
        P = np.linalg.eigh(C)[1][:, ::-1][:, :k]
        return pd.DataFrame({"__g": [pdf["__g"].iloc[0]], "mean": [(s / n).tolist()], "axes": [P.ravel().tolist()], "width": [width]})
    parts = X.groupBy("__g", "__part").applyInPandas(gram, "__g long, n long, width int, s array<double>, c array<double>")
    return parts.groupBy("__g").applyInPandas(axes, "__g long, mean array<double>, axes array<double>, width int")


def fit_detectors_per_group(df: DataFrame, group: str, id_col: str, columns: list, config: DetectorConfig | None = None,
                            rows_per_task: int = 20_000) -> DataFrame:
    """One row per input row: group, id, a vote (1 normal, -1 anomaly) of each model in ``config.models``, ensemble.

    ``id_col`` is a whole number, unique in its group.  Values that are missing or no number count as 0.  Rows without a
    group form none and get no vote.  A group in which nothing varies is normal throughout.  An empty table gives an empty table.
    """
    cfg = config or DetectorConfig()
    ensure_checkpoint_dir(df.sparkSession)
    cols = [f"x{i}" for i in range(len(columns))]
    parts = F.ceil(F.col("__n") / rows_per_task).cast("int")
    X = prepare(df.where(F.col(group).isNotNull()), group, id_col, columns)
    X = X.withColumn("__part", F.pmod(F.xxhash64(id_col), parts).cast("int")).withColumn("__row", F.monotonically_increasing_id())
    X = X.checkpoint()
    names = [m for m in ensemble.DEFAULT_MODEL_ORDER if m in cfg.models]
    kind = X.schema[id_col].dataType.simpleString()
    if X.isEmpty():
        return X.select(group, id_col, *[F.lit(1).alias(m) for m in [*names, "ensemble"]])
    row_wise = [m for m in names if m != "dbscan"]
    made = {"isolation_forest": lambda: grown_forests(X, cols, id_col, cfg.isolation_forest),
            "one_class_svm": lambda: _svms(X, cols, cfg.one_class_svm),
            "autoencoder": lambda: _components(X, cols, cfg.autoencoder)}
    models = X.groupBy("__g").agg(F.first("__n").alias("__n")).select("__g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"))
    for m in row_wise:
        models = models.join(made[m](), "__g")

    def score(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ["__g", id_col, *row_wise]})
        A, m, out = rows[cols].to_numpy(dtype="float64"), model.iloc[0], {"__g": rows["__g"], id_col: rows[id_col]}
        if "isolation_forest" in row_wise:
            out["isolation_forest"] = -walk(A, m["forest"])
        if "one_class_svm" in row_wise:
            kept = np.asarray(m["kept"], dtype=int)
            svm = cfg.one_class_svm
            score = _lift(A[:, kept], *_fourier(len(kept), svm.n_features, m["gamma"], svm.seed)) @ np.asarray(m["w"])
            out["one_class_svm"] = np.round(score, 12)          # equal rows score the same wherever they stand in a part
        if "autoencoder" in row_wise:
            P, R = np.asarray(m["axes"]).reshape(len(cols), -1), A - np.asarray(m["mean"])
            R = R - (R @ P) @ P.T
            out["autoencoder"] = (R * R).sum(axis=1) / max(int(m["width"]), 1)
        return pd.DataFrame(out)
    schema = ", ".join(["__g long", f"`{id_col}` {kind}", *[f"{m} double" for m in row_wise]])
    models = models.withColumnsRenamed({"__g": "__mg", "__part": "__mpart"})
    scored = X.groupBy("__g", "__part").cogroup(models.groupBy("__mg", "__mpart")).applyInPandas(score, schema).checkpoint()
    limits = {"isolation_forest": cfg.isolation_forest.contamination, "one_class_svm": cfg.one_class_svm.nu, "autoencoder": cfg.autoencoder.percentile / 100.0}
    rows = scored
    for m in row_wise:          # one number per group
        bar = exact_quantiles(rows, m, [limits[m]], by=["__g"], names=[f"__{m}"])
        scored = scored.join(bar, "__g")
    away = {"isolation_forest": lambda: F.col("isolation_forest") < F.col("__isolation_forest"),
            "one_class_svm": lambda: F.col("one_class_svm") < F.col("__one_class_svm"),
            "autoencoder": lambda: F.col("autoencoder") > F.col("__autoencoder")}
    votes = scored.select("__g", id_col, *[F.when(away[m](), -1).otherwise(1).alias(m) for m in row_wise])
    if "dbscan" in names:
        apart = F.col("__place").cast("double") * (4 * cfg.dbscan.eps)
        place = X.select("__g").distinct().withColumn("__place", F.dense_rank().over(Window.orderBy("__g")))     # one row per group
        V = X.join(place, "__g").select("__row", F.array(*cols, apart).alias("features"))
        found = fit_dbscan(V, "__row", cfg.dbscan.eps, cfg.dbscan.min_samples).labels
        noise = X.select("__g", id_col, "__row").join(found.select(F.col("id").alias("__row"), "cluster"), "__row").select(
            "__g", id_col, F.when(F.col("cluster") == -1, -1).otherwise(1).alias("dbscan"))
        votes = votes.join(noise, ["__g", id_col])
    names_of = X.select("__g", group).distinct()
    out = ensemble.with_ensemble(votes, names, cfg.ensemble.voting, list(cfg.ensemble.weights))
    return out.join(names_of, "__g").select(group, id_col, *names, "ensemble")
