"""Counts and links between the units of DBSCAN, block against block, for any number of columns.

A unit is a point of a sparse cell, or a dense cell as its box with one of its points (``rep``).  Units are dealt by
a tree of median cuts to blocks of ``BYTES`` at most; a block travels as one row of packed numbers and a task holds two.
Inside, parts of ``boxjoin.BLOCK`` units meet only if their boxes do.  Neighbours are counted and links merged where they are
found, so what leaves a task is a row per unit or per pair of components, never the pairs within the distance.  A point whose own part
or block already shows enough neighbours looks no further, and parts that are one component are not compared again.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators.detect.boxjoin import BLOCK, SAMPLE, _cuts, _gap2, _leaf_of, _parts

BYTES, FEWEST = 8 << 20, 16     # of a block, and the blocks that a table is cut into where they are large enough
ROWS = 2048                     # units looked at together against the parts of a block
FIELDS = "block long, blo array<double>, bhi array<double>, points int, starts array<int>, u binary, w binary, wr binary, rep binary, lo binary, hi binary"


def _near2(x: np.ndarray, y: np.ndarray, e2: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` lie within the distance; those near the bar are summed column by column."""
    mid = x.mean(axis=0)
    a, b = x - mid, y - mid
    scale = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    sq = scale - 2.0 * (a @ b.T)
    near = sq <= e2
    i, j = np.nonzero(np.abs(sq - e2) <= 1e-11 * scale)
    for s in range(0, len(i), 8192):
        p, q = i[s:s + 8192], j[s:s + 8192]
        out = np.zeros(len(p))
        for c in range(x.shape[1]):
            g = x[p, c] - y[q, c]
            out += g * g
        near[p, q] = out <= e2
    return near


def _span2_all(alo, ahi, blo, bhi) -> np.ndarray:
    out = np.zeros((len(alo), len(blo)))
    for j in range(alo.shape[1]):
        g = np.maximum(bhi[None, :, j] - alo[:, None, j], ahi[:, None, j] - blo[None, :, j])
        out += g * g
    return out


def packed_blocks(units: DataFrame, n: int, d: int) -> DataFrame:
    """``units`` (u, w, wr, dense, rep, lo, hi) as blocks: points first, then dense cells, each in parts of ``BLOCK``."""
    size = max(BLOCK, min(BYTES // (8 * (d + 3)), math.ceil(n / FEWEST)))
    take = units.select("rep") if n <= SAMPLE else units.select("rep").where(F.rand(7) < SAMPLE / n)
    nodes = _cuts(np.array([r[0] for r in take.limit(SAMPLE).collect()], dtype="float64").reshape(-1, d), max(1, math.ceil(n / size)))

    def deal(batches):
        for pdf in batches:
            pdf["leaf"] = _leaf_of(np.stack(pdf["rep"].to_numpy()), nodes) if len(pdf) else np.zeros(0, dtype=np.int64)
            yield pdf

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, lo, hi = (np.stack(pdf[c].to_numpy()) for c in ("rep", "lo", "hi"))
        dense, leaf, rows = pdf["dense"].to_numpy(dtype=bool), int(pdf["leaf"].iloc[0]), []
        cols = {c: pdf[c].to_numpy(dtype="int64") for c in ("u", "w", "wr")}
        for k, p in enumerate(_parts(rep, size)):
            kinds = [p[~dense[p]], p[dense[p]]]
            parts = [g[q] for g in kinds if len(g) for q in _parts(rep[g], BLOCK)]
            at, box = np.concatenate(parts), kinds[1][:0] if not len(kinds[1]) else np.concatenate([q for q in parts if dense[q[0]]])
            rows.append(((leaf << 32) + k, lo[p].min(axis=0).tolist(), hi[p].max(axis=0).tolist(), len(kinds[0]),
                         np.cumsum([0] + [len(q) for q in parts]).tolist(), *[cols[c][at].tobytes() for c in ("u", "w", "wr")],
                         rep[at].tobytes(), lo[box].tobytes(), hi[box].tobytes()))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])
    schema = "u long, w long, wr long, dense boolean, rep array<double>, lo array<double>, hi array<double>"
    dealt = units.select("u", "w", "wr", "dense", "rep", "lo", "hi").mapInPandas(deal, schema + ", leaf long")
    return dealt.groupBy("leaf").applyInPandas(pack, FIELDS).checkpoint()


def near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """(block, block2): blocks whose boxes lie within ``eps``, each pair once and each block with itself."""
    outer = blocks.select("block", "blo", "bhi")
    gap = F.zip_with(F.zip_with("blo2", "bhi", lambda x, y: x - y), F.zip_with("blo", "bhi2", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    meet = F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v) <= eps * eps
    return outer.join(outer.toDF("block2", "blo2", "bhi2"), (F.col("block") <= F.col("block2")) & meet).select("block", "block2").checkpoint()


def _over(blocks: DataFrame, pairs: DataFrame, work, schema: str) -> DataFrame:
    tasks, rows = max(1, min(4096, pairs.count())), blocks.drop("blo", "bhi")
    sides = []
    for mine, key, key2 in (("k1", "k1", "k2"), ("l2", "l1", "l2")):       # own names: the two sides are one table
        side = rows.toDF(*[f"{mine}_{c}" for c in rows.columns])
        side = side.join(pairs.toDF(key, key2), F.col(f"{mine}_block") == F.col(mine))
        sides.append(side.repartition(tasks, key, key2).groupBy(key, key2))
    return sides[0].cogroup(sides[1]).applyInPandas(work, schema)


def _open(pdf: pd.DataFrame) -> SimpleNamespace:
    r = pdf.iloc[0]
    b = SimpleNamespace(**{c: np.frombuffer(r[c], dtype=np.int64) for c in ("u", "w", "wr")}, points=int(r["points"]))
    b.id = int(r["block"])
    n, st = len(b.u), np.asarray(r["starts"], dtype=np.int64)
    b.rep = np.frombuffer(r["rep"]).reshape(n, -1)
    d = b.rep.shape[1]
    b.lo, b.hi = b.rep.copy(), b.rep.copy()
    if b.points < n:
        b.lo[b.points:], b.hi[b.points:] = (np.frombuffer(r[c]).reshape(-1, d) for c in ("lo", "hi"))
    b.parts = [(int(s), int(e), b.lo[s:e].min(axis=0), b.hi[s:e].max(axis=0)) for s, e in zip(st[:-1], st[1:], strict=True)]
    for c in ("core", "probe", "comp"):         # given as unit numbers, and a component for each core
        if c in pdf.columns:
            setattr(b, c, np.asarray(r[c] if r[c] is not None else [], dtype=np.int64))
    if hasattr(b, "core"):
        by = np.argsort(b.core, kind="stable")
        b.is_core = np.isin(b.u, b.core)
        b.is_core[b.points:] = True
        if hasattr(b, "comp"):
            b.label = np.full(n, -1, dtype=np.int64)
            b.label[b.is_core] = b.comp[by][np.searchsorted(b.core[by], b.u[b.is_core])]
    return b


def _boxes(b) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p[2] for p in b.parts]), np.array([p[3] for p in b.parts])


def _touching(a, b, e2: float):
    """Parts (s, e) of ``a`` and (t, f) of ``b`` whose boxes lie within the distance; one order only inside one block."""
    near = _gap2(*_boxes(a), *_boxes(b)) <= e2 * (1 + 1e-12)
    if a is b:
        near &= np.tri(len(a.parts), dtype=bool).T
    for k, j in zip(*np.nonzero(near), strict=True):
        yield *a.parts[k][:2], *b.parts[j][:2]


def _beside_parts(p, rows: np.ndarray, q, e2: float):
    """Units ``rows`` of ``p`` and each part (t, f) of ``q`` whose box they lie near, ``ROWS`` units at a time."""
    lo, hi = _boxes(q)
    for i in range(0, len(rows), ROWS):
        at = rows[i:i + ROWS]
        near = _gap2(p.rep[at], p.rep[at], lo, hi) <= e2 * (1 + 1e-12)
        for j in np.flatnonzero(near.any(axis=0)):
            yield at[near[:, j]], *q.parts[j][:2]


def _pair(one: pd.DataFrame, two: pd.DataFrame) -> tuple:
    a, b = ({c[3:]: pdf[c] for c in pdf.columns if c[2:3] == "_"} for pdf in (one, two))
    first = _open(pd.DataFrame(a))
    return (first, first) if a["block"].iat[0] == b["block"].iat[0] else (first, _open(pd.DataFrame(b)))


def _add(p, rows: np.ndarray, q, t: int, f: int, sums: np.ndarray, e2: float) -> None:
    """Adds what points ``rows`` of ``p`` find in the part (t, f) of ``q`` to their ``sums``."""
    if t < q.points:
        sums[:2, rows] += _near2(p.rep[rows], q.rep[t:f], e2) @ q.w[t:f]
        return
    gap = _gap2(p.rep[rows], p.rep[rows], q.lo[t:f], q.hi[t:f]) <= e2
    full = gap & (_span2_all(p.rep[rows], p.rep[rows], q.lo[t:f], q.hi[t:f]) <= e2)
    some = gap & ~full
    sums[0, rows] += full @ q.w[t:f]
    sums[2, rows] += some.sum(axis=1)
    sums[1, rows] += full @ q.w[t:f] + (some & _near2(p.rep[rows], q.rep[t:f], e2)) @ q.wr[t:f]


def _alone(blocks: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each block, over as many tasks as there are blocks."""
    return blocks.repartition(max(1, min(4096, blocks.count())), "block").groupBy("block").applyInPandas(work, schema)


def counts(blocks: DataFrame, pairs: DataFrame, eps: float, enough: int | None = None) -> DataFrame:
    """(block, u, k, least, crossing) for every point unit: the weight of points and whole dense cells within ``eps``, that
    weight with the points known in cells which the distance crosses, and the number of these cells.

    With ``enough``, a point whose ``least`` has reached it stops there: its numbers may then be smaller than the whole."""
    e2, bar = eps * eps, math.inf if enough is None else enough
    names = ["block", "u", "k", "least", "crossing"]
    schema = "block long, u long, k long, least long, crossing long"

    def rows_of(x, rows, sums):
        return pd.DataFrame({"block": x.id, "u": x.u[rows], **{c: v[rows] for c, v in zip(names[2:], sums, strict=True)}}, columns=names)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        a = _open(pdf)
        sums = np.zeros((3, len(a.u)), dtype=np.int64)
        own = np.zeros(len(a.u), dtype=np.int64)
        for s, e, *_ in a.parts:            # the own part first: it decides most points
            own[s:e] = s
            if s < a.points:
                _add(a, np.arange(s, e), a, s, e, sums, e2)
        left = np.flatnonzero(sums[1, :a.points] < bar)
        for rows, t, f in _beside_parts(a, left, a, e2):
            rows = rows[(own[rows] != t) & (sums[1, rows] < bar)]
            if len(rows):
                _add(a, rows, a, t, f, sums, e2)
        return rows_of(a, np.arange(a.points), sums)

    def across(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        a, b = _pair(one, two)
        made = [pd.DataFrame({c: [] for c in names}, dtype="int64")]
        for p, q in ((a, b), (b, a)):
            sums, left = np.zeros((3, len(p.u)), dtype=np.int64), np.flatnonzero(np.isin(p.u[:p.points], p.probe))
            for rows, t, f in _beside_parts(p, left, q, e2):
                rows = rows[sums[1, rows] < bar]
                if len(rows):
                    _add(p, rows, q, t, f, sums, e2)
            made.append(rows_of(p, left[sums[:, left].any(axis=0)], sums))
        return pd.concat(made, ignore_index=True)
    first = _alone(blocks, inside, schema).checkpoint()
    more = first if enough is None else first.where(F.col("least") < enough)
    open_ = more.groupBy("block").agg(F.collect_list("u").alias("probe")).checkpoint()
    given, some = blocks.join(open_, "block", "left"), open_.select("block")
    apart = pairs.where("block <> block2").join(some.withColumn("one", F.lit(True)), "block", "left").join(
        some.select(F.col("block").alias("block2"), F.lit(True).alias("two")), "block2", "left")
    apart = apart.where("one or two").select("block", "block2").checkpoint()
    return first.unionByName(_over(given, apart, across, schema)).groupBy("block", "u").agg(*[F.sum(c).alias(c) for c in names[2:]])


def crossed_cells(blocks: DataFrame, pairs: DataFrame, probe: DataFrame, eps: float) -> DataFrame:
    """(u, n): the points ``probe`` (block, u) and each dense cell that the distance crosses."""
    e2 = eps * eps

    def work(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        a, b = _pair(one, two)
        made = [pd.DataFrame({"u": [], "n": []}, dtype="int64")]

        def beside(p, s, e, c, t, f):
            at = s + np.flatnonzero(np.isin(p.u[s:e], p.probe))
            if len(at):
                i, j = np.nonzero((_gap2(p.rep[at], p.rep[at], c.lo[t:f], c.hi[t:f]) <= e2)
                                  & (_span2_all(p.rep[at], p.rep[at], c.lo[t:f], c.hi[t:f]) > e2))
                made.append(pd.DataFrame({"u": p.u[at[i]], "n": c.u[t + j]}))
        for s, e, t, f in _touching(a, b, e2):
            if s < a.points and t >= b.points:
                beside(a, s, e, b, t, f)
            elif s >= a.points and t < b.points:
                beside(b, t, f, a, s, e)
        return pd.concat(made, ignore_index=True)
    given = blocks.join(probe.groupBy("block").agg(F.collect_list("u").alias("probe")), "block", "left")
    return _over(given, pairs, work, "u long, n long")


class _Sets:
    """Disjoint sets over 0..n-1; the least number is the root."""

    def __init__(self, n: int):
        self.up, self.joined = np.arange(n), 0

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[x] = r
        return r

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            while self.up[i] != i:
                i = self.up[i]
            while self.up[j] != j:
                j = self.up[j]
            if i != j:
                self.up[max(i, j)] = min(i, j)
                self.joined += 1


def _merge(sets: _Sets, x: np.ndarray, y: np.ndarray, near: np.ndarray) -> None:
    """Joins the sets of ``x[i]`` and ``y[j]`` wherever ``near[i, j]``."""
    i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(i):
        return
    near, x, y = near[np.ix_(i, j)], x[i], y[j]
    row = np.arange(len(x))
    while True:
        col = np.where(near, row[:, None], len(x)).min(axis=0)
        new = np.minimum(row, np.where(near, col[None, :], len(x)).min(axis=1))
        new = new[new]
        if (new == row).all():
            break
        row = new
    sets.join(x, x[row])
    sets.join(y, x[col])


def _core_parts(x) -> dict:
    """The core units of each part that has any, by the part's begin."""
    return {s: s + np.flatnonzero(x.is_core[s:e]) for s, e, *_ in x.parts if x.is_core[s:e].any()}


def _box(x, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.lo[rows].min(axis=0), x.hi[rows].max(axis=0)


def _unlike(x: np.ndarray, y: np.ndarray):
    """Numbers of rows of ``x`` and of ``y`` that hold every pair of unequal ones; the commonest value meets no other of its own."""
    names, n = np.unique(np.concatenate([x, y]), return_counts=True)
    i, j = x != names[n.argmax()], y != names[n.argmax()]
    if i.any():
        yield np.flatnonzero(i), np.arange(len(y))
    if j.any() and not i.all():
        yield np.flatnonzero(~i), np.flatnonzero(j)


def _near_part(x, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, e2: float) -> np.ndarray:
    """Which units ``rows`` of ``x`` have a box near the box of a part."""
    return _gap2(x.lo[rows], x.hi[rows], lo[None], hi[None])[:, 0] <= e2 * (1 + 1e-12)


def _link(a, b, la, lb, sets: _Sets, e2: float) -> None:
    """Joins the sets ``la`` and ``lb`` of the core units of two blocks by their points ``rep``."""
    ca, cb = _core_parts(a), _core_parts(b)
    most = len(np.unique(np.concatenate([la[a.is_core], lb[b.is_core]]))) - 1          # joins that make one set of all
    one: dict = {}              # parts whose units are one set, which stays so
    for s, e, t, f in _touching(a, b, e2):
        if sets.joined >= most:
            return
        if s not in ca or t not in cb:
            continue
        i, j = ca[s], cb[t]
        x, y = (sets.roots(l[k][:1] if one.get((n, p)) else l[k]) for l, k, n, p in ((la, i, 0, s), (lb, j, 1, t)))
        one[0, s], one[1, t] = x.min() == x.max(), y.min() == y.max()
        if one[0, s] and one[1, t] and x[0] == y[0]:
            continue
        x, y = (np.broadcast_to(v, len(k)) for v, k in ((x, i), (y, j)))
        for u, v in _unlike(x, y):
            u = u[_near_part(a, i[u], *_box(b, j[v]), e2)]
            v = v[_near_part(b, j[v], *_box(a, i[u]), e2)] if len(u) else v
            if len(u) and len(v):
                _merge(sets, sets.roots(x[u]), sets.roots(y[v]), _near2(a.rep[i[u]], b.rep[j[v]], e2))


def with_cores(blocks: DataFrame, core: DataFrame, eps: float) -> DataFrame:
    """``blocks`` with their core units (``core``: block, u) and the component of each inside its block, named by a unit."""
    e2 = eps * eps

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        a = _open(pdf)
        sets = _Sets(len(a.u))
        at = np.arange(len(a.u))
        _link(a, a, at, at, sets, e2)
        k = np.flatnonzero(a.is_core)
        return pdf.assign(core=[a.u[k].tolist()], comp=[a.u[sets.roots(k)].tolist()])
    given = blocks.join(core.groupBy("block").agg(F.collect_list("u").alias("core")), "block", "left")
    return _alone(given, work, FIELDS + ", core array<long>, comp array<long>").checkpoint()


def links(blocks: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """(a, b, border) from ``with_cores``: pairs of components that a link joins, as few as join them inside a pair of blocks;
    and, where ``border``, a point that is no core with each core point unit within ``eps``."""
    e2 = eps * eps

    def work(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        a, b = _pair(one, two)
        made = [pd.DataFrame({"a": [], "b": []}, dtype="int64").assign(border=False)]
        if a is not b:
            names, code = np.unique(np.concatenate([a.label, b.label]), return_inverse=True)
            sets = _Sets(len(names))
            _link(a, b, code[:len(a.u)], code[len(a.u):], sets, e2)
            at = np.arange(len(names))
            up = sets.roots(at)
            moved = up != at
            made.append(pd.DataFrame({"a": names[moved], "b": names[up[moved]]}).assign(border=False))
        for p, q in ((a, b), (b, a))[:1 if a is b else 2]:
            cores = _core_parts(q)
            for i, t, _ in _beside_parts(p, np.flatnonzero(~p.is_core), q, e2):
                if t in cores and t < q.points:
                    x, y = np.nonzero(_near2(p.rep[i], q.rep[cores[t]], e2))
                    made.append(pd.DataFrame({"a": p.u[i[x]], "b": q.u[cores[t][y]]}).assign(border=True))
        return pd.concat(made, ignore_index=True)
    return _over(blocks, pairs, work, "a long, b long, border boolean")


def open_pairs(blocks: DataFrame, pairs: DataFrame, whole: DataFrame, eps: float) -> DataFrame:
    """(c, n): core units of different components ``whole`` (block, u, comp), one a dense cell at least, whose boxes lie within
    ``eps`` though their points ``rep`` don't."""
    e2 = eps * eps

    def work(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        a, b = _pair(one, two)
        made = [pd.DataFrame({"c": [], "n": []}, dtype="int64")]
        ca, cb = _core_parts(a), _core_parts(b)
        span = lambda x, k: (x.label[k].min(), x.label[k].max())
        la, lb = {s: span(a, k) for s, k in ca.items()}, {t: span(b, k) for t, k in cb.items()}
        if len({v for x in (*la.values(), *lb.values()) for v in x}) < 2:
            return made[0]
        for s, e, t, f in _touching(a, b, e2):
            if (s < a.points and t < b.points) or s not in ca or t not in cb or len({*la[s], *lb[t]}) < 2:
                continue
            i, j = ca[s], cb[t]
            for u, v in _unlike(a.label[i], b.label[j]):
                u = u[_near_part(a, i[u], *_box(b, j[v]), e2)]
                v = v[_near_part(b, j[v], *_box(a, i[u]), e2)] if len(u) else v
                if len(u) and len(v):
                    iu, jv = i[u], j[v]
                    x, y = np.nonzero((a.label[iu][:, None] != b.label[jv][None, :]) & (_gap2(a.lo[iu], a.hi[iu], b.lo[jv], b.hi[jv]) <= e2))
                    made.append(pd.DataFrame({"c": a.u[iu[x]], "n": b.u[jv[y]]}))
        return pd.concat(made, ignore_index=True)
    lists = whole.groupBy("block").agg(F.collect_list(F.struct("u", "comp")).alias("__l"))
    given = blocks.drop("core", "comp").join(lists.select("block", F.col("__l.u").alias("core"), F.col("__l.comp").alias("comp")), "block", "left")
    return _over(given, pairs, work, "c long, n long")
