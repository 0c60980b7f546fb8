"""Exact quantiles (linear interpolation, as pandas / DuckDB ``quantile_cont``)
without gathering a group's values in one task.

Spark's exact ``percentile`` merges a map of every distinct value in a single
final task per group, which does not survive a table of 100 TB.  Here:

1. one pass gives ``n`` and approximate bucket bounds per group
   (``percentile_approx``);
2. equal values are collapsed with a count (partial aggregation, so a value
   holding a third of all rows becomes one row);
3. bucket sizes give each bucket's first rank (tiny table);
4. only the buckets that hold a wanted rank are ranked exactly, by a window
   partitioned by (group, bucket).

For a bounded number of groups the same idea runs as three passes whose
small results (bounds, bucket sizes, the wanted values) come back to the
driver; otherwise it stays one lazy distributed plan.  A wanted bucket that
still holds more than ``refine_rows`` rows is cut again inside its own
range (one small aggregate per round) before its values are ranked, so
the final ranking never sorts more than ``refine_rows`` values in a task.
The lazy form cuts each wanted bucket once more by ranges of its distinct
values, so a task ranks about 1 / buckets^2 of a group.  Nothing that grows
with the rows is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_G = "__qgrp"


def bucket_of(value, bounds: Sequence[float]):
    """Number of ``bounds`` strictly below ``value``, as a binary-search
    CASE tree over literal bounds (depth log2 of the bound count, codegen'd)."""
    b = sorted(set(float(x) for x in bounds))

    def node(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(b[mid]), node(mid + 1, hi)).otherwise(node(lo, mid))
    return node(0, len(b)).cast("int"), b


def _below(bounds: str, value: str):
    """How many of the sorted ``bounds`` (1,023 at most) lie strictly below ``value``, by halving."""
    step = lambda at, s: F.when(F.get(bounds, at + s - 1) < F.col(value), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(9, -1, -1)]), F.lit(0), step)


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    by: Sequence[str] = (), buckets: int = 64,
                    names: Sequence[str] | None = None, max_groups: int = 10_000,
                    refine_rows: int = 2_000_000) -> DataFrame:
    """One row per group: ``by`` columns then one double column per prob.

    NULL values are ignored; a group without values has no row (without ``by``
    the one row holds NULLs).  With at
    most ``max_groups`` groups the three-pass form runs now (bounds and
    bucket counts come to the driver: groups x buckets numbers); beyond
    that the fully distributed lazy form is returned.
    """
    eager = _exact_quantiles_eager(df, value_col, probs, by, buckets, names, max_groups, refine_rows)
    if eager is not None:
        return eager
    return _exact_quantiles_lazy(df, value_col, probs, by, buckets, names)


def _exact_quantiles_eager(df, value_col, probs, by, buckets, names, max_groups, refine_rows=2_000_000):
    import math

    from pyspark.sql import types as T
    spark = df.sparkSession
    by = list(by)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    keys = by if by else [_G]
    base = df.select(*[F.col(c) for c in by], F.col(value_col).cast("double").alias("v"))
    if not by:
        base = base.withColumn(_G, F.lit(0))
    vals = base.where(F.col("v").isNotNull() & ~F.isnan("v"))
    fracs = [i / buckets for i in range(1, buckets)]
    # pass 1: approximate bounds and counts per group (bounded: checked below)
    rows = (vals.groupBy(*keys)
                .agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in fracs]), 10 * buckets).alias("bnd"),
                     F.count("v").alias("n"))
                .limit(max_groups + 1).collect())
    if len(rows) > max_groups:
        return None
    key_fields = [base.schema[k] for k in keys]
    out_schema = T.StructType([base.schema[c] for c in by] + [T.StructField(n, T.DoubleType()) for n in names])
    if not rows:
        empty = [tuple([None] * len(names))] if not by else []
        return spark.createDataFrame(empty, out_schema)
    if len(rows) <= 8:
        # literal bounds: one binary-search tree per group, chosen by key
        # (few groups keep the generated code small)
        expr = None
        for r in rows:
            tree, _ = bucket_of(F.col("v"), r["bnd"])
            cond = F.lit(True)
            for k in keys:
                cond = cond & (F.col(k) == F.lit(r[k]))
            expr = F.when(cond, tree) if expr is None else expr.when(cond, tree)
        tagged = vals.withColumn("bucket", expr)
    else:
        bschema = T.StructType(key_fields + [T.StructField("bnd", T.ArrayType(T.DoubleType()))])
        bdf = spark.createDataFrame([tuple(r[k] for k in keys) + ([float(x) for x in r["bnd"]],) for r in rows],
                                    bschema)
        tagged = (vals.join(F.broadcast(bdf), keys)      # one row per group, at most max_groups
                      .withColumn("bucket", _below("bnd", "v")).drop("bnd"))
    # pass 2: exact bucket sizes (groups x buckets rows)
    sizes: dict = {}
    for r in tagged.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("c")).collect():
        sizes.setdefault(tuple(r[k] for k in keys), {})[r["bucket"]] = r["c"]
    want = []        # (keys..., bucket, offset)
    plan = {}        # group -> list of (lo_ref, hi_ref, frac)
    for r in rows:
        g = tuple(r[k] for k in keys)
        n = r["n"]
        starts, acc = {}, 0
        for b in sorted(sizes.get(g, {})):
            starts[b] = acc
            acc += sizes[g][b]
        refs = []
        for p in probs:
            pos = p * (n - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            pair = []
            for rank in (lo, hi):
                b = max(bb for bb in starts if starts[bb] <= rank)
                want.append(g + (b, rank - starts[b]))
                pair.append((b, rank - starts[b]))
            refs.append((pair[0], pair[1], pos - lo))
        plan[g] = refs
    found: dict = {}
    # a wanted bucket larger than refine_rows is cut again inside its own
    # range until it is small; its value is then ranked on its own
    big = {w[:-1] for w in want if sizes[w[:-2]][w[-2]] > refine_rows}
    for w in sorted(set(want), key=str):
        g, b, off = w[:-2], w[-2], w[-1]
        if g + (b,) not in big:
            continue
        pred = F.lit(True)
        for k, v in zip(keys, g):
            pred = pred & (F.col(k) == F.lit(v))
        pred = pred & (F.col("bucket") == F.lit(b))
        size, value = sizes[g][b], None
        while size > refine_rows and value is None:
            sub = tagged.where(pred).select("v")
            sb = sub.agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in fracs]), 10 * buckets)).first()[0]
            sexpr, _ = bucket_of(F.col("v"), sb)
            acc, chosen = 0, None
            for s_, c_ in sorted((r[0], r[1]) for r in sub.groupBy(sexpr.alias("s")).count().collect()):
                if acc + c_ > off:
                    chosen = (s_, c_)
                    break
                acc += c_
            if chosen[1] < size:
                pred, off, size = pred & (sexpr == F.lit(chosen[0])), off - acc, chosen[1]
                continue
            # a value that fills the range: the rank lies below it, at it or above it
            v0 = sb[len(sb) // 2]
            below, at = sub.agg(F.count_if(F.col("v") < v0), F.count_if(F.col("v") == v0)).first()
            if off < below:
                pred, size = pred & (F.col("v") < v0), below
            elif off < below + at:
                value = v0
            else:
                pred, off, size = pred & (F.col("v") > v0), off - below - at, size - below - at
        if value is not None:
            found[w] = value
            continue
        vc = tagged.where(pred).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        wv = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)   # at most refine_rows values
        hit = (vc.withColumn("cend", F.sum("c").over(wv))
                 .where((F.col("cend") - F.col("c") <= F.lit(off)) & (F.lit(off) < F.col("cend"))).first())
        found[w] = hit["v"]
    rest = [w for w in set(want) if w[:-1] not in big]
    wschema = T.StructType(key_fields + [T.StructField("bucket", T.IntegerType()), T.StructField("off", T.LongType())])
    if rest:
        wdf = spark.createDataFrame(rest, wschema)
        # pass 3: rank the distinct values of the wanted buckets only
        inb = tagged.join(F.broadcast(wdf.select(*keys, "bucket").distinct()), keys + ["bucket"], "left_semi")
        vc = inb.groupBy(*keys, "bucket", "v").agg(F.count(F.lit(1)).alias("c"))
        wv = Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        vc = vc.withColumn("cend", F.sum("c").over(wv))
        hits = (vc.join(F.broadcast(wdf), keys + ["bucket"])
                  .where((F.col("cend") - F.col("c") <= F.col("off")) & (F.col("off") < F.col("cend")))
                  .select(*keys, "bucket", "off", "v").collect())
        found.update({tuple(h[k] for k in keys) + (h["bucket"], h["off"]): h["v"] for h in hits})
    out = []
    for r in rows:
        g = tuple(r[k] for k in keys)
        qs = []
        for (blo, olo), (bhi, ohi), frac in plan[g]:
            vlo, vhi = found[g + (blo, olo)], found[g + (bhi, ohi)]
            qs.append(vlo + (vhi - vlo) * frac)
        out.append((g if by else ()) + tuple(qs))
    return spark.createDataFrame(out, out_schema)


def _exact_quantiles_lazy(df: DataFrame, value_col: str, probs: Sequence[float],
                          by: Sequence[str] = (), buckets: int = 256,
                          names: Sequence[str] | None = None) -> DataFrame:
    """Fully distributed form (any number of groups), lazy."""
    by = list(by)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    keys = by if by else [_G]
    base = df.select(*[F.col(c) for c in by], F.col(value_col).cast("double").alias("v"))
    if not by:
        base = base.withColumn(_G, F.lit(0))
    vals = base.where(F.col("v").isNotNull() & ~F.isnan("v"))

    fracs = [i / buckets for i in range(1, buckets)]
    approx = vals.groupBy(*keys).agg(
        F.percentile_approx("v", F.array(*[F.lit(x) for x in fracs]), 10 * buckets).alias("bnd"),
        F.count("v").alias("n"))
    # the sketch may differ between evaluations; every branch below must
    # see the same bounds, so the (groups-sized) table is checkpointed once
    from flowlake.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    approx = approx.checkpoint()

    # distinct values with their counts, each tagged with its bucket
    vc = vals.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    ap = F.broadcast(approx) if not by else approx  # one row when there is no group
    vc = (vc.join(ap.select(*keys, "bnd"), keys)
            .withColumn("bucket", _below("bnd", "v"))
            .drop("bnd"))

    bsize = vc.groupBy(*keys, "bucket").agg(F.sum("c").alias("bn"))
    wb = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    bsize = bsize.withColumn("bstart", F.sum("bn").over(wb) - F.col("bn"))

    # wanted 0-based ranks: floor and ceil of p * (n - 1)
    tgt = approx.select(*keys, "n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)
    ])).alias("t")).select(*keys, "n", "t.qi", "t.p")
    tgt = tgt.withColumn("pos", F.col("p") * (F.col("n") - 1))
    tgt = tgt.withColumn("lo", F.floor("pos").cast("long")).withColumn("hi", F.ceil("pos").cast("long"))
    ranks = tgt.select(*keys, "qi", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("lo").alias("rank")),
        F.struct(F.lit(1).alias("side"), F.col("hi").alias("rank")))).alias("r")
    ).select(*keys, "qi", "r.side", "r.rank")
    ranks = (ranks.join(bsize, keys)
                  .where((F.col("rank") >= F.col("bstart")) & (F.col("rank") < F.col("bstart") + F.col("bn")))
                  .select(*keys, "qi", "side", "rank", "bucket", "bstart"))

    needed = ranks.select(*keys, "bucket").distinct()
    inb = vc.join(needed, keys + ["bucket"], "left_semi")
    # second level: cut each wanted bucket again by ranges of its distinct
    # values (bounds checkpointed), then rank only the wanted sub-bucket
    sb = (inb.groupBy(*keys, "bucket")
             .agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in fracs]), 10 * buckets).alias("sbnd"))
             .checkpoint())
    inb = (inb.join(sb, keys + ["bucket"])
              .withColumn("sub", _below("sbnd", "v")).drop("sbnd"))
    ssize = inb.groupBy(*keys, "bucket", "sub").agg(F.sum("c").alias("sn"))
    ws = Window.partitionBy(*keys, "bucket").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
    ssize = ssize.withColumn("sstart", F.sum("sn").over(ws) - F.col("sn"))     # <= buckets rows per bucket
    ranks = (ranks.join(ssize, keys + ["bucket"])
                  .where((F.col("rank") >= F.col("bstart") + F.col("sstart"))
                         & (F.col("rank") < F.col("bstart") + F.col("sstart") + F.col("sn")))
                  .withColumn("bstart", F.col("bstart") + F.col("sstart")).drop("sstart", "sn"))
    inb = inb.join(ranks.select(*keys, "bucket", "sub").distinct(), keys + ["bucket", "sub"], "left_semi")
    wv = Window.partitionBy(*keys, "bucket", "sub").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inb = inb.withColumn("cend", F.sum("c").over(wv))
    hit = (inb.join(ranks, keys + ["bucket", "sub"])
              .where((F.col("bstart") + F.col("cend") - F.col("c") <= F.col("rank"))
                     & (F.col("rank") < F.col("bstart") + F.col("cend")))
              .groupBy(*keys, "qi")
              .agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("vlo"),
                   F.max(F.when(F.col("side") == 1, F.col("v"))).alias("vhi")))
    res = (tgt.select(*keys, "qi", "pos", "lo").join(hit, keys + ["qi"], "left")
              .withColumn("q", F.col("vlo") + (F.col("vhi") - F.col("vlo")) * (F.col("pos") - F.col("lo"))))
    out = res.groupBy(*keys).agg(*[
        F.max(F.when(F.col("qi") == i, F.col("q"))).alias(nm) for i, nm in enumerate(names)])
    if not by:
        # a table without values still answers one row of NULLs
        one = df.sparkSession.range(1).select(F.lit(0).alias(_G))
        out = one.join(out, _G, "left").drop(_G)
    return out


def exact_quantile_value(df: DataFrame, value_col: str, prob: float) -> DataFrame:
    """One row, one column ``q``."""
    return exact_quantiles(df, value_col, [prob], names=["q"])


def quantile_values(df: DataFrame, value_col: str, probs: Sequence[float]) -> list:
    """Exact global quantiles as Python floats (one row to the driver).

    Thresholds used as literals keep the downstream plan small: a lazy
    quantile table joined back repeats the input's lineage in every branch."""
    from pyspark import StorageLevel
    names = [f"q{i}" for i in range(len(probs))]
    # the quantile plan reads its input several times; keep the one column
    # (often a model score) instead of recomputing it per branch
    src = df.select(value_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        row = exact_quantiles(src, value_col, probs, names=names).first()
    finally:
        src.unpersist()
    return [row[n] for n in names]
