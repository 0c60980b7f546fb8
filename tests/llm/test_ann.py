import numpy as np
from pyspark.sql import functions as F

from flowlake.llm import ann as A


def brute(rows, queries, k=5):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, qv in ok:
        if q in queries:
            s = sorted((-((v * qv).sum() / (np.sqrt((v * v).sum()) * np.sqrt((qv * qv).sum()))), i) for i, v in ok if i != q and len(v) == len(qv))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("d", F.lit(1))


def run(spark, rows, **kw):
    df = frame(spark, rows)
    out = {}
    for r in A.neighbours(df, df.filter("vec_id % 10 = 0"), **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def rows_of(n, d, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((8, d))
    return [(i, [float(np.float32(x)) for x in centre[i % 8] + 0.5 * rng.standard_normal(d)]) for i in range(n)]


def test_recall_and_scores_over_many_cells(ready_spark):
    rows = rows_of(1500, 16, 1)
    got = run(ready_spark, rows, points=200, sample=500)
    want = brute(rows, {i for i in range(0, 1500, 10)})
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit / (5 * len(want)) >= 0.98
    true = {q: dict(brute(rows, {q}, 10**6)[q]) for q in list(want)[:5]}
    assert all(abs(s - true[q][i]) < 1e-12 for q in true for i, s in got[q])


def test_copies_ties_and_unusable_vectors(ready_spark):
    base = rows_of(60, 6, 2)
    rows = base + [(100 + i, base[0][1]) for i in range(40)] + [(200 + i, [2 * x for x in base[0][1]]) for i in range(3)]
    rows += [(300, None), (310, []), (320, [0.0] * 6), (330, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan")] * 6), (350, [float("inf")] + [1.0] * 5),
             (None, base[1][1]), (360, [1.0, 2.0]), (0, base[0][1])]
    got, want = run(ready_spark, rows), brute(rows[:-1], set(range(0, 1000, 10)))
    assert got == {q: [(i, got[q][n][1]) for n, (i, _) in enumerate(v)] for q, v in want.items() if v}
    assert [i for i, _ in got[0]] == [100, 101, 102, 103, 104]


def test_few_or_no_rows(ready_spark):
    assert run(ready_spark, []) == {}
    assert run(ready_spark, [(0, [1.0, 0.0])]) == {}
    assert [i for i, _ in run(ready_spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])[0]] == [2, 1]


def test_chi_square():
    assert abs(A.chi2_cdf(20.09, 8) - 0.99) < 1e-4 and abs(A.chi2_quantile(0.999, 8) - 26.124) < 1e-2
