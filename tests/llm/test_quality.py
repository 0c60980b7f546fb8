import random

import pytest
from pyspark.sql import functions as F

from flowlake.llm import quality as Q
from tests.llm.conftest import AWKWARD

BAD = ["vile", "awful", "nasty"]


def corpus(spark, n=900, seed=1, sites=None):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        host, path = rng.choice(sites or [("h1", "p1"), ("h1", "p2"), ("h2", "p1")])
        bad = rng.random() < 0.25
        ws = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(30, 90))]
        if bad and rng.random() < 0.5:
            ws = [w for w in ws[:12] for _ in range(6)]
        elif bad:
            ws[rng.randrange(len(ws))] = rng.choice(BAD)
        rows.append((i, " ".join(ws), path, host, 1))
        labels.append((i, 1, int(bad)) if rng.random() < 0.5 else (i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(ready_spark):
    docs, labels = corpus(ready_spark)
    out = Q.classify(docs, labels.filter("doc_id < 600"))
    truth = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    rows = out.join(truth, "doc_id").filter("doc_id >= 600").select("bad", "keep").collect()
    bad, good = [r for r in rows if r["bad"]], [r for r in rows if not r["bad"]]
    assert sum(not r["keep"] for r in bad) / len(bad) >= 0.9
    assert sum(r["keep"] for r in good) / len(good) >= 0.97


def test_sparse_sites_are_shrunk(ready_spark):
    from flowlake.llm.common import Scratch
    rows = [("big", "a", 2.0)] * 400 + [("big", "a", -2.0)] * 100 + [("other", "a", -2.0)] * 500 + [("big", "b", -6.0)] + [("tiny", "a", 4.0)] + [(None, None, 0.0)]
    rows += [(f"s{k}", "a", 2.0 if k % 3 else -2.0) for k in range(20) for _ in range(30)]
    df = ready_spark.createDataFrame(rows, "__host string, __path string, __z double")
    table, rate, strength = Q.sites(df, Scratch(ready_spark))
    q = {(r["__host"], r["__path"]): r["__q_h"] for r in table.collect()}
    assert len(q) == 25 and strength > 0
    own = {"big": 401 / 501, "tiny": 0.98}
    assert abs(q["big", "a"] - rate) > abs(q["tiny", "a"] - rate) / 2      # the single document moves its site less than its rate says
    assert rate < q["tiny", "a"] < own["tiny"] and q["other", "a"] < rate


def test_site_posterior_moves_a_borderline_document(ready_spark, monkeypatch):
    docs, labels = corpus(ready_spark, sites=[("good", "p")])
    worse = docs.filter("doc_id < 300").withColumn("source", F.lit("bad")).withColumn("text", F.concat("text", F.lit(" vile vile nasty")))
    both = docs.filter("doc_id >= 300").unionByName(worse).drop("score")
    lab = labels.filter("doc_id >= 300").unionByName(labels.filter("doc_id < 300").withColumn("toxic", F.lit(1)))
    r = {x["source"]: x["site_rate"] for x in Q.classify(both, lab).groupBy("source").agg(F.avg("site_rate").alias("site_rate")).collect()}
    assert r["bad"] > 0.8 > 0.5 > r["good"]


@pytest.mark.parametrize("how", ["none", "one class", "null"])
def test_without_labels_nothing_is_rejected(ready_spark, how):
    docs, labels = corpus(ready_spark, 40)
    lab = {"none": labels.limit(0), "one class": labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0)),
           "null": labels.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))}[how]
    assert Q.classify(docs, lab).filter("not keep").count() == 0


def test_awkward_rows(ready_spark):
    docs, labels = corpus(ready_spark, 300)
    rows = [(1000 + i, t, None, None) for i, t in enumerate(AWKWARD)] + [(None, "a b", "x", "y"), (1, "again", "p1", "h1"), (1, "again", "p1", "h1")]
    more = ready_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    both = docs.drop("score").unionByName(more)
    labels = labels.unionByName(ready_spark.createDataFrame([(None, 0, 1), (5, None, None), (6, 1, 0)], labels.schema))
    out = Q.classify(both, labels)
    assert out.count() == both.count() and out.filter("keep is null or score is null").count() == 0
    assert Q.classify(both.limit(0), labels).count() == 0
