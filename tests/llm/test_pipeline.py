import random

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from flowlake.llm import secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered_as_one_query():
    q = __spark_entry__.queries()
    assert "pipeline" in q and sum(name.startswith("op") and name[2].isdigit() for name in q) == 13
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "mixing"]


def tables(spark, path):
    rng = random.Random(11)
    w = lambda n: " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(20))
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        docs.append((i, w(60) + (" vile" if bad else ""), "en", f"s{i % 3}"))
        labels.append((i, 1, int(bad)))
    docs += [(1000 + i, docs[1][1], "en", "s1") for i in range(30)]                         # copies of 1
    docs += [(1100, docs[2][1] + " tail", "de", "s2"), (1101, item + " " + w(40), "en", "s1"), (1102, w(50) + " vile nasty", "en", "s0"),
             (1103, w(40) + " password=abcdef0123", "en", "s0"), (1104, None, None, None), (1105, "", "en", None), (None, w(20), "en", "s1"),
             (1106, docs[3][1], "en", "s1"), (1106, docs[3][1], "en", "s1"), (1107, w(40), "fr", "s9"), (1107, w(40), "fr", "s9")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    d.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return d


def test_stages_take_effect_and_keep_clean_documents(ready_spark, tmp_path):
    docs = tables(ready_spark, tmp_path)
    ids, kept = {}, docs
    for name, stage in P.STAGES[:-1]:
        out = stage(ready_spark, kept, str(tmp_path))
        assert out.columns == COLUMNS
        kept = ready_spark.createDataFrame(out.collect(), docs.schema)
        ids[name] = [r["doc_id"] for r in kept.collect()]
    q, n, d, s = (ids[x] for x, _ in P.STAGES[:-1])
    assert not [i for i in q if i is not None and i < 400 and i % 4 == 0] and 1102 not in q
    assert {i for i in range(400) if i % 4} <= set(q) and {1101, 1103, None} <= set(q)
    assert not set(range(1000, 1030)) & set(n) and {1, 2, 3, 1101, 1103, None} <= set(n) and not {1100, 1106} & set(n)
    # two unrelated texts under one id are two documents: both stay (one was lost before)
    assert n.count(1107) == 2 and all(n.count(i) == 1 for i in set(n) - {1107})
    assert set(n) - set(d) == {1101}
    assert sorted(map(str, s)) == sorted(map(str, d))
    masked = {r["doc_id"]: r["text"] for r in kept.collect()}[1103]
    assert masked.endswith(secret_scan.MASK) and "abcdef0123" not in masked
    mixed = P.STAGES[-1][1](ready_spark, kept, str(tmp_path))
    assert mixed.columns == [*COLUMNS, "epoch", "n_tokens"]
    assert {r["doc_id"] for r in mixed.collect()} <= set(s)


def test_run_equals_its_stages(ready_spark, tmp_path):
    docs = tables(ready_spark, tmp_path)
    one = sorted(map(str, P.run(ready_spark, str(tmp_path)).collect()))
    kept = docs
    for _, stage in P.STAGES:
        kept = stage(ready_spark, kept, str(tmp_path))
    assert one == sorted(map(str, kept.collect()))


def test_empty_table(ready_spark, tmp_path):
    docs = tables(ready_spark, tmp_path).limit(0)
    for _, stage in P.STAGES:
        docs = stage(ready_spark, docs, str(tmp_path))
    assert docs.count() == 0
