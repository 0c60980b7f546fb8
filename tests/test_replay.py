"""ST2, ST5, ST7: replay in numbered batches, training first, and analysis on a clock."""

from pyspark.sql import functions as F

from flowlake.operators import order
from flowlake.operators.detect.detector import DetectorConfig
from flowlake.plans.models import PACKET_FEATURES
from flowlake.plans.packets import packets_from_events
from flowlake.plans.registry import table
from flowlake.plans.security import _lists
from flowlake.session import prepare
from flowlake.streaming import monitor

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r.batch_id, r.alert_type, r.n, r.details, tuple(x.packet_id for x in r.examples)) for r in df.collect())


def test_replay_equals_batch_scoring_and_survives_a_restart(spark):
    prepare(spark)
    p = packets_from_events(table(spark, SF, "events"))
    landed, one, two = (monitor.scratch_path(spark, n) for n in ("landed", "one", "two"))
    monitor.land_batches(p, landed, size=100, batches_per_file=2)
    schema = p.schema.add("replay_batch", "long")
    rows = spark.read.schema(schema).parquet(landed)
    assert {r["count"] for r in rows.groupBy("replay_batch").count().collect()} == {100}
    m, t = _lists(spark)
    cfg = DetectorConfig(models=("isolation_forest",))
    det = monitor.replay(spark, landed, schema, one, monitor.scratch_path(spark, "ck"), config=cfg, malicious=m, tor=t,
                         features=PACKET_FEATURES, files_per_trigger=2)
    got = rows_of(monitor.read_replay_alerts(spark, one))
    numbered = order.batch_numbers(p, ["ts", "packet_id"], 100)
    want = []
    for b in range(10):
        want += rows_of(monitor.batch_alerts(numbered.where(F.col("batch_id") == b).drop("batch_id"), b, det, m, t))
    assert got == sorted(want) and {r[1] for r in got} == {"anomaly", "threat"}

    # stopped in the middle: the first run fails on its third micro-batch, the second goes on from there
    ck, calls = monitor.scratch_path(spark, "ck2"), []
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)

    def failing(batch, n):
        calls.append(n)
        if n == 2:
            raise RuntimeError("lost")
        monitor.alerts_by_batch(batch, det, m, t).withColumnRenamed("batch_id", "replay_batch").write.mode("overwrite").parquet(f"{two}/run={n}")
    try:
        monitor.run_available_now(files, failing, ck)
    except Exception:  # noqa: BLE001 - the loss is the point
        pass
    assert calls == [0, 1, 2]
    monitor.replay(spark, landed, schema, two, ck, detector=det, malicious=m, tor=t, files_per_trigger=1)
    assert rows_of(monitor.read_replay_alerts(spark, two)) == got


def test_analysis_on_a_clock(spark):
    path, out, ck = (monitor.scratch_path(spark, n) for n in ("clock", "out", "ck3"))
    spark.range(9).repartition(3).write.parquet(path)
    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path)
    seen = monitor.run_every(s, lambda b, n: monitor.write_batch(b.withColumn("batch_id", F.lit(n)), out, n), ck, every="1 second",
                             until=lambda p: p["batchId"] >= 2)
    assert [p["batchId"] for p in seen] == [0, 1, 2] and sum(p["numInputRows"] for p in seen) == 9
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(9))
    assert not spark.streams.active


def test_correlation_of_many_columns_with_gaps(spark):
    import numpy as np
    import pandas as pd
    from flowlake.operators.profile import correlation_matrix
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 60)) @ rng.normal(size=(60, 60)) + 1e6
    pdf = pd.DataFrame(base, columns=[f"c{i}" for i in range(60)]).mask(rng.random((400, 60)) < 0.1)
    pdf["flat"], pdf["gone"] = 5.0, np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in pdf.columns))
    got = correlation_matrix(df).toPandas().pivot(index="column_a", columns="column_b", values="corr")
    want = pdf.corr()
    assert got.shape == (62, 62)
    live = [c for c in pdf.columns if c not in ("flat", "gone")]
    assert np.allclose(got.loc[live, live].to_numpy(dtype=float), want.loc[live, live].to_numpy(), atol=1e-9)
    assert got.loc["flat"].isna().all() and got["gone"].isna().all()


def test_last_rows_are_a_state_of_constant_size(spark):
    import random
    path, out, ck = (monitor.scratch_path(spark, n) for n in ("ring", "ring-out", "ring-ck"))
    ids = list(range(500))
    random.Random(1).shuffle(ids)
    rows = [(i, i // 3) for i in ids]
    spark.createDataFrame(rows, "packet_id long, ts long").repartition(5).write.parquet(path)
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    keep = monitor.recent_writer(out, n=40)
    monitor.run_available_now(s, lambda b, k: (keep(b, k), keep(b, k)), ck)       # each batch twice, as when it is retried
    assert sorted(r.packet_id for r in monitor.recent_rows(spark, out, schema).collect()) == list(range(460, 500))
    assert spark.read.parquet(out).count() == 80
