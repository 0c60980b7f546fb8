"""Plans over the detectors: a detector that fails ends the plan, it does not leave a smaller ensemble."""

import pytest
from pyspark.sql import functions as F

from flowlake.operators.detect import ocsvm
from flowlake.operators.detect.detector import AnomalyDetector, DetectorConfig
from flowlake.plans import PLANS, load_all


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])
    spark.range(300).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 23).alias("user_id"), F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") * 37 % 101 / 3).alias("value"), F.format_string('{"k": %d}', F.col("id") * 13 % 100).alias("props"),
    ).write.parquet(f"{d}/events.parquet")
    return d


def test_detector_ensemble_has_every_detector_or_fails(spark, events, monkeypatch):
    load_all()
    out = PLANS["detector_ensemble"](spark, events)
    assert out.columns == ["packet_id", "isolation_forest", "one_class_svm", "autoencoder", "ensemble"] and out.count() == 300

    def broken(*a, **k):
        raise ValueError("planted failure")
    monkeypatch.setattr(ocsvm, "fit_ocsvm", broken)
    with pytest.raises(RuntimeError, match="one_class_svm .ValueError: planted failure"):
        PLANS["detector_ensemble"](spark, events)


def test_fit_still_records_failures(spark, monkeypatch):
    monkeypatch.setattr(ocsvm, "fit_ocsvm", lambda *a, **k: 1 / 0)
    df = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    m = AnomalyDetector(DetectorConfig(models=("isolation_forest", "one_class_svm"))).fit(df, "id")
    assert m.model_names == ["isolation_forest"] and "ZeroDivisionError" in m.failures["one_class_svm"]
    with pytest.raises(RuntimeError, match="one_class_svm"):
        m.complete()
