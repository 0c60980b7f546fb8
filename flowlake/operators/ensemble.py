"""Ensemble and report operators: M7 (soft / hard vote), A26 (per-model
summary), A27 (agreement), A28 (feature gaps), F29 (recommendations).

Votes are columns of one row (-1 anomaly, 1 normal); every operator is a row
expression or one aggregate, so nothing depends on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference's ensemble and report rules.
DEFAULT_MODEL_ORDER = ["isolation_forest", "one_class_svm", "dbscan", "autoencoder"]
DEFAULT_WEIGHTS = [0.25, 0.25, 0.25, 0.25]
LOW_AGREEMENT = 0.7
HIGH_RATE_PCT = 20.0
LOW_RATE_PCT = 1.0
MSG_LOW_AGREEMENT = "Low model agreement detected. Consider reviewing feature engineering or model parameters."
MSG_HIGH_RATE = "High anomaly rate (%.1f%%) detected by %s. Review contamination parameters."
MSG_LOW_RATE = "Very low anomaly rate (%.1f%%) detected by %s. Consider adjusting sensitivity."
MSG_FOCUS = "Focus monitoring on these key distinguishing features: "


def soft_vote(models: Sequence[str], weights: Sequence[float] | None = None) -> F.Column:
    """Weighted mean of (vote + 1) / 2 over the models, > 0.5 -> 1 else -1.
    Weights are renormalised over the models given; a missing weight is 0.25."""
    models = list(models)
    w = list(weights or DEFAULT_WEIGHTS)
    w = [w[i] if i < len(w) else 0.25 for i in range(len(models))]
    tot = sum(w)
    score = sum(((F.col(m) + 1) / 2) * F.lit(wi / tot) for m, wi in zip(models, w))
    return F.when(score > 0.5, F.lit(1)).otherwise(F.lit(-1))


def hard_vote(models: Sequence[str]) -> F.Column:
    """Strict majority of normal votes -> 1, tie -> -1."""
    normal = sum(F.when(F.col(m) == 1, 1).otherwise(0) for m in models)
    anomal = sum(F.when(F.col(m) == -1, 1).otherwise(0) for m in models)
    return F.when(normal > anomal, F.lit(1)).otherwise(F.lit(-1))


def agreement(models: Sequence[str]) -> F.Column:
    """Per row: share of votes equal to the first model's vote."""
    first = F.col(models[0])
    return sum(F.when(F.col(m) == first, 1.0).otherwise(0.0) for m in models) / F.lit(float(len(models)))


def with_ensemble(df: DataFrame, models: Sequence[str], voting: str = "soft",
                  weights: Sequence[float] | None = None, out: str = "ensemble") -> DataFrame:
    """M7."""
    vote = soft_vote(models, weights) if voting == "soft" else hard_vote(models)
    return df.withColumn(out, vote)


def model_agreement(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean agreement over rows (one row)."""
    return df.agg(F.avg(agreement(models)).alias("model_agreement"))


def model_summary(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per model: anomalies, percentage, normal rows (long form)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).cast("int").alias("p")) for m in models])).alias("s"))
    return (stacked.groupBy(F.col("s.model").alias("model"))
                   .agg(F.count_if(F.col("s.p") == -1).alias("total_anomalies"),
                        F.count(F.lit(1)).alias("__n"))
                   .select("model", "total_anomalies",
                           (F.col("total_anomalies") * 100.0 / F.col("__n")).alias("anomaly_percentage"),
                           (F.col("__n") - F.col("total_anomalies")).alias("normal_samples")))


def feature_gaps(df: DataFrame, features: Sequence[str], pred: str = "ensemble", k: int = 10) -> DataFrame:
    """Mean of each feature over anomalies and over normal rows, the
    difference, and the k features with the largest absolute difference."""
    an, no = F.col(pred) == -1, F.col(pred) == 1
    one = df.agg(*[F.avg(F.when(an, F.col(f))).alias(f"a{i}") for i, f in enumerate(features)],
                 *[F.avg(F.when(no, F.col(f))).alias(f"n{i}") for i, f in enumerate(features)])
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"a{i}").alias("anomaly_mean"), F.col(f"n{i}").alias("normal_mean"))
        for i, f in enumerate(features)])).alias("s")).select("s.*")
    long = long.withColumn("difference", F.abs(F.col("anomaly_mean") - F.col("normal_mean")))
    return (long.where(F.col("difference").isNotNull())
                .orderBy(F.desc("difference"), F.asc("feature")).limit(k))


def recommendations(agree: DataFrame, summary: DataFrame, gaps: DataFrame) -> DataFrame:
    """rule rows (rec_order, recommendation); inputs are the one-row
    agreement, the per-model summary and the feature-gap table."""
    a = agree.where(F.col("model_agreement") < LOW_AGREEMENT).select(
        F.lit(0).alias("rec_order"), F.lit(MSG_LOW_AGREEMENT).alias("recommendation"))
    rate = F.col("anomaly_percentage")
    s = summary.where((rate > HIGH_RATE_PCT) | (rate < LOW_RATE_PCT)).select(
        (F.lit(1) + F.array_position(F.array(*[F.lit(m) for m in DEFAULT_MODEL_ORDER + ["ensemble"]]),
                                     F.col("model"))).cast("int").alias("rec_order"),
        F.when(rate > HIGH_RATE_PCT, F.format_string(MSG_HIGH_RATE, rate, F.col("model")))
         .otherwise(F.format_string(MSG_LOW_RATE, rate, F.col("model"))).alias("recommendation"))
    top3 = gaps.orderBy(F.desc("difference"), F.asc("feature")).limit(3)
    g = top3.agg(F.sort_array(F.collect_list(F.struct(-F.col("difference"), F.col("feature")))).alias("l")).where(
        F.size("l") > 0).select(
        F.lit(100).alias("rec_order"),
        F.concat(F.lit(MSG_FOCUS), F.array_join(F.transform("l", lambda x: x["feature"]), ", ")).alias("recommendation"))
    return a.unionByName(s).unionByName(g)
