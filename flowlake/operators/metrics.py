"""Classification metrics (A36) and label rate.

Everything derives from one grouped count over (label, prediction): the
confusion table has classes^2 rows whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (df.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction"))
              .agg(F.count(F.lit(1)).alias("count")))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          zero_division: float = 0.0) -> DataFrame:
    """Per class precision, recall, F1, support; then 'accuracy',
    'macro avg' and 'weighted avg' rows.  ``zero_division`` fills 0/0."""
    cm = confusion(df, label, prediction)
    classes = (cm.select(F.col("label").alias("cls")).union(cm.select(F.col("prediction").alias("cls")))
                 .where(F.col("cls").isNotNull()).distinct())
    tp = cm.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("count").alias("tp"))
    sup = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("count").alias("support"))
    pred = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("count").alias("predicted"))
    t = (classes.join(tp, "cls", "left").join(sup, "cls", "left").join(pred, "cls", "left")
                .fillna(0, subset=["tp", "support", "predicted"]))
    zd = F.lit(float(zero_division))
    t = t.select(F.col("cls").alias("class"),
                 F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(zd).alias("precision"),
                 F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(zd).alias("recall"),
                 F.col("support").cast("long").alias("support"), F.col("tp"))
    t = t.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(zd))
    tot = t.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                F.sum(F.col("precision") * F.col("support")).alias("wp"),
                F.sum(F.col("recall") * F.col("support")).alias("wr"),
                F.sum(F.col("f1") * F.col("support")).alias("wf"))
    n = F.col("n")
    acc = tot.select(F.lit("accuracy").alias("class"), (F.col("tp") / n).alias("precision"),
                     (F.col("tp") / n).alias("recall"), (F.col("tp") / n).alias("f1"), n.cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), n.cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), (F.col("wp") / n).alias("precision"),
                          (F.col("wr") / n).alias("recall"), (F.col("wf") / n).alias("f1"), n.cast("long").alias("support"))
    cols = ["class", "precision", "recall", "f1", "support"]
    return t.select(*cols).unionByName(acc).unionByName(macro).unionByName(weighted)


def label_rate(df: DataFrame, label: str = "label") -> DataFrame:
    """Positives (label <> 0) and their share."""
    pos = F.col(label) != 0
    return df.agg(F.count_if(pos).alias("positives"), F.avg(pos.cast("double")).alias("rate"))
