"""Supervised forests M12-M16, split T10, metrics A36 (MLlib pipelines).

Splits hash a row key, so a row lands on the same side however the table
is partitioned or recomputed (``randomSplit`` depends on partition order).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.session import ensure_checkpoint_dir

# The reference's grid (depth 'unlimited' becomes MLlib's maximum, 30).
GRID_TREES = [100, 200, 300]
GRID_DEPTH = [30, 10, 20, 30]
GRID_MIN_SPLIT = [2, 5, 10]


FEW_ROWS, MOST_ROWS = 10_000, 250_000   # rows of a training task: enough to start one for, and its bound


def spread_rows(df: DataFrame, key: str, n: int, parts: int) -> DataFrame:
    """Training rows over the cores, ``MOST_ROWS`` a task at most: a forest keeps a count per tree for each row and
    reads all of them in every pass.  ``n`` rows in ``parts`` partitions that are enough, or that are few, stay as they are;
    others are dealt by a hash of ``key`` and sorted, so that the same rows are drawn in every run."""
    need = max(math.ceil(n / MOST_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / FEW_ROWS)))
    return df if parts >= need else df.repartition(need, key).sortWithinPartitions(key)


def hash_split(df: DataFrame, key: str, test_fraction: float = 0.3, seed: int = 42) -> tuple:
    """(train, test) by xxhash64 of the key."""
    u = (F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).cast("double")
         / F.lit(float(2 ** 63)))
    tagged = df.withColumn("__u", u)
    return (tagged.where(F.col("__u") >= test_fraction).drop("__u"),
            tagged.where(F.col("__u") < test_fraction).drop("__u"))


def forest_pipeline(df: DataFrame, features: Sequence[str], target: str, num_trees: int = 100,
                    max_depth: int = 30, min_instances: int = 1, seed: int = 42) -> Pipeline:
    """Index text columns (sorted order, as label encoding), assemble,
    random forest.  The target is indexed too; it must not be a feature (D17).

    Codes enter the forest as ordinals, as a label encoder's do: as categories
    MLlib would refuse a column with more levels than ``maxBins``."""
    features = [c for c in features if c != target]
    stages, cols = [], []
    for c in features:
        if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType)):
            stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                                        handleInvalid="keep"))
            # arithmetic drops the indexer's nominal metadata
            stages.append(SQLTransformer(statement=f"SELECT *, (`{c}__idx` + 0.0D) AS `{c}__ord` FROM __THIS__"))
            cols.append(f"{c}__ord")
        else:
            cols.append(c)
    stages.append(StringIndexer(inputCol=target, outputCol="__label", stringOrderType="alphabetAsc"))
    stages.append(VectorAssembler(inputCols=cols, outputCol="__fv", handleInvalid="keep"))
    stages.append(RandomForestClassifier(featuresCol="__fv", labelCol="__label", numTrees=num_trees,
                                         maxDepth=max_depth, minInstancesPerNode=min_instances, seed=seed,
                                         maxBins=64))
    return Pipeline(stages=stages)


def prepare_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn(target, F.col(target).cast("string")).where(F.col(target).isNotNull())


def train_forest(df: DataFrame, features: Sequence[str], target: str, key: str, test_fraction: float = 0.3,
                 num_trees: int = 100, seed: int = 42, max_depth: int = 30) -> dict:
    """Fit on the train side; accuracy on the test side,
    importances per feature.  Returns model, accuracy, importances, test predictions."""
    ensure_checkpoint_dir(df.sparkSession)
    data = prepare_target(df, target).checkpoint()          # every stage of the pipeline and the test read it
    train, test = hash_split(data, key, test_fraction, seed)
    train = spread_rows(train, key, train.count(), data.rdd.getNumPartitions())
    model = forest_pipeline(data, features, target, num_trees, max_depth=max_depth, seed=seed).fit(train)
    pred = model.transform(test)
    acc = MulticlassClassificationEvaluator(labelCol="__label", predictionCol="prediction",
                                           metricName="accuracy").evaluate(pred)
    return {"model": model, "accuracy": acc, "importances": importances(model, df.sparkSession),
            "predictions": pred}


def importances(model: PipelineModel, spark) -> DataFrame:
    """Feature importances of the fitted forest (one row per feature)."""
    rf = model.stages[-1]
    names = model.stages[-2].getInputCols()
    vals = rf.featureImportances.toArray()
    rows = [(n.removesuffix("__ord"), float(v)) for n, v in zip(names, vals)]
    return spark.createDataFrame(rows, "feature string, importance double")


def grid_search(df: DataFrame, features: Sequence[str], target: str, key: str, folds: int = 5,
                trees=GRID_TREES, depths=GRID_DEPTH, min_splits=GRID_MIN_SPLIT, test_fraction: float = 0.2,
                seed: int = 42, parallelism: int = 4) -> dict:
    """Cross-validated grid over trees x depth x minimum split
    (``min_samples_split`` maps to ``minInstancesPerNode``, an approximation)."""
    data = prepare_target(df, target)
    train, test = hash_split(data, key, test_fraction, seed)
    pipe = forest_pipeline(data, features, target, seed=seed)
    rf = pipe.getStages()[-1]
    grid = (ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, sorted(set(depths)))
            .addGrid(rf.minInstancesPerNode, list(min_splits)).build())
    ev = MulticlassClassificationEvaluator(labelCol="__label", predictionCol="prediction", metricName="accuracy")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, seed=seed,
                        parallelism=parallelism)
    cvm = cv.fit(train)
    best = cvm.bestModel
    return {"model": best, "accuracy": ev.evaluate(best.transform(test)),
            "importances": importances(best, df.sparkSession), "avg_metrics": list(cvm.avgMetrics)}


def save_model(model: PipelineModel, path: str) -> None:
    """K3."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
