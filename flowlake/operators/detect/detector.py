"""Train every detector, score rows, explain, report.

``AnomalyDetector(config).fit(df, id_col)`` returns a ``DetectorModel``;
a model that fails to train is recorded in ``failures`` with its error
instead of being swallowed, and ``complete`` refuses such a model where the
result is meant to hold every detector.  ``transform`` scores any table with the
fitted columns and scaler and adds the ensemble vote.
"""

from __future__ import annotations

import traceback
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators import ensemble
from flowlake.operators.detect.prep import PrepModel, fit_prep
from flowlake.operators.supervised import spread_rows


@dataclass(frozen=True)
class IForestConfig:
    n_trees: int = 100
    max_samples: int = 256
    contamination: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class OcsvmConfig:
    nu: float = 0.1
    n_features: int = 128
    steps: int = 30
    seed: int = 42


@dataclass(frozen=True)
class DbscanConfig:
    eps: float = 0.5
    min_samples: int = 5


@dataclass(frozen=True)
class ReconConfig:
    code_size: int = 32
    percentile: float = 95.0


@dataclass(frozen=True)
class EnsembleConfig:
    voting: str = "soft"
    weights: tuple = (0.25, 0.25, 0.25, 0.25)


@dataclass(frozen=True)
class DetectorConfig:
    isolation_forest: IForestConfig = IForestConfig()
    one_class_svm: OcsvmConfig = OcsvmConfig()
    dbscan: DbscanConfig = DbscanConfig()
    autoencoder: ReconConfig = ReconConfig()
    ensemble: EnsembleConfig = EnsembleConfig()
    models: tuple = ("isolation_forest", "one_class_svm", "dbscan", "autoencoder")


def load_config(saved: dict) -> DetectorConfig:
    """The configuration from its ``dataclasses.asdict`` form (tuples come back from JSON as lists)."""
    parts = {"isolation_forest": IForestConfig, "one_class_svm": OcsvmConfig, "dbscan": DbscanConfig,
             "autoencoder": ReconConfig, "ensemble": EnsembleConfig}
    fixed = {k: parts[k](**{n: tuple(v) if isinstance(v, list) else v for n, v in saved[k].items()}) for k in parts}
    return DetectorConfig(**fixed, models=tuple(saved["models"]))


@dataclass
class DetectorModel:
    id_col: str
    prep: PrepModel
    models: dict = field(default_factory=dict)
    failures: dict = field(default_factory=dict)
    config: DetectorConfig = DetectorConfig()

    @property
    def model_names(self) -> list:
        return [m for m in ensemble.DEFAULT_MODEL_ORDER if m in self.models]

    def complete(self) -> DetectorModel:
        """This model if every configured detector was trained; else an error that names those that failed and why."""
        missing = [m for m in self.config.models if m not in self.models]
        if missing:
            raise RuntimeError("not trained: " + "; ".join(f"{m} ({self.failures.get(m, 'no error recorded').strip()})" for m in missing))
        return self

    def features(self, df: DataFrame) -> DataFrame:
        return self.prep.transform(df, keep=(self.id_col,))

    def transform(self, df: DataFrame) -> DataFrame:
        """(id, one prediction column per model, ensemble); -1 = anomaly.

        Row-wise scorers (forest, SVM, reconstruction) are chained as
        columns of one frame, so scoring adds no shuffle; only DBSCAN, whose
        answer comes from a join against its core points, is joined back."""
        X = self.features(df)
        out = X
        carried = [self.id_col, "features"]
        for name in self.model_names:
            if name == "dbscan":
                continue
            out = self.models[name].predict(out, keep=tuple(carried), out=name)
            carried.append(name)
        names = self.model_names
        out = out.select(self.id_col, *[n for n in names if n != "dbscan"])
        if "dbscan" in names:
            pred = self.models["dbscan"].predict(X, keep=(self.id_col,), out="dbscan")
            out = out.join(pred, self.id_col, "left")
        if names:
            out = ensemble.with_ensemble(out, names, self.config.ensemble.voting,
                                         list(self.config.ensemble.weights))
        return out.select(self.id_col, *names, *(["ensemble"] if names else []))

    def report(self, scored: DataFrame, df: DataFrame) -> dict:
        """Summary per model, agreement, feature gaps, recommendations
        (all DataFrames)."""
        names = self.model_names
        feats = self.features(df)
        cols = self.prep.columns
        wide = feats.select(self.id_col, *[F.col("features")[i].alias(c) for i, c in enumerate(cols)])
        joined = scored.join(wide, self.id_col)
        summary = ensemble.model_summary(scored, names + ["ensemble"])
        agree = ensemble.model_agreement(scored, names)
        gaps = ensemble.feature_gaps(joined, cols)
        recs = ensemble.recommendations(agree, summary, gaps)
        return {"summary": summary, "agreement": agree, "feature_gaps": gaps, "recommendations": recs}


class AnomalyDetector:
    def __init__(self, config: DetectorConfig | None = None):
        self.config = config or DetectorConfig()

    def fit(self, df: DataFrame, id_col: str, target_col: str | None = None) -> DetectorModel:
        from flowlake.operators.detect import dbscan, iforest, ocsvm, recon
        prep = fit_prep(df, exclude=(id_col,), target_col=target_col)
        model = DetectorModel(id_col, prep, config=self.config)
        X = prep.transform(df, keep=(id_col,)).persist(StorageLevel.MEMORY_AND_DISK)       # every trainer reads it several times
        cfg = self.config
        trainers = {
            "isolation_forest": lambda: iforest.fit_iforest(
                X, id_col, cfg.isolation_forest.n_trees, cfg.isolation_forest.max_samples,
                cfg.isolation_forest.contamination, cfg.isolation_forest.seed),
            "one_class_svm": lambda: ocsvm.fit_ocsvm(X, id_col, cfg.one_class_svm.nu, cfg.one_class_svm.n_features,
                                                     cfg.one_class_svm.steps, cfg.one_class_svm.seed),
            "dbscan": lambda: dbscan.fit_dbscan(X, id_col, cfg.dbscan.eps, cfg.dbscan.min_samples),
            "autoencoder": lambda: recon.fit_recon(X, code_size=cfg.autoencoder.code_size,
                                                   percentile=cfg.autoencoder.percentile, keep=(id_col,)),
        }
        try:
            for name in cfg.models:
                try:
                    model.models[name] = trainers[name]()
                except Exception as e:  # noqa: BLE001 - recorded, not swallowed
                    model.failures[name] = f"{type(e).__name__}: {e}\n{traceback.format_exc(limit=3)}"
        finally:
            X.unpersist()
        return model


def surrogate_importance(model: DetectorModel, df: DataFrame, num_trees: int = 100, seed: int = 42) -> DataFrame:
    """Random forest trained on the forest's labels (anomaly = 1);
    returns (feature, importance), largest first."""
    X = spread_rows(model.features(df), model.id_col, df.count(), df.sparkSession.sparkContext.defaultParallelism)
    lab = model.models["isolation_forest"].predict(X, keep=(model.id_col, "features"))     # features go along: no join back
    train = lab.select(array_to_vector("features").alias("fv"), F.when(F.col("isolation_forest") == -1, 1.0).otherwise(0.0).alias("label"))
    rf = RandomForestClassifier(featuresCol="fv", labelCol="label", numTrees=num_trees, seed=seed).fit(train)
    imp = rf.featureImportances.toArray()
    spark = df.sparkSession
    rows = [(c, float(v)) for c, v in zip(model.prep.columns, imp)]  # d rows
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def reconstruction_importance(model: DetectorModel, df: DataFrame) -> DataFrame:
    """Share of reconstruction error per feature."""
    shares = model.models["autoencoder"].per_feature_error(model.features(df))
    spark = df.sparkSession
    rows = [(c, float(v)) for c, v in zip(model.prep.columns, shares)]
    return spark.createDataFrame(rows, "feature string, error_share double")
