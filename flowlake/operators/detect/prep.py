"""M1: prepare a table for the detectors.

Numeric columns only (P3), missing / NaN / infinite -> 0 (P5), zero-variance
columns dropped (P16), robust scaling (x - median) / IQR with IQR 0 -> 1
(F14).  The fitted model keeps the column list and the scaler, so scoring a
new batch uses the same width as training (D6).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators.encode import clean_number
from flowlake.operators.profile import numeric_columns
from flowlake.operators.quantiles import exact_quantiles


@dataclass
class PrepModel:
    columns: list
    medians: list
    scales: list

    def transform(self, df: DataFrame, out: str = "features", keep: tuple = ()) -> DataFrame:
        """Append the scaled feature array; ``keep`` columns pass through
        (missing fitted columns count as 0)."""
        cols = []
        for c, m, s in zip(self.columns, self.medians, self.scales):
            src = clean_number(F.col(f"`{c}`")) if c in df.columns else F.lit(0.0)
            cols.append((src - F.lit(float(m))) / F.lit(float(s)))
        return df.select(*[F.col(f"`{k}`") for k in keep], F.array(*cols).alias(out))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> PrepModel:
        return PrepModel(**json.loads(text))


def fit_prep(df: DataFrame, exclude: tuple = (), target_col: str | None = None) -> PrepModel:
    """Fit M1 on ``df``.  Two aggregates (variances, then grouped exact
    quantiles); only d numbers per statistic reach the driver."""
    cols = [c for c in numeric_columns(df) if c not in exclude and c != target_col]
    if not cols:
        raise ValueError("no numeric columns to model")
    from pyspark import StorageLevel
    # the statistics read the cleaned columns four times: keep them once
    clean = df.select(*[clean_number(F.col(f"`{c}`")).alias(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_clean(clean, cols)
    finally:
        clean.unpersist()


def _fit_clean(clean: DataFrame, cols: list) -> PrepModel:
    var = clean.agg(*[F.var_samp(F.col(f"`{c}`")).alias(c) for c in cols]).first()
    kept = [c for c in cols if var[c] is None or var[c] != 0]
    if not kept:
        raise ValueError("every numeric column is constant")
    long = clean.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in kept])).alias("s")
    ).select("s.column", "s.value")
    q = {r["column"]: r for r in exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"],
                                                 names=["q1", "med", "q3"]).collect()}  # d rows
    meds, scales = [], []
    for c in kept:
        r = q[c]
        iqr = r["q3"] - r["q1"]
        meds.append(float(r["med"]))
        scales.append(float(iqr) if iqr != 0 else 1.0)
    return PrepModel(kept, meds, scales)
