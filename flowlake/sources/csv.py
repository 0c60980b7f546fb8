"""CSV sources S1, S2 and schema routing.

Types are inferred only at the edge (S1); known layouts get explicit
schemas so no inference pass runs over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.schemas import KDD_SCHEMA, LABELLED_COLUMNS, TRAFFIC_LOG_COLUMNS


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = True) -> DataFrame:
    """CSV with header; inferred types unless a schema is given.
    NaN text becomes NULL (pandas treats both as missing)."""
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    return nan_to_null(df)


def read_kdd(spark: SparkSession, path: str) -> DataFrame:
    """Headerless KDD table with its 43 named columns."""
    return spark.read.option("header", False).schema(KDD_SCHEMA).csv(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark orders NaN above all numbers; the reference treats it as missing."""
    from pyspark.sql import types as T
    return df.select(*[
        F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def detect_schema(df: DataFrame) -> str:
    """P1: 'labelled' | 'traffic_log' | 'generic' from column presence only
    (no job is launched)."""
    cols = set(df.columns)
    if all(c in cols for c in LABELLED_COLUMNS):
        return "labelled"
    if all(c in cols for c in TRAFFIC_LOG_COLUMNS):
        return "traffic_log"
    return "generic"
