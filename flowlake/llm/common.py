"""Shared plumbing of the text operators: session settings, written intermediates, the query registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.session import ensure_checkpoint_dir, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: rows in one Arrow batch: bounds what a Python worker holds of the texts at a time
BATCH_ROWS = 1000


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its DuckDB twin if there is one."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return deco


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Written tables in the shared checkpoint folder.

    ``keep(df)`` writes ``df`` as Parquet and reads it back: the lineage is
    cut and a lost executor costs nothing but the running stage.  ``free``
    deletes tables that no later result reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/t{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def free(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            p = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The narrow side of a join, broadcast if its counted rows are few; else a shuffle
    join, whose hot keys Spark splits.  For written tables: the count reads file footers."""
    return F.broadcast(df) if df.count() <= rows else df


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns of the input cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def others(df: DataFrame, *made: str) -> list[Column]:
    """The columns of ``df`` that an operator passes through: all but those it makes itself.

    Names that begin with two underscores are the operators' own.
    """
    return [F.col(f"`{c}`") for c in df.columns if c not in made and not c.startswith("__")]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, also inside lambdas, where Spark shares nothing."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array of longs, as one array of the same length.

    Two levels, so that an array of m values costs about m * block steps and
    not m * m: sums of blocks first, then each block from its own start.
    """
    none = F.array().cast("array<bigint>")

    def running(a: Column, start: Column) -> Column:
        return F.aggregate(
            a, F.struct(start.cast("long").alias("s"), none.alias("o")),
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o")))["o"]

    def cut(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * block + 1, F.lit(block)))

    def sums(blocks: Column) -> Column:
        return running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), lambda b: F.flatten(F.zip_with(b, sums(b), running))))
               .otherwise(none))
