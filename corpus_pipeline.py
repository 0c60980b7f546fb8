"""Training-corpus pipeline over the ``documents`` table, counted as part of the ``llm`` subpackage.

Five stages in order.  Each takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns the columns of ``documents`` (the last one adds epoch and n_tokens).  Between stages
the documents are written as Parquet and read again, so a lost executor costs
at most the running stage.

1. quality: documents that the classifier rejects (low quality or toxic) go.
2. near_dedup: one document of each group of near-duplicates stays, the one with the least doc_id;
   linked are texts whose 5-word shingles have a Jaccard of 0.8 or more (op10 alone has 3 words and 0.85).
   Texts that share a doc_id are judged apart: an unrelated one stays.
3. decontamination: documents with too much benchmark text go; the others stay untouched.
4. secrets: secrets are masked in the texts; every document stays.
5. mixing: documents are drawn to the target weights of the domain-language-source tree.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from flowlake.llm import decontaminate, mixing, near_dedup, quality, secret_scan  # noqa: E402
from flowlake.llm.common import Scratch, read, ready  # noqa: E402

#: the stage's rule; at k = 64 the half-sketch index misses a pair at 0.8 with a chance below 1e-7
NEAR = {"k": 64, "threshold": 80, "n_words": 5}

#: the classifier, its fit and its thresholds are not SQL
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cols = docs.columns
    return quality.classify(docs, read(ready(spark), sf_dir, "labels")).filter("keep").select(*[F.col(f"`{c}`") for c in cols])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return near_dedup.drop_near_duplicates(docs, **NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(ready(spark), sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.mix(docs, mixing.corpus_levels())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table."""
    docs = read(ready(spark), sf_dir, "documents")
    sc = Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = sc.keep(docs)
    return docs
