import pytest
from pyspark.sql import functions as F

from flowlake.llm.common import ready

AWKWARD = ["", None, "   \n\t ", "a", "one two", "Straße ÄÖ 日本語 🙂 é", "x" * 200_000, "word " * 60_000]


@pytest.fixture(scope="session")
def ready_spark(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def make_docs(ready_spark):
    """Rows (doc_id, text) with columns whose names clash with those the operators make."""
    def make(rows):
        df = ready_spark.createDataFrame(rows, "doc_id long, text string")
        for name in ("n_words", "kept", "score", "node", "contaminated", "value", "spans", "tokens"):
            df = df.withColumn(name, F.lit("clash"))
        return df
    return make
