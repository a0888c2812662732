import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns
    whose names the operators also use inside."""
    def make(rows, clash=True):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            from pyspark.sql import functions as F
            for i, name in enumerate(("score", "id", "size", "token", "shard", "_row", "n", "ids", "key")):
                df = df.withColumn(name, F.lit(i))
        return df
    return make
