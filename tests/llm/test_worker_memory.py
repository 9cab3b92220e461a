"""Python workers outlive their tasks; between tasks they don't keep what the tasks took."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.llm import ngram_join, quality


def _kept(spark) -> int:
    """MB of the largest worker's own memory."""

    def run(batches):
        for _ in batches:
            pass
        with open("/proc/self/smaps_rollup") as f:
            kb = sum(int(line.split()[1]) for line in f if line.startswith("Anonymous:"))
        yield pa.RecordBatch.from_arrays([pa.array([kb // 1024])], names=["mb"])

    return max(r.mb for r in spark.range(0, 8, 1, 8).mapInArrow(run, "mb long").collect())


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="needs Linux")
def test_memory_is_given_back(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(700)), lambda k: F.conv(F.xxhash64("id", k).cast("string"), 10, 36)), " ")
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"))
    env = spark.sparkContext.environment
    env["SIEVEMARK_TEST"] = "memory"  # workers of its own
    try:
        before = _kept(spark)
        labels = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
        quality.keep_good(docs, labels).write.format("noop").mode("overwrite").save()
        docs.selectExpr("doc_id", "doc_id AS row", "text").mapInArrow(ngram_join.lean(ngram_join.first_pass), ngram_join.FIRST).write.format("noop").mode("overwrite").save()
        after = _kept(spark)
        assert after < before + 80
    finally:
        del env["SIEVEMARK_TEST"]
