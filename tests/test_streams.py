"""Drained streams: results come as files of the shared folder, whole, in both modes and over several batches."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievemark.streaming.validation import drained, session_rates, validity_rates

SCHEMA = "id long, ts timestamp, valid boolean"


def _files(spark, path, parts: int = 3) -> str:
    for n in range(parts):
        rows = spark.range(n * 40, n * 40 + 40).select("id", F.timestamp_seconds(F.lit(1.7e9) + F.col("id") * 977).alias("ts"), (F.col("id") % 3 > 0).alias("valid"))
        rows.coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def _rows(df) -> list:
    return sorted(map(tuple, df.collect()))


def _shared(spark) -> Path:
    return Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))


@pytest.mark.parametrize("files", [1, 10])
def test_drained_complete(spark, tmp_path, files):
    path = _files(spark, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    before = set(_shared(spark).glob("sievemark-stream-*"))
    found, wanted = drained(session_rates(stream.withColumn("k", F.col("id") % 4), "ts", "k"), "complete"), session_rates(spark.read.parquet(path).withColumn("k", F.col("id") % 4), "ts", "k")
    assert found.inputFiles(), "results are files, not rows on the driver"
    assert found.columns == wanted.columns and _rows(found) == _rows(wanted)
    assert set(_shared(spark).glob("sievemark-stream-*")) <= before, "the stream's state goes when it ends"


@pytest.mark.parametrize("files", [1, 10])
def test_drained_append(spark, tmp_path, files):
    path = _files(spark, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    assert _rows(drained(stream)) == _rows(spark.read.parquet(path))
    closed = drained(validity_rates(stream, "ts", width="1 hour", late="20 hours"))
    last = spark.read.parquet(path).agg(F.max("ts")).first()[0]
    wanted = validity_rates(spark.read.parquet(path), "ts", width="1 hour").where(F.col("window.end") <= F.lit(last) - F.expr("INTERVAL 20 HOURS"))
    assert closed.inputFiles() and _rows(closed) == _rows(wanted) != []


def test_drained_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    found = drained(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    assert found.columns == ["id", "ts", "valid"] and found.count() == 0
