"""Validation of streams: stateless verdicts, a quarantine sink, windowed validity rates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievemark.engine import validate
from sievemark.plans.catalog import SchemaCatalog


def validity_rates(df: DataFrame, time_col: str, valid_col: str = "valid", width: str = "10 minutes", late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Counts of documents, valid and invalid ones, per tumbling window; works on streams and tables."""
    own = df.withWatermark(time_col, late) if df.isStreaming else df
    valid = F.coalesce(F.col(valid_col), F.lit(False))
    return own.groupBy(F.window(time_col, width), *(keys or [])).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_invalid"))


def session_rates(df: DataFrame, time_col: str, key: str, gap: str = "30 minutes", late: str = "1 hour", valid_col: str = "valid") -> DataFrame:
    """The same per session of each key."""
    own = df.withWatermark(time_col, late) if df.isStreaming else df
    return own.groupBy(key, F.session_window(time_col, gap)).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col(valid_col)).alias("n_valid"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local one only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sievemark-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root.rstrip('/')}/sievemark-{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives when all that is there now has been read, as a table.

    Batches are written by executors to the shared folder, so no result passes the driver. In complete
    mode each batch is a whole result, and the last one stands. The stream's own state goes when it ends.
    """
    spark = stream.sparkSession
    folder, state, written = shared_folder(spark, "drained"), shared_folder(spark, "stream"), []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        written.append(f"{folder}/{number}")

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(state)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(written[-1:] if mode == "complete" else written))


def quarantine(df: DataFrame, catalog: SchemaCatalog, uri: str, doc: str, good: str, bad: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Start a query that appends valid documents to ``good`` and the others to ``bad``.

    Each batch writes to folders of its own number and replaces them, so a batch that is run again
    after a failure leaves its rows once.
    """

    def split(batch: DataFrame, number: int) -> None:
        checked = validate(batch, catalog, uri, doc, "_valid", **options).persist()
        try:
            checked.where("_valid").drop("_valid").write.mode("overwrite").parquet(f"{good}/batch={number}")
            checked.where("_valid is null or not _valid").drop("_valid").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            checked.unpersist()

    writer = df.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
