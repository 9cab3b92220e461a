"""Documents in and out: JSON lines, whole files, tables as documents, and a quarantine sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(doc) one JSON text a line, as written: member order and repeated members are kept."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).withColumnRenamed("value", "doc")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc) one JSON text a file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def parquet_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files in a folder, or of one file, which streams read by its folder and name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def as_documents(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(keys, doc): the columns of each row as one document."""
    return df.select(*keys, F.struct(*(columns or df.columns)).alias("doc"))


def as_variant(df: DataFrame, doc: str) -> DataFrame:
    return df.withColumn(doc, F.to_variant_object(doc))


def write_split(df: DataFrame, valid: str, good: str, bad: str, mode: str = "append") -> None:
    """Write valid rows to one place and all others to another."""
    df.where(F.col(valid)).drop(valid).write.mode(mode).parquet(good)
    df.where(~F.coalesce(F.col(valid), F.lit(False))).write.mode(mode).parquet(bad)
