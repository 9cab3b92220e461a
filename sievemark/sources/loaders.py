"""Schema loaders for a catalog: each maps a URI to a schema, or to None."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def from_dict(schemas: dict[str, Any]) -> Callable[[str], Any]:
    return schemas.get


def from_folder(spark: SparkSession, prefix: str, folder: str) -> Callable[[str], Any]:
    """URIs below ``prefix`` are files below ``folder``, on any file system that Spark reads."""

    def load(uri: str) -> Any:
        if not uri.startswith(prefix):
            return None
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{uri[len(prefix):].lstrip('/')}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        return json.loads(spark.read.option("wholetext", True).text(path.toString()).first()[0])

    return load


def from_table(df: DataFrame, uri_col: str = "uri", schema_col: str = "schema") -> Callable[[str], Any]:
    """Schemas of a table, looked up by URI when they are asked for."""

    def load(uri: str) -> Any:
        row = df.where(df[uri_col] == uri).select(schema_col).first()
        return json.loads(row[0]) if row else None

    return load
