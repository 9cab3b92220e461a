"""Conformance suites: files of groups of a schema and its tests, as a table, and their results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators.udf import evaluator
from sievemark.plans.catalog import SchemaCatalog
from sievemark.plans.errors import SchemaError

CASES = "file string, grp string, description string, dialect string, schema string, data string, valid boolean"


def cases(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """One row per test of the JSON files below ``path``."""

    def rows(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for file, text in zip(batch["file"], batch["text"]):
                for group in json.loads(text):
                    out += [(file, group["description"], t["description"], dialect, json.dumps(group["schema"]), json.dumps(t["data"]), t["valid"]) for t in group["tests"]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CASES.split(", ")])

    files = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))
    return files.mapInPandas(rows, CASES)


def run(table: DataFrame, remotes: dict | None = None, **options) -> DataFrame:
    """``table`` with the verdict (found) and whatever kept a case from one (error)."""
    shared = SchemaCatalog(**options)
    for uri, schema in (remotes or {}).items():
        shared.register(schema, uri)
    spec = shared.spec()

    def check(batches):
        for batch in batches:
            found, error = [], []
            for dialect, schema, data in zip(batch["dialect"], batch["schema"], batch["data"]):
                try:
                    own = SchemaCatalog.from_spec(spec)
                    uri = own.register(json.loads(schema), "https://suite.example/case", dialect)
                    found.append(evaluator(own.spec()).is_valid(uri, json.loads(data)))
                    error.append(None)
                except SchemaError as e:
                    found.append(None)
                    error.append(type(e).__name__)
            yield batch.assign(found=found, error=error)

    return table.mapInPandas(check, CASES + ", found boolean, error string")
