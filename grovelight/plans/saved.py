"""A fitted set as a folder of tables with a manifest."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Raised when the tables of a manifest change.
VERSION = 1

Tables = Mapping[str, DataFrame]


def write(spark: SparkSession, path: str, about: dict, tables: Tables) -> None:
    """Write ``tables`` and then the manifest; an existing folder raises an error."""
    path = path.rstrip("/")
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    schemas = {name: table.schema.json() for name, table in tables.items()}
    manifest = json.dumps({"version": VERSION, "about": about, "schemas": schemas})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> tuple[dict, Tables]:
    """What the manifest says, and scans of the tables it names."""
    path = path.rstrip("/")
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()["value"])
    if manifest["version"] != VERSION:
        raise ValueError(f"saved by version {manifest['version']} of the format, this reads {VERSION}")
    tables = {
        name: spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{path}/{name}")
        for name, schema in manifest["schemas"].items()
    }
    return manifest["about"], tables
