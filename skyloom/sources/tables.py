"""Readers with declared schemas and guarded writers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = ("parquet", "csv", "json", "orc", "text", "binaryFile")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A file source; text formats need a schema, which is never inferred."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; known are {', '.join(READERS)}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} is read with a declared schema only")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def aliased(df: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """``df`` under fixed column names, each taken from the first of its candidates that exists."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, candidates in names.items():
        found = next((have[c.lower()] for c in candidates if c.lower() in have), None)
        if found is None:
            raise ValueError(f"none of {', '.join(candidates)} is a column; there are {', '.join(df.columns)}")
        out.append(F.col(found).alias(name))
    return df.select(*out)


def features(df: DataFrame) -> DataFrame:
    """(id, geometry, properties map) of rows with one GeoJSON feature each in ``value``."""
    shape = "type string, id string, geometry string, properties map<string,string>"
    x = F.from_json("value", shape)
    return df.select(x["id"].alias("id"), x["geometry"].alias("geometry"), x["properties"].alias("properties"))


def write(df: DataFrame, path: str, kind: str = "parquet", keys: Sequence[str] = (), columns: Sequence[str] | None = None, partition: Sequence[str] = (), notes: dict | None = None) -> None:
    """Writes a result only if it has the declared columns and unique keys; ``notes`` go beside it as JSON."""
    if columns is not None and list(columns) != df.columns:
        raise ValueError(f"the columns are {df.columns}, declared are {list(columns)}")
    if keys and not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} is not unique")
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).format(kind).save(path)
    if notes is not None:
        df.sparkSession.createDataFrame([(json.dumps(notes, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}.notes")
