"""Products: tables that leave the engine as CSV, JSON, GeoJSON or parquet, with chosen columns, a checked name and notes beside them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import rules
from skyloom.operators import guards
from skyloom.sources import tables

#: Formats of tables; geojson has one feature in a line.
FORMATS = ("parquet", "csv", "json", "geojson")


def resolved_format(kind: str) -> str:
    """The format under its own name; unknown ones are refused."""
    if (low := kind.strip().lower()) not in FORMATS:
        raise ValueError(f"no product is written as {kind!r}; known are {', '.join(FORMATS)}")
    return low


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that a table lacks, in order."""
    return [c for c in wanted if c not in df.columns]


def ring_geometry(ring: Column) -> Column:
    """A GeoJSON polygon of a ring (array<struct<x, y>>), closed if it is not."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    closed = F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    return F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))


def as_features(df: DataFrame, key: str, geometry: Column | None, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature per row in ``value``; a missing geometry is null."""
    shape = F.lit(None).cast("string") if geometry is None else geometry
    feature = F.struct(F.lit("Feature").alias("type"), F.col(key).cast("string").alias("id"), shape.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


#: How CSV products are written and read: nulls and empty strings apart, quotes doubled, line ends inside strings.
CSV = {"header": True, "nullValue": r"\N", "quote": '"', "escape": '"', "quoteAll": True}


def _marked(df: DataFrame, pattern: str, by: str) -> DataFrame:
    """``df`` with ``pattern`` replaced in its strings: one that reads like the mark of nulls has a backslash more in the file."""
    return df.select(*[F.regexp_replace(c, pattern, by).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_product(df: DataFrame, folder: str, name: str, kind: str, columns: Sequence[str], keys: Sequence[str], geometry: Column | None = None, notes: dict | None = None, complete: bool = False) -> str:
    """Writes the chosen columns under ``folder/name`` and returns the path.

    Refused are missing columns, repeated keys, and with ``complete`` nulls in any
    chosen column.  An existing product is not overwritten.  The notes get the format,
    the columns and the number of rows, which is counted while they are written.
    """
    kind = resolved_format(kind)
    if missing := missing_columns(df, columns):
        raise ValueError(f"the table has no {missing}")
    guards.unique(df, keys)
    chosen = df.select(*columns)
    if complete:
        guards.complete(chosen, columns)
    path = f"{folder.rstrip('/')}/{name}"
    seen = Observation()
    counted = lambda rows: rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    if kind == "geojson":
        as_features(counted(df), keys[0], geometry, columns).write.mode("errorifexists").text(path)
    elif kind == "csv":
        counted(_marked(chosen, r"^(\\*\\N)$", r"\\$1")).write.mode("errorifexists").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""', **CSV).csv(path)
    else:
        counted(chosen).write.mode("errorifexists").option("ignoreNullFields", False).format(kind).save(path)
    told = {"format": kind, "columns": list(columns), "rows": seen.get["rows"], **(notes or {})}
    df.sparkSession.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}.notes")
    return path


def read_notes(spark: SparkSession, path: str) -> dict:
    """The notes beside a product."""
    return json.loads(spark.read.text(f"{path}.notes").first()[0])


def read_product(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A product read back by its notes; text formats take their types from ``schema``."""
    kind = read_notes(spark, path)["format"]
    if kind == "geojson":
        return tables.features(spark.read.text(path))
    if kind == "csv":
        return _marked(tables.read(spark, path, "csv", schema, multiLine=True, **CSV), r"^\\(\\*\\N)$", "$1")
    return tables.read(spark, path, kind, schema if kind == "json" else None)


def provenance(datasets: dict[str, dict], used: dict[str, Sequence[str]], spark: SparkSession) -> DataFrame:
    """(dataset, title, bands, scale, coverage, users, note): one row for each declared dataset, whoever uses it."""
    rows = [
        (key, key.replace("_", " ").title(), ", ".join(d.get("bands", [])), rules.plain(d["scale"]) if "scale" in d else None, rules.coverage_text(d["start"], d.get("end")) if "start" in d else None, len(used.get(key, [])), d.get("note"))
        for key, d in sorted(datasets.items())
    ]
    return spark.createDataFrame(rows, "dataset string, title string, bands string, scale string, coverage string, users int, note string")
