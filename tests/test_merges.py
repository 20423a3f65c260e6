"""Sums of micro-batches: equal to those of the whole, across restarts and repeated batches."""

import pytest
from pyspark.sql import functions as F

from skyloom.streaming import merges


def test_restart_and_repeat(spark, tmp_path):
    source, folder, schema = str(tmp_path / "in"), str(tmp_path / "out"), "zone int, year int, v double"
    rows = [(i % 4, 2000 + i % 6, None if i % 11 == 0 else float(i * i % 97)) for i in range(600)]

    def add(year):
        spark.createDataFrame([r for r in rows if r[1] == year], schema).coalesce(1).write.mode("append").parquet(source)

    def read():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def whole(last):
        df = spark.createDataFrame([r for r in rows if r[1] <= last], schema).where("v IS NOT NULL")
        return {(r["zone"], r["year"]): (r["n"], pytest.approx(r["m"]), pytest.approx(r["s"])) for r in df.groupBy("zone", "year").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}

    def got():
        return {(r["zone"], r["year"]): (r["n"], r["mean"], r["sd"]) for r in merges.merged(spark, folder, ["zone", "year"]).collect()}

    for year in (2000, 2001, 2002):
        add(year)
    merges.run(read(), folder, ["zone", "year"], "v")
    assert got() == whole(2002)
    merges.run(read(), folder, ["zone", "year"], "v")
    assert got() == whole(2002)
    for year in (2003, 2004, 2005):
        add(year)
    merges.run(read(), folder, ["zone", "year"], "v")
    assert got() == whole(2005)
    # A batch that comes again, as after a lost driver, replaces its own sums.
    again = spark.createDataFrame([r for r in rows if r[1] == 2000], schema)
    merges.into(f"{folder}/sums", ["zone", "year"], "v")(again, 0)
    merges.into(f"{folder}/sums", ["zone", "year"], "v")(again, 0)
    assert sum(n for n, _, _ in got().values()) == sum(n for n, _, _ in whole(2005).values())
