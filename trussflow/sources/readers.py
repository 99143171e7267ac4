"""Opening files by extension, table sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussflow.sources import spf

#: Extension -> format.
FORMATS = {".ifc": "spf", ".ifczip": "zip", ".zip": "zip", ".ifcxml": "xml", ".xml": "xml", ".csv": "csv", ".json": "json", ".cityjson": "json", ".parquet": "parquet", ".xer": "xer", ".txt": "text"}


def guess_format(path: str) -> str:
    """Format by extension; a path without one is a folder of Parquet tables."""
    return FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "parquet")


def open_model(spark: SparkSession, path: str, format: str | None = None, bypass: list[str] = (), row_tag: str = "Task") -> DataFrame:  # noqa: A002
    kind = format or guess_format(path)
    if kind == "spf":
        return spf.read_spf(spark, path, bypass)
    if kind == "zip":
        return spf.read_zip(spark, path)
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "xml":
        return spark.read.format("xml").option("rowTag", row_tag).load(path)
    if kind in ("xer", "text"):
        return spark.read.text(path, wholetext=kind == "xer")
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format {kind}")


def city_objects(doc: DataFrame) -> DataFrame:
    """id, type, parents of the objects of CityJSON documents read as text (``value``: the whole document)."""
    objects = F.from_json(F.get_json_object("value", "$.CityObjects"), "map<string,struct<type:string,parents:array<string>>>")
    return doc.select(F.explode(objects).alias("id", "o")).select("id", F.col("o.type").alias("type"), F.coalesce("o.parents", F.array().cast("array<string>")).alias("parents"))


def write_tables(tables: dict[str, DataFrame], path: str, format: str = "parquet", partition: dict[str, str] | None = None) -> None:  # noqa: A002
    """One folder per table; ``partition`` names a column that splits a table, such as the class or storey."""
    for name, df in tables.items():
        w = df.write.mode("overwrite").format(format)
        if format == "csv":
            w = w.option("header", True)
        if partition and name in partition:
            w = w.partitionBy(partition[name])
        w.save(f"{path}/{name}")
