"""Streams: instance texts as they arrive, and event-time windows."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussflow.session import shared_dir
from trussflow.sources.spf import _without, parse_lines, split_records


def read_instances(spark: SparkSession, folder: str, bypass: list[str] = (), files_per_trigger: int = 8) -> DataFrame:
    """Streaming instances of the files that arrive in a folder; a file arrives whole and is split into records by one task."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).load(folder)

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame({"value": split_records(content.decode("utf-8", "replace"))})

    return parse_lines(_without(files.select("content").mapInPandas(run, "value string"), bypass))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream (its schema is read once). Times without zone become instants, as watermarks need."""
    schema = spark.read.parquet(path).schema
    # As a pattern the path may be a single file too; a plain path has to be a folder.
    df = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def windowed(events: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "1 day", by: list[str] = (), value: str = "value") -> DataFrame:
    """start, keys, n, total per tumbling or sliding window; events later than ``late`` are dropped."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(28,6)")).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str = "1 day") -> DataFrame:
    """start, finish, keys, n per session closed by ``gap`` without events."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("finish"), *by, "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over everything that is there now and returns the rows it wrote to the shared folder.

    In complete mode the last state is returned.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/rows")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def upsert_index(batches: DataFrame, path: str) -> None:
    """foreachBatch sink: appends class and id of the instances of each batch to an index partitioned by class."""

    def write(df: DataFrame, epoch: int) -> None:
        df.select("class", "id").write.mode("append").partitionBy("class").parquet(path)

    batches.writeStream.foreachBatch(write).option("checkpointLocation", path.rstrip("/") + "-state").trigger(availableNow=True).start().awaitTermination()


def resolve_references(instances: DataFrame, path: str) -> DataFrame:
    """src, dst, resolved: references of a stream of instances, held against all instances that have arrived.

    Each micro-batch appends its ids and its references; which end is still missing is decided when the result is read, so a
    reference to an instance that arrives later needs no state in memory.
    """

    def write(df: DataFrame, epoch: int) -> None:
        df.select("id").write.mode("append").parquet(f"{path}/ids")
        df.select(F.col("id").alias("src"), F.explode("refs").alias("dst")).write.mode("append").parquet(f"{path}/refs")

    instances.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    spark = instances.sparkSession
    ids = spark.read.schema("id long").parquet(f"{path}/ids").distinct().select(F.col("id").alias("dst"), F.lit(True).alias("there"))
    refs = spark.read.schema("src long, dst long").parquet(f"{path}/refs")
    return refs.join(ids, "dst", "left").select("src", "dst", F.coalesce("there", F.lit(False)).alias("resolved"))
