"""Session helpers: the shared folder for cut lineage, table access, and protection against hot keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local session (one machine, as in tests) may fall back to a temporary folder of its own.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    path = path or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="trussflow-")
    _LOCAL.append(path)
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@atexit.register
def _clean() -> None:
    for path in _LOCAL:
        shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the rows survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def hot_keys(df: DataFrame, keys: list[str], least: int = 1000) -> list[tuple]:
    """Keys that hold more than half a shuffle partition's fair share of the rows.

    Exact, and at most ``2 * spark.sql.shuffle.partitions`` keys can qualify, so the collected list is bounded by a
    setting and not by the data. Counting is partially aggregated before the shuffle. Null keys are left out: an
    equi-join never matches them.
    """
    spark = df.sparkSession
    df = df.select(*keys).dropna()
    counts = df.groupBy(*keys).count()
    total = df.count()
    limit = max(least, total // (2 * partitions(spark)))
    return [tuple(r[k] for k in keys) for r in counts.where(F.col("count") > limit).collect()]


def _is_hot(df: DataFrame, keys: list[str], hot: list[tuple]) -> Column:
    """Membership in the list of hot keys; a null key is never hot."""
    types = dict(df.dtypes)
    packed = F.struct(*[F.col(k) for k in keys])
    return F.coalesce(packed.isin([F.struct(*[F.lit(x).cast(types[k]).alias(k) for k, x in zip(keys, key)]) for key in hot]), F.lit(False))


#: Bytes of a lookup table that may be broadcast.
SMALL_BYTES = 64 << 20


def table_bytes(df: DataFrame) -> int:
    """Bytes of a table that was written out: rows by the width of its schema, or four times its files (arrays, long texts) if that is more."""
    j = df._jdf
    return max(df.count() * j.schema().defaultSize(), 4 * int(str(j.queryExecution().optimizedPlan().stats().sizeInBytes())))


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", small: int = SMALL_BYTES) -> DataFrame:
    """Join with a table that is written out and measured first: broadcast up to ``small`` bytes, salted join beyond."""
    right = materialize(right, "lookup")
    if table_bytes(right) <= small:
        return left.join(F.broadcast(right), keys, how)
    return salted_join(left, right, keys, how)


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = 16, hot: list[tuple] | None = None
) -> DataFrame:
    """Equi-join whose hot left keys are split over ``salts`` tasks; only the right rows of hot keys are repeated.

    ``how``: ``inner``, ``left`` or ``left_semi``. ``right`` should have few rows a key. Without hot keys it is a plain join.
    """
    hot = hot_keys(left, keys) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    left = left.withColumn("_salt", F.when(_is_hot(left, keys, hot), spread).otherwise(0))
    right = right.withColumn(
        "_salt", F.explode(F.when(_is_hot(right, keys, hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Adds the place of each row in a global order (ties in any order), without one task that sees all rows.

    Rows are range-partitioned and written out, so that their partition is fixed; a rank is the place in the partition plus
    the sizes of the partitions before it (as many rows as there are partitions).
    """
    n = partitions(df.sparkSession)
    parts = materialize(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_pid").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(1)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.join(F.broadcast(sizes.select("_pid", before.alias("_before"))), "_pid")
    return parts.withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy("_pid").orderBy(*order))).drop("_pid", "_before")
