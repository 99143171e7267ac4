"""Comparing and merging models: differences, folding of equal instances, first-wins merging, unique ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussflow.session import materialize


def _differs(dtype: str, a: Column, b: Column, eps: float) -> Column:
    if dtype in ("double", "float"):
        return F.coalesce(F.abs(a - b) > eps, a.isNull() != b.isNull())
    if dtype.startswith("array"):
        return ~F.array_sort(a).eqNullSafe(F.array_sort(b))
    return ~a.eqNullSafe(b)


def diff(old: DataFrame, new: DataFrame, key: str, eps: float = 1e-6, columns: list[str] | None = None) -> DataFrame:
    """key, status (added, deleted, changed), changed (names of changed columns): one full outer join on the key."""
    columns = columns or [c for c in new.columns if c != key]
    types = dict(new.dtypes)
    o = old.select(F.col(key), F.lit(True).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    n = new.select(F.col(key), F.lit(True).alias("_n"), *columns)
    j = o.join(n, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(_differs(types[c], F.col(f"_o_{c}"), F.col(c), eps), F.lit(c)) for c in columns]))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.size(changed) > 0, "changed")
    none = F.array().cast("array<string>")
    return j.select(key, status.alias("status"), F.when(F.col("_o").isNull() | F.col("_n").isNull(), none).otherwise(changed).alias("changed")).where("status is not null")


def fold(instances: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, keep: equal instances and the least key among them (null equals null)."""
    k = instances.groupBy(*columns).agg(F.min(key).alias("keep"))
    joined = instances.alias("i").join(k.alias("k"), [F.col(f"i.{c}").eqNullSafe(F.col(f"k.{c}")) for c in columns])
    return joined.select(F.col(f"i.{key}").alias(key), "keep")


def fold_graph(instances: DataFrame) -> DataFrame:
    """id, keep for ``instances(id, body, refs)``: instances of equal body whose references fold to the same ones.

    Rounds of grouping by body and mapped references until nothing moves; every round is written out. Loops of references
    end when no further pair becomes equal.
    """
    keep = materialize(instances.select("id", F.col("id").alias("keep")), "fold")
    while True:
        refs = instances.select("id", F.posexplode_outer("refs").alias("pos", "ref")).join(keep.select(F.col("id").alias("ref"), F.col("keep").alias("to")), "ref", "left")
        mapped = refs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("to", "ref").alias("to")))), lambda x: x["to"]).alias("mapped"))
        now = instances.select("id", "body").join(mapped, "id").withColumn("h", F.sha2(F.to_json(F.struct("body", "mapped")), 256))
        groups = now.groupBy("h").agg(F.min("id").alias("keep"))
        nxt = materialize(now.join(groups, "h").select("id", "keep"), "fold")
        moved = nxt.join(keep.withColumnRenamed("keep", "was"), "id").where("keep <> was")
        done = moved.isEmpty()
        keep = nxt
        if done:
            break
    return keep


def federate(tables: list[DataFrame], key: str) -> DataFrame:
    """Union of tables by name in which the first table that has a key wins."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("_rank", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_rank")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def merge_models(models: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(instances, edges) of several models with ids shifted so that they stay distinct; ``model`` tells the origin."""
    inst, edge = None, None
    for k, (i, e) in enumerate(models):
        shift = lambda c, k=k: (F.col(c) * len(models) + k).alias(c)  # noqa: E731 - no pass over the data to find an offset
        i = i.select(shift("id"), *[c for c in i.columns if c != "id"], F.lit(k).alias("model"))
        e = e.select(shift("src"), shift("dst"), *[c for c in e.columns if c not in ("src", "dst")])
        inst, edge = (i, e) if inst is None else (inst.unionByName(i, True), edge.unionByName(e, True))
    return inst, edge


def duplicate_ids(df: DataFrame, key: str, guid: str) -> DataFrame:
    """Rows whose guid an earlier row (by key) already has; these need a new one."""
    first = df.groupBy(guid).agg(F.min(key).alias("_first"), F.count("*").alias("copies")).where("copies > 1")
    return df.join(first, guid).where(F.col(key) != F.col("_first")).drop("_first")
