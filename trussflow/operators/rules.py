"""Rules over instances: the expression language's aggregate functions as Columns, and drivers that list violations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query(items: Column, test: Callable[[Column], Column]) -> Column:
    """QUERY(x <* items | test): members for which the test is true (unknown counts as false)."""
    return F.filter(items, lambda x: F.coalesce(test(x), F.lit(False)))


def sizeof(items: Column) -> Column:
    return F.when(items.isNull(), 0).otherwise(F.size(items))


def exists(c: Column) -> Column:
    return c.isNotNull()


def nvl(c: Column, other: Column) -> Column:
    return F.coalesce(c, other)


def item(items: Column, k: int) -> Column:
    """One-based member; null beyond the end."""
    return F.get(items, F.lit(k - 1))


def holds(test: Column) -> Column:
    """A rule's outcome: unknown is no violation of itself, but counts as not fulfilled."""
    return F.coalesce(test, F.lit(False))


def used_in(edges: DataFrame, attr: str) -> DataFrame:
    """id, users: for each referenced instance those that refer to it through ``attr``."""
    return edges.where(F.col("attr") == attr).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("users"))


def type_of(df: DataFrame, taxonomy: DataFrame, cls: str = "class") -> DataFrame:
    """Adds ``types``: the class and its supertypes, nearest first. The taxonomy is schema-sized."""
    t = taxonomy.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("types"))
    return df.join(F.broadcast(t.withColumnRenamed("class", cls)), cls, "left")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rule, id: instances that do not fulfil a rule, all rules in one pass."""
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), holds(c).alias("ok")) for n, c in rules.items()])
    return df.select(F.col(key).alias("id"), F.inline(cells)).where("not ok").select("rule", "id")


def unique_violations(df: DataFrame, key: str, columns: list[str], rule: str) -> DataFrame:
    """rule, id: instances whose values (all given) another instance has too."""
    n = F.count("*").over(Window.partitionBy(*columns))
    return df.dropna(subset=columns).withColumn("_n", n).where("_n > 1").select(F.lit(rule).alias("rule"), F.col(key).alias("id"))


def inverse_cardinality(instances: DataFrame, edges: DataFrame, least: int, most: int | None, rule: str) -> DataFrame:
    """rule, id: instances referred to fewer than ``least`` or more than ``most`` times."""
    n = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    bad = F.col("n") < least
    if most is not None:
        bad = bad | (F.col("n") > most)
    return instances.select("id").join(n, "id", "left").na.fill(0, ["n"]).where(bad).select(F.lit(rule).alias("rule"), "id")


def schema_check(df: DataFrame, key: str, columns: dict[str, dict]) -> DataFrame:
    """attribute, id, problem from column declarations: ``optional``, ``enum``, ``min_size``, ``max_size``, ``pattern``."""
    cells = []
    for name, d in columns.items():
        c = F.col(name)
        problem = F.when(c.isNull() & F.lit(not d.get("optional", False)), "not given")
        if "enum" in d:
            problem = problem.when(~c.cast("string").isin(list(d["enum"])), "not an item of the enumeration")
        if "pattern" in d:
            problem = problem.when(~c.cast("string").rlike(f"^(?:{d['pattern']})$"), "does not match")
        if "min_size" in d:
            problem = problem.when(F.size(c) < d["min_size"], "too few members")
        if "max_size" in d:
            problem = problem.when(F.size(c) > d["max_size"], "too many members")
        cells.append(F.struct(F.lit(name).alias("attribute"), problem.alias("problem")))
    return df.select(F.col(key).alias("id"), F.inline(F.array(*cells))).where("problem is not null").select("attribute", "id", "problem")
