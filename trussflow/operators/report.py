"""Tabular reports: grouping, summaries, ordering and the audit star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussflow.functions.scalar import natural_key


def exact_sum(c: Column) -> Column:
    """Sum of a double that does not depend on the order of rows."""
    return F.sum(c.try_cast("decimal(28,6)")).cast("double")


def summary(kind: str, c: Column, varies: str = "Varies") -> Column:
    """SUM, AVERAGE, MIN, MAX over what reads as a number (an empty sum is 0); CONCAT of the distinct values; VARIES."""
    n = c.try_cast("double")
    return {
        "SUM": lambda: F.coalesce(exact_sum(n), F.lit(0.0)),
        "AVERAGE": lambda: exact_sum(n) / F.count(n),
        "MIN": lambda: F.min(n),
        "MAX": lambda: F.max(n),
        "CONCAT": lambda: F.array_join(F.array_sort(F.collect_set(c.cast("string"))), ", "),
        "VARIES": lambda: F.when(F.min(c.cast("string")) == F.max(c.cast("string")), F.min(c.cast("string"))).otherwise(F.lit(varies)),
    }[kind]()


def group_report(df: DataFrame, groups: list[str], summaries: dict[str, tuple[str, str]], last: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per group. ``summaries``: output -> (kind, column); ``last``: output -> (column, order column), the last row's value."""
    aggs = [summary(k, F.col(c)).alias(o) for o, (k, c) in summaries.items()]
    aggs += [F.max_by(F.col(c), F.col(by)).alias(o) for o, (c, by) in (last or {}).items()]
    return df.groupBy(*groups).agg(*aggs)


def with_footer(df: DataFrame, label: str, totals: dict[str, str]) -> DataFrame:
    """The rows and one footer row of summaries (column -> kind)."""
    foot = df.agg(*[summary(k, F.col(c)).alias(c) for c, k in totals.items()])
    types = dict(df.dtypes)
    foot = foot.select(*[(F.lit(label) if c == df.columns[0] else F.col(c).cast(types[c]) if c in totals else F.lit(None).cast(types[c])).alias(c) for c in df.columns])
    return df.unionByName(foot)


def natural_sort(df: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """Sorted by several keys (column, ASC or DESC) in natural order; numbers by value."""
    types = dict(df.dtypes)
    order = []
    for c, way in keys:
        k = natural_key(F.col(c)) if types[c] == "string" else F.col(c)
        order.append(k.desc() if way == "DESC" else k.asc())
    return df.orderBy(*order)


def limit_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def type_counts(elements: DataFrame, by: str = "class") -> DataFrame:
    return elements.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def star(elements: DataFrame, key: str, properties: dict[str, dict[str, str]]) -> DataFrame:
    """element_id, set_name, name, value: properties of every element as rows (one pass, no join)."""
    cells = F.array(*[F.struct(F.lit(s).alias("set_name"), F.lit(p).alias("name"), F.expr(e).cast("string").alias("value")) for s, props in properties.items() for p, e in props.items()])
    return elements.select(F.col(key).alias("element_id"), F.inline(cells)).where("value is not null")


def expand_lists(df: DataFrame, lists: list[str]) -> DataFrame:
    """Every combination of the entries of list columns, an empty list as one null (chained explodes)."""
    for c in lists:
        df = df.withColumn(c, F.explode_outer(c))
    return df
