"""Schedules, working calendars and costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussflow.session import materialize


def calendar(df: DataFrame, start: str, end: str, holidays: list[str] = (), workdays: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """day, is_working, working_index (working days up to and with that day) between two dates; Monday is 1.

    The number of days bounds the table, so later joins may broadcast it after a check of its size.
    """
    d = df.sparkSession.sql(f"select explode(sequence(date'{start}', date'{end}')) as day")
    off = F.col("day").isin([F.lit(h).cast("date") for h in holidays]) if holidays else F.lit(False)
    d = d.withColumn("is_working", ((F.weekday("day") + 1).isin(*workdays) & ~off))
    return d.withColumn("working_index", F.sum(F.col("is_working").cast("int")).over(Window.partitionBy(F.lit(1)).orderBy("day")))


def working_days(start: Column, end: Column) -> Column:
    """Monday-to-Friday days from start to end, both counted, by arithmetic (no calendar rows)."""
    days = F.date_diff(end, start) + 1
    weeks, rest = F.floor(days / 7), days % 7
    first = F.weekday(start)
    extra = F.least(F.greatest(F.lit(5) - first, F.lit(0)), rest) + F.greatest(F.least(first + rest - 7, F.lit(5)), F.lit(0))
    return F.when(days <= 0, 0).otherwise(weeks * 5 + extra).cast("int")


def offset_working_days(df: DataFrame, day: str, days: str, cal: DataFrame, out: str) -> DataFrame:
    """Adds the date ``days`` working days after ``day`` (0: the day itself or the next working day), by calendar index."""
    nth = cal.where("is_working").select(F.col("working_index").alias("_i"), F.col("day").alias(out))
    here = cal.select(F.col("day").alias("_d"), (F.col("working_index") + F.when(F.col("is_working"), 0).otherwise(1)).alias("_w"))
    return df.join(here, F.col(day) == F.col("_d"), "left").join(nth, F.col("_w") + F.col(days) == F.col("_i"), "left").drop("_d", "_w", "_i")


def critical_path(tasks: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """id, early_start, early_finish, late_start, late_finish, total_float, is_critical, by relaxation level by level.

    ``tasks(id, duration)``; ``edges(pred, succ, type, lag)`` with the types FS, SS, FF and SF. Times are days from 0. Only
    tasks whose time moved ask their neighbours in the next round; the longest chain gives the number of rounds. A loop
    never settles and raises after ``max_rounds``.
    """
    tasks = materialize(tasks.select("id", F.coalesce("duration", F.lit(0.0)).cast("double").alias("duration")), "tasks")
    e = edges.join(tasks.select(F.col("id").alias("pred"), F.col("duration").alias("dp")), "pred").join(tasks.select(F.col("id").alias("succ"), F.col("duration").alias("ds")), "succ")
    kind, lag = F.upper("type"), F.coalesce("lag", F.lit(0.0))
    # distance from the start of the predecessor to the start of the successor
    gap = F.when(kind == "SS", lag).when(kind == "FF", F.col("dp") + lag - F.col("ds")).when(kind == "SF", lag - F.col("ds")).otherwise(F.col("dp") + lag)
    e = materialize(e.select("pred", "succ", gap.alias("gap")), "links")

    def settle(times: DataFrame, a: str, b: str) -> DataFrame:
        moved = times
        for _ in range(max_rounds):
            push = moved.select(F.col("id").alias(a), F.col("t").alias("from")).join(e, a).groupBy(F.col(b).alias("id")).agg(F.max(F.col("from") + F.col("gap")).alias("new"))
            nxt = materialize(times.join(push, "id", "left").select("id", F.greatest("t", F.coalesce("new", "t")).alias("t"), F.coalesce(F.col("new") > F.col("t"), F.lit(False)).alias("moved")), "times")
            times, moved = nxt.select("id", "t"), nxt.where("moved").select("id", "t")
            if moved.isEmpty():
                return times
        raise ValueError("the task network has a loop")

    early = settle(tasks.select("id", F.lit(0.0).alias("t")), "pred", "succ")
    finish = early.join(tasks, "id").agg(F.max(F.col("t") + F.col("duration")).alias("end"))
    end = finish.first()["end"] or 0.0
    # the same relaxation on the reversed network gives the time that must remain after each start
    tail = settle(tasks.select("id", F.col("duration").alias("t")), "succ", "pred")
    r = tasks.join(early.withColumnRenamed("t", "early_start"), "id").join(tail.withColumnRenamed("t", "tail"), "id")
    r = r.withColumns({"early_finish": F.col("early_start") + F.col("duration"), "late_start": F.lit(end) - F.col("tail")})
    r = r.withColumns({"late_finish": F.col("late_start") + F.col("duration"), "total_float": F.col("late_start") - F.col("early_start")})
    return r.select("id", "early_start", "early_finish", "late_start", "late_finish", "total_float", (F.abs("total_float") < 1e-9).alias("is_critical"))


def chain_dates(df: DataFrame, chain: str, order: list[str], duration: str) -> DataFrame:
    """Early start and finish of tasks that follow one another in each chain (a running sum, no relaxation)."""
    w = Window.partitionBy(chain).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("early_finish", F.sum(duration).over(w)).withColumn("early_start", F.col("early_finish") - F.col(duration))


def cost_values(components: DataFrame, item: str, operator: str, value: str) -> DataFrame:
    """item, amount: ADD, SUBTRACT, MULTIPLY or DIVIDE over an item's components in order of ``pos``; division by 0 is skipped."""
    parts = components.groupBy(item).agg(F.max(operator).alias("op"), F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("vs"))
    first, rest = F.get("vs", F.lit(0)), F.slice("vs", 2, F.size("vs"))
    # one item's components only: a value tree is as small as its editor made it
    fold = lambda f: F.aggregate(rest, first, f)
    op = F.upper("op")
    amount = (
        F.when(op == "SUBTRACT", fold(lambda a, x: a - x)).when(op == "MULTIPLY", fold(lambda a, x: a * x))
        .when(op == "DIVIDE", fold(lambda a, x: F.when(x == 0, a).otherwise(a / x))).otherwise(fold(lambda a, x: a + x))
    )
    return parts.select(item, amount.alias("amount"))


def rollup(values: DataFrame, paths: DataFrame) -> DataFrame:
    """id, own, total: the values of every node and all below it, from ancestor pairs (ancestor, descendant)."""
    v = values.select(F.col("id").alias("descendant"), "value")
    sums = paths.join(v, "descendant").groupBy(F.col("ancestor").alias("id")).agg(F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("total"))
    return sums.join(values.select("id", F.col("value").alias("own")), "id", "left")


def total_quantity(df: DataFrame, group: str, quantity: str) -> DataFrame:
    """Sum of quantities, null where there are none."""
    return df.groupBy(group).agg(F.sum(F.col(quantity).cast("decimal(28,6)")).cast("double").alias("quantity"))


def parse_csv_hierarchy(rows: DataFrame, index: str, order: str, document: str | None = None) -> DataFrame:
    """Parent of each row of indented tables: the last row before it, in its document, that is one level up.

    One window per document carries the last row of every level along; documents are files that people edit, so each fits a
    task, and many are spread over all tasks. The levels carried are those that occur.
    """
    levels = int(rows.agg(F.max(index)).first()[0] or 0) + 1
    key = F.lit(1) if document is None else F.col(document)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.array(*[F.last(F.when(F.col(index) == k, F.col(order)), ignorenulls=True).over(w) for k in range(levels)])
    return rows.withColumn("parent", F.when(F.col(index) > 0, F.get(last, F.col(index) - 1)))


def p6_tables(lines: DataFrame) -> DataFrame:
    """table, row: records of a tab-separated schedule exchange text (lines with %T, %F and %R marks), per file, in order."""

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["value"]:
                name, fields = None, []
                for line in (text or "").splitlines():
                    cells = line.split("\t")
                    if cells[0] == "%T":
                        name = cells[1]
                    elif cells[0] == "%F":
                        fields = cells[1:]
                    elif cells[0] == "%R":
                        out.append((name, dict(zip(fields, cells[1:]))))
            yield pd.DataFrame(out, columns=["table", "row"])

    return lines.select("value").mapInPandas(run, "table string, row map<string,string>")
