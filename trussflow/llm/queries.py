"""Queries of the text problems, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussflow.llm import contamination, mixing, pii
from trussflow.session import table


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return contamination.reparameterised(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p7_leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("stretch").alias("longest"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.ordered(mixing.schedule(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0])


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.schedule(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their share: the rows of the mix's report flagged as short."""
    return p8_shares(spark, d).where("short").select("source").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_spans(spark, d).select("doc_id", "kind", "start_pos").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"))


QUERIES = {
    "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_items": p7_items, "p7_reparameterised": p7_reparameterised,
    "p8_found": p8_found, "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_spans": p9_spans, "p9_redacted": p9_redacted,
}

#: The verdicts do not hang on the tokenizer, so characters stand for tokens here.
SQL = {
    "p8_found": """
WITH t AS (SELECT source, regexp_replace(lower(source), '[\\s_\\-./]+', '', 'g') AS k, target_share, max_copies FROM mix_targets),
d AS (SELECT regexp_replace(lower(source), '[\\s_\\-./]+', '', 'g') AS k, sum(length(text)) AS n FROM documents GROUP BY 1),
j AS (SELECT t.*, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER () AS total FROM t LEFT JOIN d USING (k))
SELECT source FROM j WHERE n * max_copies < target_share * total
""",
}
