"""References to records that do not exist, are deleted, or arrive later: bitmaps per key range and period.

Keys are encoded as integers (numbers as they are, others through a dictionary that is written to the shared folder, so a
code never changes under recomputation). For each table, month and range of 32768 codes the references form a bitmap; so do
the live parents by the month they first appear. A range's group holds a few kilobytes a month, however many rows a key
has. The parents present before a month are OR-ed up, the references are AND-NOT-ed with them, and the surviving bits are
decoded. Bitmaps travel compressed. Only references whose bit survives are then held against the exact times.

Defined results: null and empty references are no cases, nor are urls in place of a GUID; a reference without time has no
period and is compared for ``missing`` and ``deleted`` only (month_key ''); exact repeats count once; a parent row without
added_at is present from the beginning; a parent lives if any of its rows has no deleted_at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussflow.functions.text import guid_key, strip
from trussflow.session import hot_keys, materialize, salted_join

RANGE = 32_768


def numeric_code(c: Column) -> Column:
    return c.cast("bigint")


def reference_guid(c: Column) -> Column:
    """Key of a GUID in any spelling; other non-empty text stands for itself, unless it is a url or path."""
    t = strip(c)
    return F.when(t.isNull() | (t == "") | t.contains("/"), None).otherwise(F.coalesce(guid_key(t), F.concat(F.lit("text:"), F.lower(t))))


def dictionary(*key_columns: DataFrame) -> DataFrame:
    """key, code: distinct keys with dense integers in each partition, fixed by being written out."""
    keys = key_columns[0]
    for k in key_columns[1:]:
        keys = keys.union(k)
    keys = keys.dropna().distinct()
    return materialize(keys.withColumn("code", F.monotonically_increasing_id()), "dictionary")


def parent_states(parents: DataFrame, key: str = "code") -> DataFrame:
    """code, live (any row without deleted_at), first_added (null: from the beginning)."""
    first = F.when(F.count_if(F.col("added_at").isNull()) == 0, F.min("added_at"))
    return parents.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col("deleted_at").isNull()).alias("live"), first.alias("first_added"))


def _month(ts: str) -> Column:
    return F.coalesce(F.year(ts) * 12 + F.month(ts) - 1, F.lit(-1)).cast("int")


def _bitmaps(df: DataFrame, groups: list[str]) -> DataFrame:
    """groups, bucket, bits: one bitmap for each group and key range. Partial bitmaps are OR-ed before the shuffle."""
    return df.groupBy(*groups, F.floor(F.col("code") / RANGE).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("code", F.lit(RANGE))).alias("bits"))


def _packed() -> F.pandas_udf:
    @F.pandas_udf("binary")
    def pack(bits: pd.Series) -> pd.Series:
        return bits.map(lambda b: zlib.compress(b, 1))

    return pack


def surviving(refs: DataFrame, states: DataFrame) -> DataFrame:
    """tab, month, code: references whose key is not surely there before their month.

    ``refs``: tab, month, code. A parent counts as surely there in the months after it first appeared.
    """
    pack = _packed()
    r = _bitmaps(refs, ["tab", "month"]).select("tab", "month", "bucket", pack("bits").alias("bits"))
    p = _bitmaps(states.where("live").select(_month("first_added").alias("month"), "code"), ["month"]).select(F.lit("").alias("tab"), "month", "bucket", pack("bits").alias("bits"))

    def and_not(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        there = np.zeros(RANGE // 8, np.uint8)
        at, tabs, months, codes = -1, [], [], []
        parents = pdf[pdf["tab"] == ""].sort_values("month")
        pm, pb = parents["month"].to_numpy(), parents["bits"].to_list()
        for row in pdf[pdf["tab"] != ""].sort_values("month").itertuples():
            while at + 1 < len(pm) and (pm[at + 1] < row.month or row.month < 0):
                at += 1
                there |= np.frombuffer(zlib.decompress(pb[at]), np.uint8)
            # References without month come first; they are held against all parents.
            left = np.frombuffer(zlib.decompress(row.bits), np.uint8) & ~there
            found = np.flatnonzero(np.unpackbits(left, bitorder="little"))
            if row.month < 0:
                at, there = -1, np.zeros(RANGE // 8, np.uint8)
            tabs += [row.tab] * len(found)
            months += [row.month] * len(found)
            codes.append(found + bucket * RANGE)
        return pd.DataFrame({"tab": pd.Series(tabs, dtype=object), "month": np.array(months, np.int32), "code": np.concatenate(codes).astype(np.int64) if codes else np.zeros(0, np.int64)})

    return r.unionByName(p).groupBy("bucket").applyInPandas(and_not, "tab string, month int, code bigint")


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """tab, ref_id, reason, month_key for ``refs(tab, ref_id, code, at)`` against ``parents(code, added_at, deleted_at)``.

    reason: ``missing``, else ``deleted``, else ``late`` (every row of the parent was added after the reference).
    """
    refs = refs.where("code is not null").withColumn("month", _month("at"))
    states = materialize(parent_states(parents), "parents")
    left = surviving(refs.select("tab", "month", "code"), states)
    marked = left.join(states, "code", "left").select(
        "tab", "month", "code",
        F.when(F.col("live").isNull(), "missing").when(~F.col("live"), "deleted").alias("reason"), "first_added",
    )
    hot = hot_keys(refs, ["tab", "month", "code"])
    found = salted_join(refs, materialize(marked, "orphans"), ["tab", "month", "code"], hot=hot)
    reason = F.coalesce("reason", F.when(F.col("first_added") > F.col("at"), "late"))
    return found.select("tab", "ref_id", reason.alias("reason"), F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")).alias("month_key")).where("reason is not null").distinct()


def model_orphans(psets: DataFrame, quantities: DataFrame, references: DataFrame, id_map: DataFrame, documents: DataFrame) -> DataFrame:
    """Orphans of psets and quantities against id_map, and of bcf_references against bcf_documents."""

    def numeric(df: DataFrame, tab: str, key: str) -> DataFrame:
        return df.select(F.lit(tab).alias("tab"), F.col(key).alias("ref_id"), numeric_code(F.col("ifc_id")).alias("code"), F.col("recorded_at").alias("at"))

    by_number = orphans(
        numeric(psets, "psets", "prop_id").unionByName(numeric(quantities, "quantities", "qty_id")),
        id_map.select(numeric_code(F.col("ifc_id")).alias("code"), "added_at", "deleted_at"),
    )
    # Keys are read from their spellings once; coded references are read several times below.
    refs = materialize(references.select("ref_id", reference_guid(F.col("document_guid")).alias("key"), F.col("created_at").alias("at")).where("key is not null"), "references")
    docs = materialize(documents.select(reference_guid(F.col("guid")).alias("key"), "added_at", "deleted_at").where("key is not null"), "documents")
    codes = dictionary(refs.select("key"), docs.select("key"))
    coded = materialize(salted_join(refs, codes, ["key"]).select(F.lit("bcf_references").alias("tab"), "ref_id", "code", "at"), "coded")
    by_guid = orphans(coded, docs.join(codes, "key").select("code", "added_at", "deleted_at"))
    return by_number.unionByName(by_guid)


def orphan_report(found: DataFrame) -> DataFrame:
    """tab, month_key, reason, n."""
    return found.groupBy("tab", "month_key", "reason").agg(F.count("*").alias("n"))
