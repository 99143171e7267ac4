"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, repeated up to its cap, form a stream of tokens that is cut into blocks of one size. Block k of a
source with weight w is released at floor(k / w) and due at ceil((k + 1) / w); in every slot the released block with the
earliest deadline runs, which keeps every source within less than one block of its share at every prefix of the mix. The
schedule is worked out on blocks alone: there are MAX_BLOCKS of them at most, as the block grows with the data beyond
BLOCK_TOKENS * MAX_BLOCKS tokens, so it is a table of bounded size that is joined to the documents. Documents find their
block by their token offset, from sums over (source, slice) that are added up before any row is numbered, so a source that
holds a third of all rows is spread over many tasks; the mix in order is one range-partitioned sort by slot and offset.

Tokens are counted with a public vocabulary whose path is a parameter.

Defined results: source names compare without case, outer blanks and separators; null and empty texts have 0 tokens and are
placed like others; a null source or one without target is left out; a target without documents is reported as short with 0
tokens; a document id given twice counts as two documents; targets repeated under one name add up; a null or negative cap
counts as 1 and 0.
"""

from __future__ import annotations

import base64
import heapq
import math
import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trussflow.session import lookup_join, materialize, partitions

#: Tokens in a block, and blocks in a schedule at most (beyond them blocks are longer).
BLOCK_TOKENS, MAX_BLOCKS = 4_096, 1 << 18
#: The vocabulary: a file of ranks in the tiktoken format. A path every executor can read.
VOCABULARY = os.environ.get("TRUSSFLOW_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published split pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[\\s_\\-./]+", "")


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens."""

    def count(batches):
        enc = _encoder(vocabulary)
        for pdf in batches:
            n = [len(x) for x in enc.encode_ordinary_batch([t or "" for t in pdf["text"]], num_threads=1)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": pd.Series(n, dtype="int64")})

    return docs.select("doc_id", "source", "text").mapInPandas(count, "doc_id long, source string, tokens long")


def supply(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """source, key, share, copies, docs, tokens, total, short, weight for every target.

    ``short``: tokens * copies stay below share * total, where total is that of all documents of target sources. Every
    source gives min(share * total, tokens * copies); ``weight`` is its part of that sum.
    """
    want = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("key")).agg(
        F.min("source").alias("source"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"),
        F.max(F.greatest(F.coalesce("max_copies", F.lit(1)), F.lit(0))).cast("long").alias("copies"),
    )
    have = counted.groupBy(source_key(F.col("source")).alias("key")).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    s = want.join(have, "key", "left").na.fill(0, ["docs", "tokens"])
    # One row per target here: a window over all of them is a window over the list of targets.
    s = s.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    capacity, wanted = F.col("tokens") * F.col("copies"), F.col("share") * F.col("total")
    s = s.withColumn("short", capacity < wanted).withColumn("quota", F.least(capacity.cast("double"), wanted))
    return s.withColumn("weight", F.coalesce(F.try_divide("quota", F.sum("quota").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))


def pfair(weights: list[float], blocks: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block, in order of slot: earliest deadline first among the released.

    Weights add up to 1. A slot in which nothing is released yet, as may occur behind the last whole blocks only, is skipped.
    """
    eps = 1e-9  # k / w of a weight that divides a whole number stays that number

    def window(i: int, k: int) -> tuple[int, int]:
        return math.floor(k / weights[i] + eps), math.ceil((k + 1) / weights[i] - eps)

    waiting = [(0, window(i, 0)[1], i, 0) for i, n in enumerate(blocks) if n > 0 and weights[i] > 0]
    heapq.heapify(waiting)  # by release
    ready: list[tuple[int, int, int, int]] = []  # by deadline
    out, slot = [], 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            release, due, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, release, i, k))
        due, release, i, k = heapq.heappop(ready)
        out.append((i, k, release, due, slot))
        if k + 1 < blocks[i]:
            release, due = window(i, k + 1)
            heapq.heappush(waiting, (release, due, i, k + 1))
        slot += 1
    return out


def schedule(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK_TOKENS, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(mix, supply). mix: doc_id, source, copy, block, release, deadline, slot, offset, tokens; by slot and offset it is the mix.

    A document is in if its tokens begin before the source's quota is full, so a source ends within one document of it.
    """
    spark = documents.sparkSession
    counted = materialize(with_tokens(documents, vocabulary), "tokens")
    plan = materialize(supply(counted, targets), "supply")
    # one row for each target
    sources = [(r.key, r.quota, r.weight) for r in plan.where("quota > 0").orderBy("key").collect()]
    block = max(block, math.ceil(sum(q for _, q, _ in sources) / max_blocks))
    slots = pfair([w for _, _, w in sources], [math.ceil(q / block) for _, q, _ in sources])
    columns = list(zip(*[(sources[i][0], *rest) for i, *rest in slots])) or [()] * 5
    names = ["key", "block", "release", "deadline", "slot"]
    slots = spark.createDataFrame(pa.table([pa.array(c, pa.string() if n == "key" else pa.int64()) for n, c in zip(names, columns)], names=names))
    rows = counted.withColumn("key", source_key(F.col("source"))).drop("source")
    rows = lookup_join(rows, plan.select("key", "source", "copies", F.col("tokens").alias("all_tokens"), "quota"), ["key"], "inner")
    slices = max(16, 4 * partitions(spark))
    # A slice is a hash range of ids: rows of one source are spread, and an order inside it costs no global sort.
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(slices)))
    sums = rows.groupBy("key", "slice").agg(F.sum("tokens").alias("sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("key", "slice").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lookup_join(rows.withColumn("inside", inside), before, ["key", "slice"], "inner")
    rows = rows.withColumn("start", F.col("before") + F.col("inside")).where("quota > 0")
    copies = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)
    rows = rows.withColumn("copy", F.explode(copies)).withColumn("offset", F.col("start") + F.col("copy") * F.col("all_tokens")).where("offset < quota")
    rows = rows.withColumn("block", F.floor(F.col("offset") / block))
    mix = lookup_join(rows, slots, ["key", "block"], "inner")
    return mix.select("doc_id", "source", (F.col("copy") + 1).alias("copy"), "block", "release", "deadline", "slot", "offset", "tokens"), plan


def ordered(mix: DataFrame) -> DataFrame:
    """The mix in the order of its slots, range-partitioned."""
    return mix.orderBy("slot", "offset")


def shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """source, target_share, docs, tokens, used_tokens, most_copies, short, actual_share, deviation: what the mix really holds.

    ``short``: the tokens scheduled for the source stay below its share of all tokens. ``deviation`` is actual less target
    share; where a source is short it is above 0 for the others, as they keep their quota of all tokens.
    """
    used = mix.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.max("copy").alias("most_copies"))
    r = plan.select("source", F.col("share").alias("target_share"), "docs", "tokens", "total").join(used, "source", "left").na.fill(0, ["used_tokens", "most_copies"])
    r = r.withColumn("short", F.col("used_tokens") < F.col("target_share") * F.col("total"))
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    r = r.withColumn("actual_share", F.coalesce(F.try_divide("used_tokens", total), F.lit(0.0)))
    return r.withColumn("deviation", F.col("actual_share") - F.col("target_share")).drop("total")
