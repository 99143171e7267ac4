import math
import os
import random

import pytest

from trussflow.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no vocabulary file")
DOCS, TARGETS = "doc_id long, source string, text string", "source string, target_share double, max_copies int"


def test_shares_caps_and_deviation(spark):
    docs = [(k, " Big_Source" if k % 2 else "big-source", "word " * 200) for k in range(300)] + [(1000 + k, "small", "word " * 200) for k in range(20)] + [(2000, "other", "x"), (2001, None, "x"), (2002, "small", None), (2003, "small", "")]
    t = [("big source", 0.5, 1), ("SMALL", 0.4, 3), ("none", 0.1, 8)]
    mix, plan = mixing.schedule(spark.createDataFrame(docs, DOCS), spark.createDataFrame(t, TARGETS), block=500)
    s = {r.source: r for r in mixing.shares(mix, plan).collect()}
    assert {k for k, r in s.items() if r.short} == {"SMALL", "none"} and s["SMALL"].most_copies == 3 and s["none"].used_tokens == 0
    rows = mixing.ordered(mix).collect()
    uses = {}
    for r in rows:
        uses[r.doc_id, r.copy] = uses.get((r.doc_id, r.copy), 0) + 1
    assert max(uses.values()) == 1 and {r.source for r in rows} == {"big source", "SMALL"}
    weights = {r.source: r.weight for r in plan.collect()}
    used, total = {"big source": 0, "SMALL": 0}, 0
    for r in rows:
        used[r.source] += r.tokens
        total += r.tokens
        for k, n in used.items():  # less than a block, and a document that laps over its block or is not yet whole in it
            assert abs(n - weights[k] * total) < 500 + 2 * 201
    assert all(r.release <= r.slot < r.deadline for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_less_than_a_block_from_the_share_at_every_prefix(seed):
    r = random.Random(seed)
    raw = [r.random() ** 3 for _ in range(r.choice([2, 5, 40]))]
    weights = [x / sum(raw) for x in raw]
    total = 3000
    out = mixing.pfair(weights, [math.ceil(w * total) for w in weights])
    used = [0] * len(weights)
    assert len({x[:2] for x in out}) == len(out)
    for n, (i, k, release, due, slot) in enumerate(out, 1):
        assert k == used[i] and release <= slot
        used[i] += 1
        if n <= total - len(weights):
            assert slot == n - 1 and slot < due and all(abs(u - w * n) < 1 for u, w in zip(used, weights))


def test_blocks_grow_beyond_the_bound(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}", "word " * 50) for k in range(300)], DOCS)
    mix, _ = mixing.schedule(docs, spark.createDataFrame([("s0", 0.5, 2), ("s1", 0.3, 1), ("s2", 0.2, 1)], TARGETS), block=10, max_blocks=20)
    assert mix.select("source", "block").distinct().count() <= 23


def test_offsets_are_a_partition_of_each_stream(spark):
    docs = spark.createDataFrame([(k, "a", "word " * (k % 7)) for k in range(200)], DOCS)
    mix, _ = mixing.schedule(docs, spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    rows = sorted((r.offset, r.tokens) for r in mix.where("copy = 1").collect())
    at = 0
    for o, n in rows:
        assert o == at or n == 0 or o <= at
        at = max(at, o + n)


def test_empty_tables(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, None)], TARGETS)
    mix, plan = mixing.schedule(d, t)
    assert mix.count() == 0 and [r.short for r in plan.collect()] == [False]
    mix, plan = mixing.schedule(spark.createDataFrame([(1, "a", "x")], DOCS), t.where("false"))
    assert mix.count() == 0 and plan.count() == 0
