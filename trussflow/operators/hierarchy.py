"""Parent-child links to full hierarchies: path, depth, root and descendants of every node, and the loops.

Each node first gets its ancestor 16 levels up by doubling, with the path between; frontier joins then extend paths and
depths from the roots, 16 levels a round, and every round is written to the shared folder (a tree of depth 130 takes 9
rounds instead of 130). Links are kept hash-partitioned by that ancestor, so only the frontier moves; links to an ancestor
that very many nodes share are split over several tasks. Nodes never reached hang on loops: pointer jumping on them finds
the loop and its least node in a logarithmic number of rounds.

Defined results: rows with a null id are left out; of several states of a node the latest counts (equal times: the greatest
row); a parent text is read as a number in any spelling, unreadable or empty ones mean no parent; a node that is its own
parent is a loop of one; a null code is an empty part of the path; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trussflow.functions.text import strip
from trussflow.session import hot_keys, materialize, partitions, salted_join

#: A frontier join advances 2**DOUBLINGS levels.
DOUBLINGS = 4
#: Tasks over which the children of a parent with very many are spread.
SALTS = 16


def latest_nodes(wbs: DataFrame) -> DataFrame:
    """id, code, parent: the latest state of each entry."""
    state = F.max(F.struct("updated_at", "sequence_number", "code", "parent_object_id", "name", "model_key"))
    s = wbs.where("object_id is not null").groupBy(F.col("object_id").alias("id")).agg(state.alias("s"))
    parent = F.regexp_extract(F.coalesce(strip(F.col("s.parent_object_id")), F.lit("")), "^#?\\+?(\\d{1,19})(?:\\.0*)?$", 1).try_cast("bigint")
    return s.select("id", F.coalesce(strip(F.col("s.code")), F.lit("")).alias("code"), parent.alias("parent"))


def _nodes(nodes: DataFrame) -> DataFrame:
    """id, code, parent; the parent is null for roots and for entries whose parent is not there."""
    nodes = materialize(nodes, "nodes")
    there = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    out = salted_join(nodes, there, ["parent"], "left")
    return materialize(out.select("id", "code", F.when(F.col("there"), F.col("parent")).alias("parent")), "nodes")


def _strides(nodes: DataFrame, separator: str, doublings: int) -> DataFrame:
    """id, up, root_id, depth, code_path: each node's ancestor 2**doublings levels up and the path from there.

    Nodes nearer to their root than that are complete: ``up`` is null and root_id, depth and code_path are final.
    """
    root = F.col("parent").isNull()
    links = nodes.select("id", F.col("parent").alias("up"), F.when(root, F.col("id")).alias("root_id"), F.when(root, 0).otherwise(1).cast("bigint").alias("depth"), F.col("code").alias("code_path"))
    for _ in range(doublings):
        at = links.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("root_id").alias("root2"), F.col("depth").alias("depth2"), F.col("code_path").alias("path2"))
        longer = salted_join(links.where("up is not null"), at, ["up"]).select("id", F.col("up2").alias("up"), F.col("root2").alias("root_id"), (F.col("depth") + F.col("depth2")).alias("depth"), F.concat_ws(separator, "path2", "code_path").alias("code_path"))
        links = materialize(links.where("up is null").unionByName(longer), "strides")
    return links


def _walk(nodes: DataFrame, separator: str, doublings: int) -> DataFrame:
    """id, root_id, depth, code_path of every node that a root reaches."""
    spark = nodes.sparkSession
    links = _strides(nodes, separator, doublings)
    level = links.where("up is null").drop("up")
    kids = links.where("up is not null")
    hot = hot_keys(kids, ["up"])
    is_hot = F.col("up").isin([i for (i,) in hot]) if hot else F.lit(False)
    kids = kids.select("up", F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int").alias("slot"), F.col("id").alias("kid"), F.col("depth").alias("steps"), F.col("code_path").alias("rest"))
    kids = kids.repartition(partitions(spark), "up", "slot").persist()
    reached = [level]
    try:
        while True:
            slots = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            ask = level.withColumnRenamed("id", "up").withColumn("slot", F.explode(slots))
            level = ask.join(kids, ["up", "slot"]).select(F.col("kid").alias("id"), "root_id", (F.col("depth") + F.col("steps")).alias("depth"), F.concat_ws(separator, "code_path", "rest").alias("code_path"))
            seen = Observation()
            level = materialize(level.observe(seen, F.count("*").alias("rows")), "level")
            if not seen.get["rows"]:
                break
            reached.append(level)
    finally:
        kids.unpersist()
    out = reached[0]
    for x in reached[1:]:
        out = out.unionByName(x)
    return out


def _loops(rest: DataFrame) -> DataFrame:
    """id, root_id for nodes on or below a loop: the least id on that loop, by pointer jumping."""
    jump = materialize(rest.select("id", F.col("parent").alias("to"), F.least("id", "parent").alias("low")), "jump")
    spots = -1
    while True:
        at = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        now = jump.select("to").distinct().count()
        seen = Observation()
        nxt = salted_join(jump, at, ["to"]).select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        jump = materialize(nxt.observe(seen, F.count_if("moved").alias("moved")), "jump").drop("moved")
        # The image of the jumps shrinks to the loops; it stands still when only loop nodes are left in it.
        if now == spots and not seen.get["moved"]:
            break
        spots = now
    least = jump.select(F.col("id").alias("to"), F.col("low").alias("root_id"))
    return salted_join(jump.select("id", "to"), least, ["to"]).select("id", "root_id")


def full_hierarchy(nodes: DataFrame, separator: str = ".", doublings: int = DOUBLINGS) -> DataFrame:
    """id, root_id, depth, code_path for every node of ``nodes(id, code, parent)``; loops have depth -1 and path ''."""
    nodes = _nodes(nodes)
    reached = _walk(nodes, separator, doublings)
    rest = materialize(nodes.select("id", "parent").join(reached, "id", "left_anti"), "rest")
    if rest.isEmpty():
        return reached
    loops = _loops(rest).select("id", "root_id", F.lit(-1).cast("bigint").alias("depth"), F.lit("").alias("code_path"))
    return reached.unionByName(loops)


def wbs_hierarchy(wbs: DataFrame) -> DataFrame:
    return full_hierarchy(latest_nodes(wbs)).select(F.col("id").alias("object_id"), "root_id", "depth", "code_path")


def ancestor_pairs(nodes: DataFrame, separator: str = "/") -> DataFrame:
    """ancestor, descendant, steps for all nodes outside loops (each node with itself, 0 steps).

    The path of ids holds every ancestor, so pairs are one explode of the path, with no further join.
    """
    ids = full_hierarchy(nodes.select("id", F.col("id").cast("string").alias("code"), "parent"), separator).where("depth >= 0")
    pairs = ids.select("id", "depth", F.posexplode(F.split("code_path", separator)).alias("at", "ancestor"))
    return pairs.select(F.col("ancestor").cast("bigint").alias("ancestor"), F.col("id").alias("descendant"), (F.col("depth") - F.col("at")).alias("steps"))


def descendant_pairs(wbs: DataFrame) -> DataFrame:
    """object_id, descendant_id, steps: every descendant of every entry outside loops (an entry is none of its own)."""
    pairs = ancestor_pairs(latest_nodes(wbs)).where("steps > 0")
    return pairs.select(F.col("ancestor").alias("object_id"), F.col("descendant").alias("descendant_id"), "steps")


def descendants(wbs: DataFrame) -> DataFrame:
    """object_id, n_descendants, max_steps: counted on the ancestor pairs."""
    return ancestor_pairs(latest_nodes(wbs)).groupBy(F.col("ancestor").alias("object_id")).agg((F.count("*") - 1).alias("n_descendants"), F.max("steps").alias("max_steps"))
