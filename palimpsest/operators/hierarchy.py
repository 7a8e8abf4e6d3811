"""Parent-child links to full hierarchies: root, depth, path and descendants of every node.

Method: some nodes are splitters, chosen by a hash of their key, as are all roots.  Every node
walks to its next splitter; the splitters alone make a reduced pointer graph, which is solved the
same way up to the roots; both distances (and path pieces) add up exactly.  Walks use pointer
doubling on tables of number pairs, written to the shared folder after each round.

A walk that can end at all ends after a round in which something ended: if a node at distance d
is still walking after k rounds, its ancestors at the distances in (2^(k-1), 2^k] end in round k.
A round in which nothing ends therefore proves that all that is left runs in rings without a
splitter; these nodes are set aside and marked.  Rings with splitters are found alike in the
reduced graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..scratch import Scratch


def _walk(scratch: Scratch, jumps: DataFrame, paths: bool) -> DataFrame:
    """Follow ``id -> ptr`` until a row that is ``done``; rows that never get there are left out.

    ``jumps``: id, ptr, dist, done (and seg, the ids from id up to but without ptr).
    """
    more = ["seg"] if paths else []

    def saved(rows: DataFrame) -> tuple[DataFrame, int]:
        """The written rows, and how many of them still walk (counted while writing)."""
        seen = Observation()
        out = scratch.save(rows.observe(seen, F.count_if(~F.col("done")).alias("left")))
        return out, seen.get["left"]

    table, n = saved(jumps)
    finished = [table.where("done")]
    active = table.where("not done")
    while n:
        target = table.select(F.col("id").alias("ptr"), F.col("ptr").alias("to"), F.col("dist").alias("far"), F.col("done").alias("end"), *[F.col(c).alias(f"{c}2") for c in more])
        step = active.drop("done").join(target, "ptr")
        step = step.select("id", F.col("to").alias("ptr"), (F.col("dist") + F.col("far")).alias("dist"), F.col("end").alias("done"), *[F.concat(c, f"{c}2").alias(c) for c in more])
        step, left = saved(step)
        finished.append(step.where("done"))
        if left == n:
            break
        # what finished so far can still be a target, the walking rows only in their new form
        table = finished[0]
        for f in finished[1:]:
            table = table.unionByName(f)
        active = step.where("not done")
        table, n = table.unionByName(active), left
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out


def hierarchy(links: DataFrame, node: str = "uuid", parent: str = "parent_uuid", paths: bool = False, splitter_every: int = 8) -> DataFrame:
    """One row per distinct non-empty ``node``: node, root, depth, in_ring (and path, from root to node).

    A node whose parent is null, '' or no node is a root of depth 0.  Nodes on a ring or below one
    have in_ring true, root '' and depth -1 (path null).  Repeated rows count once; where they give
    different parents, the largest non-empty one holds.  Null and empty nodes are left out; an empty
    table gives no rows; other columns are ignored.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    clean = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    nodes = links.select(clean(node).alias("node"), clean(parent).alias("up")).where("node is not null")
    nodes = nodes.groupBy("node").agg(F.max("up").alias("up"))
    nodes = scratch.save(nodes.withColumn("id", F.monotonically_increasing_id()))
    above = nodes.select(F.col("node").alias("up"), F.col("id").alias("pid"))
    ids = scratch.save(
        nodes.join(above, "up", "left").select("id", "pid", (F.col("pid").isNull() | (F.pmod(F.xxhash64("node"), F.lit(splitter_every)) == 0)).alias("stop"))
    )
    seg = [F.when(F.col("stop"), F.array().cast("array<bigint>")).otherwise(F.array("id")).alias("seg")] if paths else []
    first = ids.select(
        "id", F.when(F.col("stop"), F.col("id")).otherwise(F.col("pid")).alias("ptr"), F.when(F.col("stop"), 0).otherwise(1).alias("dist"), F.col("stop").alias("done"), *seg
    )
    walked = _walk(scratch, first, paths)

    splitters = ids.where("stop").select("id", "pid")
    hop = walked.select(F.col("id").alias("pid"), "ptr", "dist", *(["seg"] if paths else []))
    step = splitters.where("pid is not null").join(hop, "pid")
    own = [F.concat(F.array("id"), "seg").alias("seg")] if paths else []
    step = step.select("id", "ptr", (F.col("dist") + 1).alias("dist"), F.lit(False).alias("done"), *own)
    empty = [F.array("id").alias("seg")] if paths else []
    tops = splitters.where("pid is null").select("id", F.col("id").alias("ptr"), F.lit(0).alias("dist"), F.lit(True).alias("done"), *empty)
    solved = _walk(scratch, tops.unionByName(step), paths)

    names = nodes.select(F.col("id").alias("ptr"), F.col("node").alias("root"))
    rooted = scratch.save(solved.join(names, "ptr").select(F.col("id").alias("ptr"), "root", F.col("dist").alias("rest"), *([F.col("seg").alias("tail")] if paths else [])))
    ended = walked.join(rooted, "ptr").select("id", "root", (F.col("dist") + F.col("rest")).alias("depth"), *([F.reverse(F.concat("seg", "tail")).alias("path_ids")] if paths else []))
    out = nodes.select("id", "node").join(ended, "id", "left")
    ring = F.col("root").isNull()
    base = ["id"] if paths else []
    out = out.select(*base, "node", F.coalesce("root", F.lit("")).alias("root"), F.when(ring, -1).otherwise(F.col("depth")).cast("int").alias("depth"), ring.alias("in_ring"), *(["path_ids"] if paths else []))
    if not paths:
        return out
    out = scratch.save(out)
    pairs = out.where("path_ids is not null").select("id", F.posexplode("path_ids").alias("at", "step"))
    named = pairs.join(nodes.select(F.col("id").alias("step"), F.col("node").alias("name")), "step")
    path = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("p")).select("id", F.col("p.name").alias("path"))
    below = pairs.where("id <> step").groupBy(F.col("step").alias("id")).agg(F.count("*").alias("n_descendants"))
    return (
        out.drop("path_ids").join(path, "id", "left").join(below, "id", "left").select("node", "root", "depth", "in_ring", "path", F.coalesce("n_descendants", F.lit(0).cast("bigint")).alias("n_descendants"))
    )


def descendants(links: DataFrame, node: str = "uuid", parent: str = "parent_uuid") -> DataFrame:
    """ancestor, descendant, distance: one row per pair on a path, rings left out."""
    whole = hierarchy(links, node, parent, paths=True).where("path is not null")
    pairs = whole.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return pairs.where("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
