"""Graph patterns over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Links that a walk does not follow (fixed values).
DENIED = ("INVALIDATED_BY", "SUPERSEDES", "MENTIONED_IN", "HAS_TURN", "HAS_TOOL_CALL", "CALLED", "IN_SESSION", "HAS_SESSION")


def one_hop(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """src, dst of the edges of some types."""
    return (edges.where(F.col("rel_type").isin(types)) if types else edges).select("src", "rel_type", "dst")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a loop once."""
    back = edges.where("src <> dst").select(F.col("dst").alias("src"), "rel_type", F.col("src").alias("dst"))
    return edges.select("src", "rel_type", "dst").unionByName(back)


def walk(edges: DataFrame, starts: DataFrame, depth: int, deny: tuple[str, ...] = DENIED, keep: Column | None = None, limit: int | None = None) -> DataFrame:
    """start, dst, hops: distinct ends of directed walks of 1 to ``depth`` edges, with the fewest hops.

    ``starts`` has a column ``start``.  Denied types are dropped before the first hop; ``keep`` (a
    condition on ``dst``) applies to ends only, not to what lies between.  A start is found again where a
    ring leads back to it.  The frontier of each hop is written out, so plans stay short.  ``limit`` keeps the
    nearest ends of each start, ties by the smaller ``dst``.
    """
    scratch = Scratch(edges.sparkSession, "walk")
    step = scratch.save(edges.where(~F.col("rel_type").isin(*deny)).select(F.col("src").alias("at"), "dst").distinct())
    frontier = starts.select("start", F.col("start").alias("at")).distinct()
    seen = None
    for hop in range(1, depth + 1):
        reached = frontier.join(step, "at").select("start", "dst").distinct()
        if seen is not None:
            reached = reached.join(seen, ["start", "dst"], "left_anti")
        reached = scratch.save(reached.withColumn("hops", F.lit(hop)))
        seen = reached if seen is None else seen.unionByName(reached)
        frontier = reached.select("start", F.col("dst").alias("at"))
    seen = seen.where(keep) if keep is not None else seen
    return top_per(seen, "start", limit, F.col("hops"), F.col("dst")) if limit else seen


def chain(edges: DataFrame, starts: DataFrame, rel_type: str, longest: int = 10) -> DataFrame:
    """start, node, depth: nodes on paths of 0 to ``longest`` edges of one type."""
    ends = walk(edges.where(F.col("rel_type") == rel_type), starts, longest, deny=("",))
    zero = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    return zero.unionByName(ends.where("start <> dst").select("start", F.col("dst").alias("node"), F.col("hops").alias("depth")))


def degrees(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, out_degree, in_degree of every node."""
    out = edges.groupBy(F.col("src").alias(key)).agg(F.count("*").alias("out_degree"))
    inn = edges.groupBy(F.col("dst").alias(key)).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return nodes.select(key).join(out, key, "left").join(inn, key, "left").select(key, zero("out_degree"), zero("in_degree"))


def orphans(nodes: DataFrame, edges: DataFrame, key: str, incoming_only: bool = False) -> DataFrame:
    """Nodes without any edge, or without an incoming one."""
    linked = edges.select(F.col("dst").alias(key))
    if not incoming_only:
        linked = linked.unionByName(edges.select(F.col("src").alias(key)))
    return nodes.join(linked, key, "left_anti")


def merge_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges after merging ``new`` (set semantics); new ones need both ends and a proper name."""
    known = nodes.select(F.col(key).alias("k"))
    ok = new.where(F.col("rel_type").rlike(r"^[A-Za-z_][A-Za-z0-9_]{0,63}$"))
    ok = ok.join(known.withColumnRenamed("k", "src"), "src", "left_semi").join(known.withColumnRenamed("k", "dst"), "dst", "left_semi")
    return edges.select("src", "rel_type", "dst").unionByName(ok.select("src", "rel_type", "dst")).distinct()


def upsert(old: DataFrame, new: DataFrame, key: list[str], texts: list[str], created: list[str], given: list[str] | None = None) -> DataFrame:
    """Merge by key, nulls in it being equal: non-empty new texts overwrite, '' and null keep the old ones.

    ``created`` columns keep their first value, ``given`` ones are overwritten where the new value is not null,
    and all other columns of ``old`` stay (null in added rows).  Of several new rows for one key the largest value
    of each column holds, so that none of them multiplies; an empty ``new`` changes nothing.
    """
    given = given or []
    fold = [F.max(F.nullif(F.col(c), F.lit(""))).alias(c) for c in texts] + [F.max(c).alias(c) for c in (*created, *given)]
    b = new.groupBy(*key).agg(F.lit(True).alias("_new"), *fold).alias("b")
    a = old.withColumn("_old", F.lit(True)).alias("a")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    both = a.join(b, on, "full_outer")
    there = F.col("a._old").isNotNull()
    cols = []
    for c in old.columns:
        if c in key:
            cols.append(F.when(there, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        elif c in texts or c in given:
            cols.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
        elif c in created:
            cols.append(F.when(there, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            cols.append(F.col(f"a.{c}").alias(c))
    return both.select(*cols)


def top_per(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key; what a task ranks of a hot key is cut to ``k`` before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def ordered_chain(chains: DataFrame, ends: DataFrame) -> DataFrame:
    """start, node, depth, place: nodes of chains by their end (node, expired_at), those without one first, then by node."""
    order = F.coalesce("expired_at", F.lit("9999-12-31T00:00:00Z").cast("timestamp"))
    return chains.join(ends, "node").withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy(F.desc(order), "node"))).select("start", "node", "depth", "place")
