"""Audits of the knowledge graph: staleness, namespaces, near-duplicates, enrichment, rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..scratch import Scratch
from .graph import orphans, undirected
from .search import copies, similar_pairs


def stale(concepts: DataFrame, patches: DataFrame, at: Column, days: int) -> DataFrame:
    """concept_id, name, age_days of concepts that neither they nor their patches touched for ``days`` days."""
    newest = patches.where("has_patch").groupBy("concept_id").agg(F.max("valid_at").alias("patched"))
    last = F.greatest("updated_at", "patched")
    c = concepts.where("invalid_at is null and expired_at is null").join(newest, "concept_id", "left").withColumn("last", last)
    age = F.floor((F.unix_seconds(at) - F.unix_seconds("last")) / 86400)
    return c.where(age >= days).select("concept_id", "name", age.alias("age_days"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def namespace_stats(concepts: DataFrame, patches: DataFrame, edges: DataFrame) -> DataFrame:
    """namespace, concepts, orphans, percent: a concept without incoming edge counts once per patch (at least once)."""
    incoming = edges.select(F.col("dst").alias("concept_id")).distinct().withColumn("linked", F.lit(True))
    fan = patches.where("has_patch").groupBy("concept_id").agg(F.count("*").alias("p"))
    c = concepts.join(incoming, "concept_id", "left").join(fan, "concept_id", "left")
    weight = F.greatest(F.coalesce("p", F.lit(0)), F.lit(1))
    n, o = F.sum(weight).alias("n_rows"), F.sum(F.when(F.col("linked").isNull(), weight).otherwise(0)).alias("n_orphans")
    g = c.groupBy("namespace").agg(n, o)
    return g.withColumn("warn", F.col("n_orphans") * 100.0 / F.col("n_rows") > 25)


def foreign_majority(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts with more links into other namespaces than into their own, and more than two."""
    ns = concepts.select(F.col("concept_id").alias("dst"), F.col("namespace").alias("other_ns"))
    links = undirected(edges).join(ns, "dst").select(F.col("src").alias("concept_id"), "other_ns", "dst", "rel_type")
    c = concepts.select("concept_id", "name", "namespace").join(links, "concept_id")
    same = F.count_if(F.col("other_ns") == F.col("namespace")).alias("same")
    other = F.count_if(F.col("other_ns") != F.col("namespace")).alias("other")
    spaces = F.array_join(F.array_sort(F.collect_set(F.when(F.col("other_ns") != F.col("namespace"), F.col("other_ns")))), ",").alias("spaces")
    return c.groupBy("concept_id", "name").agg(same, other, spaces).where("other > same and other > 2")


def same_name_pairs(vectors: DataFrame, threshold: float, preferred: DataFrame | None = None, salts: int = 16) -> DataFrame:
    """vec_a, vec_b, similarity, decision, links: each further vector of a name (vec_b) with the one that stands for its class (vec_a).

    All vectors of a name are compared; those linked by a raw cosine of ``threshold`` or more, also by way
    of others, are one class and are merged into the one that stands for it: one of a concept in
    ``preferred`` (concept_id) if there is one, then the smallest id.  What stands for its own class is held
    against what stands for the name.  links counts the vectors of the name that reach the threshold.
    """
    scratch = Scratch(vectors.sparkSession, "names")
    v = vectors.where("name is not null").select("vec_id", "concept_id", "name", F.col("embedding").alias("e")).withColumn("late", F.lit(True))
    if preferred is not None:
        chosen = preferred.select("concept_id", F.lit(False).alias("early")).distinct()
        v = v.join(chosen, "concept_id", "left").withColumn("late", F.coalesce("early", F.lit(True)))
    v = scratch.save(v.withColumn("key", F.struct("late", "vec_id")).select("key", "vec_id", "name", "e"))
    # each vector meets those of every salt, so that the pairs of one name are spread over many tasks
    a = v.select("name", "vec_id", F.col("e").alias("ea"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    b = v.select("name", F.col("vec_id").alias("other"), F.col("e").alias("eb"), F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int").alias("salt"))
    near = a.join(b.hint("shuffle_hash"), ["name", "salt"]).where((F.col("vec_id") < F.col("other")) & (F.round(cosine(F.col("ea"), F.col("eb")), 6) >= threshold)).select("vec_id", "other")
    near = scratch.save(near)
    near = near.unionByName(near.select(F.col("other").alias("vec_id"), F.col("vec_id").alias("other")))
    links = near.groupBy("vec_id").agg(F.count("*").alias("links"))
    label = scratch.save(v.select("vec_id", "key").join(links, "vec_id", "left_semi"))
    while True:  # labels go along links and then along labels until none changes
        heard = near.join(label.select(F.col("vec_id").alias("other"), "key"), "other").groupBy("vec_id").agg(F.min("key").alias("k"))
        step = label.join(heard, "vec_id").select("vec_id", F.col("key").alias("was"), F.least("key", "k").alias("key"))
        step = step.join(label.select(F.col("vec_id").alias("at"), F.col("key").alias("far")), F.col("key.vec_id") == F.col("at"), "left")
        step = scratch.save(step.select("vec_id", "was", F.least("key", "far").alias("key")))
        label = step.select("vec_id", "key")
        if step.where("was <> key").isEmpty():
            break
    first = v.groupBy("name").agg(F.min("key").alias("first"))
    told = v.join(label.withColumnRenamed("key", "class"), "vec_id", "left").join(links, "vec_id", "left").join(first, "name")
    merged = F.col("class.vec_id") != F.col("vec_id")
    told = told.select(F.col("vec_id").alias("vec_b"), F.col("e").alias("eb"), F.coalesce("links", F.lit(0)).alias("links"), F.when(merged, "merge").otherwise("hold").alias("decision"), F.when(merged, F.col("class.vec_id")).otherwise(F.col("first.vec_id")).alias("vec_a"))
    told = told.where("vec_a <> vec_b").join(v.select(F.col("vec_id").alias("vec_a"), F.col("e").alias("ea")), "vec_a")
    return told.select("vec_a", "vec_b", F.round(cosine(F.col("ea"), F.col("eb")), 6).alias("similarity"), "decision", "links")


def relation_overlap(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with jaccard, the overlap of their outgoing relation types; 1 where neither has any."""
    types = edges.groupBy("src").agg(F.collect_set("rel_type").alias("t"))
    none = F.array().cast("array<string>")
    both = pairs.join(types.select(F.col("src").alias("a"), F.col("t").alias("ta")), "a", "left").join(types.select(F.col("src").alias("b"), F.col("t").alias("tb")), "b", "left")
    both = both.withColumn("ta", F.coalesce("ta", none)).withColumn("tb", F.coalesce("tb", none))
    union = F.size(F.array_union("ta", "tb"))
    return both.withColumn("jaccard", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("ta", "tb")) / union)).drop("ta", "tb")


def propose_links(lone: DataFrame, nearest: DataFrame, concepts: DataFrame, per_node: int, threshold: float, run: str) -> DataFrame:
    """Proposed edges (src, rel_type, dst, score, run) of lone concepts (concept_id): the best ``per_node`` concepts of their own namespace, else the best one of another.

    ``nearest`` (src, dst, similarity) holds pairs of concepts, ``concepts`` the names and namespaces of those that
    links may lead to.  A concept counts once, none of the lone one's own name is proposed, and scores (index
    scale) reach ``threshold``; ties go to the smaller id.
    """
    c = concepts.select("concept_id", "name", "namespace")
    best = nearest.where((1 + F.col("similarity")) / 2 >= threshold).groupBy("src", "dst").agg(F.max("similarity").alias("similarity"))
    best = best.join(lone.select(F.col("concept_id").alias("src")), "src", "left_semi")
    best = best.join(c.select(F.col("concept_id").alias("src"), F.col("name").alias("own_name"), F.col("namespace").alias("own_ns")), "src").join(c.withColumnRenamed("concept_id", "dst"), "dst")
    best = best.where("src <> dst and name <> own_name and namespace is not null and own_ns is not null").withColumn("same", F.col("namespace") == F.col("own_ns"))
    of = Window.partitionBy("src")
    best = best.withColumn("any_same", F.max("same").over(of)).where(F.col("same") == F.col("any_same"))
    best = best.withColumn("rank", F.row_number().over(of.orderBy(F.desc("similarity"), "dst"))).where(F.col("rank") <= F.when(F.col("same"), per_node).otherwise(1))
    return best.select("src", F.lit("RELATED_TO").alias("rel_type"), "dst", F.round((1 + F.col("similarity")) / 2, 6).alias("score"), F.lit(run).alias("run"))


def enrich(concepts: DataFrame, edges: DataFrame, vectors: DataFrame, per_node: int, threshold: float, run: str) -> DataFrame:
    """:func:`propose_links` for all live concepts with a vector and without any edge, out of all vectors of live concepts."""
    live = concepts.where("invalid_at is null and expired_at is null")
    v = vectors.select("vec_id", "concept_id", "embedding").join(live.select("concept_id"), "concept_id", "left_semi")
    lone = orphans(live, edges, "concept_id").select("concept_id")
    asking = v.join(lone, "concept_id", "left_semi")
    near = similar_pairs(v, 2 * threshold - 1 - 5e-7, asking=asking)
    src = asking.select(F.col("vec_id").alias("rep_a"), F.col("concept_id").alias("src"))
    dst = copies(v).select(F.col("rep").alias("rep_b"), F.col("concept_id").alias("dst")).distinct()
    return propose_links(lone, near.join(src, "rep_a").join(dst, "rep_b").select("src", "dst", "similarity"), live, per_node, threshold, run)


def rollback(edges: DataFrame, run: str | None = None) -> DataFrame:
    """Edges without those of a run, by default of the latest one."""
    if run is None:
        run = edges.agg(F.max("run")).first()[0]
    return edges if run is None else edges.where(F.col("run").isNull() | (F.col("run") != run))


def older_newer(pairs: DataFrame, concepts: DataFrame, first: int = 20) -> DataFrame:
    """older, newer, similarity of ``pairs`` (a, b, similarity): by start (a missing one last), name, namespace, id; the ``first`` most similar."""
    order = lambda p: F.struct(F.col(f"{p}.valid_at").isNull(), f"{p}.valid_at", f"{p}.name", f"{p}.namespace", f"{p}.concept_id")
    c = concepts.select("concept_id", "name", "namespace", "valid_at")
    both = pairs.where("a <> b").join(c.alias("x"), F.col("a") == F.col("x.concept_id")).join(c.alias("y"), F.col("b") == F.col("y.concept_id"))
    swap = order("x") > order("y")
    out = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("older"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("newer"), "similarity").distinct()
    return out.orderBy(F.desc("similarity"), "older", "newer").limit(first)


def between_live(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends have never ended."""
    live = concepts.where("invalid_at is null and expired_at is null").select("concept_id")
    return edges.join(live.withColumnRenamed("concept_id", "src"), "src", "left_semi").join(live.withColumnRenamed("concept_id", "dst"), "dst", "left_semi")


def knowledge_orphans(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Live concepts without any edge to another live one."""
    links = between_live(concepts, edges).where("src <> dst")
    return orphans(concepts.where("invalid_at is null and expired_at is null"), links, "concept_id")


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def enrich_effect(concepts: DataFrame, edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """before, after: knowledge orphans without and with the proposed edges."""
    more = edges.select("src", "rel_type", "dst").unionByName(proposed.select("src", "rel_type", "dst")).distinct()
    return counted({"before": knowledge_orphans(concepts, edges), "after": knowledge_orphans(concepts, more)})


def staleness_report(concepts: DataFrame, patches: DataFrame, edges: DataFrame, pairs: DataFrame, at: Column, days: int, scope: list[str], rows: int = 50) -> DataFrame:
    """kind (stale, orphan, similar), concept_id, other_id, value: the first ``rows`` of each audit, similar pairs 20, within some namespaces."""
    c = concepts.where(F.col("namespace").isin(scope))
    old = stale(c, patches, at, days).orderBy(F.desc("age_days"), "concept_id").limit(rows).select(F.lit("stale").alias("kind"), "concept_id", F.lit(None).cast("bigint").alias("other_id"), F.col("age_days").cast("double").alias("value"))
    out = edges.groupBy(F.col("src").alias("concept_id")).agg(F.count("*").alias("n"))
    lone = orphans(c.where("invalid_at is null"), edges.where("src <> dst"), "concept_id", incoming_only=True).join(out, "concept_id", "left").orderBy("name", "concept_id").limit(rows)
    lone = lone.select(F.lit("orphan").alias("kind"), "concept_id", F.lit(None).cast("bigint").alias("other_id"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))
    ids = c.select("concept_id")
    near = pairs.join(ids.withColumnRenamed("concept_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("concept_id", "b"), "b", "left_semi")
    near = older_newer(near, c).select(F.lit("similar").alias("kind"), F.col("older").alias("concept_id"), F.col("newer").alias("other_id"), "similarity")
    return old.unionByName(lone).unionByName(near.withColumnRenamed("similarity", "value"))


def duplicate_guard(new: DataFrame, vectors: DataFrame, concepts: DataFrame, threshold: float = 0.75) -> DataFrame:
    """vec_id, concept_id, similarity: of ``new`` vectors those that resemble a live concept (``threshold`` is on the index scale), with the most similar one."""
    from .search import similar_pairs

    live = concepts.where("invalid_at is null and expired_at is null").select("concept_id")
    held = vectors.join(live, "concept_id", "left_semi")
    near = similar_pairs(held, 2 * threshold - 1 - 5e-7, asking=new)
    to = copies(held).select(F.col("rep").alias("rep_b"), "concept_id").distinct()
    best = near.join(to, "rep_b").where((1 + F.col("similarity")) / 2 >= threshold).groupBy(F.col("rep_a").alias("vec_id")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "concept_id")).alias("v"))
    return best.select("vec_id", "v.concept_id", (-F.col("v.s")).alias("similarity"))


def broken_references(patches: DataFrame, files: DataFrame) -> DataFrame:
    """Patches that name a file (path) which isn't in the listing."""
    return patches.where("path <> ''").join(files.select("path"), "path", "left_anti")


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``, or an error if a key occurs twice; for the step before a write."""
    twice = duplicate_keys(df, key).limit(3).collect()
    if twice:
        raise ValueError(f"keys that occur more than once: {[tuple(r)[:-1] for r in twice]}")
    return df


def adopt_descriptions(concepts: DataFrame, merges: DataFrame) -> DataFrame:
    """Concepts after ``merges`` (duplicate, canonical): a canonical one takes the longest description of its duplicates if that is longer than its own (bytes; of equal ones the largest)."""
    text = concepts.select(F.col("concept_id").alias("duplicate"), F.struct(F.octet_length("description").alias("n"), F.col("description").alias("text")).alias("d"))
    best = merges.join(text, "duplicate").groupBy(F.col("canonical").alias("concept_id")).agg(F.max("d").alias("_best"))
    out = concepts.join(best, "concept_id", "left")
    longer = F.col("_best.n") > F.coalesce(F.octet_length("description"), F.lit(0))
    return out.withColumn("description", F.when(longer, F.col("_best.text")).otherwise(F.col("description"))).select(*concepts.columns)
