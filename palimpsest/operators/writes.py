"""Changes as new snapshots: the changed table is returned, nothing is overwritten in place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def supersede(concepts: DataFrame, pairs: DataFrame, at: Column) -> DataFrame:
    """Concepts after ``pairs`` (new, old): an old one that is not yet expired expires at ``at``."""
    old = pairs.select(F.col("old").alias("concept_id")).distinct().withColumn("hit", F.lit(True))
    ends = F.when(F.col("expired_at").isNull() & F.col("hit"), at).otherwise(F.col("expired_at"))
    return concepts.join(old, "concept_id", "left").withColumn("expired_at", ends).drop("hit")


def invalidate(concepts: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Concepts after ``changes`` (concept_id, cause): those still valid end at ``at`` with the cause's name."""
    c = changes.groupBy("concept_id").agg(F.min("cause").alias("cause"))
    hit = F.col("cause").isNotNull() & F.col("invalid_at").isNull()
    out = concepts.join(c, "concept_id", "left").withColumn("invalidated_by", F.when(hit, F.col("cause")).otherwise(F.col("invalidated_by")))
    return out.withColumn("invalid_at", F.when(hit, at).otherwise(F.col("invalid_at"))).drop("cause")


def move(concepts: DataFrame, prefix: str, to: str) -> DataFrame:
    """Concepts whose name starts with ``prefix`` (taken literally) and -, _ or : get another namespace."""
    return concepts.withColumn("namespace", F.when(F.col("name").rlike(rf"(?is)^{re.escape(prefix)}[-_:].*$"), F.lit(to)).otherwise(F.col("namespace")))


def delete_cascade(parents: DataFrame, children: list[DataFrame], key: str, gone: DataFrame) -> list[DataFrame]:
    """Parents and their children without the keys in ``gone``."""
    return [t.join(gone.select(key), key, "left_anti") for t in (parents, *children)]


def migrate(df: DataFrame, now: Column, namespace: str = "global") -> DataFrame:
    """Missing namespaces become global, missing starts the creation or now."""
    return df.withColumn("namespace", F.coalesce("namespace", F.lit(namespace))).withColumn("valid_at", F.coalesce("valid_at", "updated_at", now))


def apply_merges(concepts: DataFrame, merges: DataFrame, at: Column, run: str) -> DataFrame:
    """Concepts after ``merges`` (duplicate, canonical): live duplicates expire, naming what they were merged into and the run; earlier runs stay."""
    for c, kind in (("merged_into", "bigint"), ("merge_run", "string")):
        if c not in concepts.columns:
            concepts = concepts.withColumn(c, F.lit(None).cast(kind))
    m = merges.groupBy("duplicate").agg(F.min("canonical").alias("_into")).withColumnRenamed("duplicate", "concept_id")
    hit = F.col("_into").isNotNull() & F.col("expired_at").isNull()
    new = {"merged_into": F.col("_into"), "merge_run": F.lit(run), "expired_at": at}
    out = concepts.join(m, "concept_id", "left").withColumn("_hit", hit)
    return out.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_into", "_hit")


def undo_merges(concepts: DataFrame, run: str) -> DataFrame:
    """Concepts as before a run of merges: its duplicates live again."""
    kept = ~F.coalesce(F.col("merge_run") == run, F.lit(False))
    return concepts.withColumn("_kept", kept).withColumns({c: F.when(F.col("_kept"), F.col(c)) for c in ("expired_at", "merged_into", "merge_run")}).drop("_kept")


def set_columns(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` after ``changes`` (key, columns): values that aren't null overwrite; unknown keys change nothing, of several changes the largest value holds."""
    new = changes.groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    out = old.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns]).select(*old.columns)


def unmatched(changes: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The changes that name no known row."""
    return changes.join(old.select(key), key, "left_anti")


def upsert_patches(patches: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Patches after ``new`` (name, content, ...): a patch that is added again starts anew at ``at`` and is in force again; '' keeps its content."""
    fresh = new.groupBy("name").agg(F.max(F.nullif(F.col("content"), F.lit(""))).alias("_content")).withColumn("_new", F.lit(True))
    both = patches.withColumn("_old", F.lit(True)).join(fresh, "name", "full_outer").withColumn("_new", F.coalesce("_new", F.lit(False)))
    set_ = {"content": F.coalesce("_content", "content"), "valid_at": F.when(F.col("_new"), at).otherwise(F.col("valid_at"))}
    set_ |= {c: F.when(~F.col("_new"), F.col(c)) for c in ("invalid_at", "expired_at") if c in patches.columns}
    return both.withColumns(set_).select(*patches.columns)


def invalidation_edges(changes: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``changes`` (concept_id, cause): edges to the concepts that causes name, and (concept_id, reason) for causes in free words."""
    known = concepts.groupBy(F.col("name").alias("cause")).agg(F.min("concept_id").alias("dst"))
    both = changes.where("cause <> ''").join(known, "cause", "left")
    edges = both.where("dst is not null and dst <> concept_id").select(F.col("concept_id").alias("src"), F.lit("INVALIDATED_BY").alias("rel_type"), "dst").distinct()
    return edges, both.where("dst is null").select("concept_id", F.col("cause").alias("reason")).distinct()


def supersession_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges after ``pairs`` (new, old), as a set."""
    return edges.select("src", "rel_type", "dst").unionByName(pairs.select(F.col("new").alias("src"), F.lit("SUPERSEDES").alias("rel_type"), F.col("old").alias("dst"))).distinct()


def move_patches(patches: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Patches (concept_id, namespace) follow their concept to its new namespace if they were in its old one."""
    moved = before.select("concept_id", F.col("namespace").alias("_from")).join(after.select("concept_id", F.col("namespace").alias("_to")), "concept_id").where("not (_from <=> _to)")
    out = patches.join(moved, "concept_id", "left").withColumn("namespace", F.when(F.col("_from").eqNullSafe(F.col("namespace")) & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("namespace")))
    return out.select(*patches.columns)


def upsert_sources(sources: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Sources (url, name, created_at, last_indexed) after ``new`` (url, name): a known one keeps its creation, all of ``new`` are indexed at ``at``."""
    fresh = new.groupBy("url").agg(F.max(F.nullif(F.col("name"), F.lit(""))).alias("_name")).withColumn("_new", F.lit(True))
    both = sources.join(fresh, "url", "full_outer")
    return both.select("url", F.coalesce("_name", "name").alias("name"), F.coalesce("created_at", F.when(F.col("_new"), at)).alias("created_at"), F.when(F.col("_new"), at).otherwise(F.col("last_indexed")).alias("last_indexed"))


def detach(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str, end: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Nodes without those in ``gone``, and edges without those that end there."""
    keys = gone.select(key).distinct()
    return nodes.join(keys, key, "left_anti"), edges.join(keys.withColumnRenamed(key, end), end, "left_anti")


def merge_seen(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, first_seen, last_seen) of both tables, one per key, from the first to the last time it was seen."""
    both = old.select(*key, "first_seen", "last_seen").unionByName(new.select(*key, "first_seen", "last_seen"))
    return both.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of equal keys in ``new`` the largest row holds."""
    whole = F.struct(*[c for c in old.columns if c != key])
    last = new.groupBy(key).agg(F.max(whole).alias("v")).select(key, "v.*").select(*old.columns)
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(last)


def save_state(state: DataFrame, listing: DataFrame) -> DataFrame:
    """State (path, mtime) after a run over ``listing``: the listing's times hold, files that are gone stay known."""
    return replace_rows(state.select("path", "mtime"), listing.select("path", "mtime"), "path")
