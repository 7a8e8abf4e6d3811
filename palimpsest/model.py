"""The engine's tables as views over the stored ones: concepts, edges, patches, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import clean
from .scratch import Scratch, once

_LAST = ("updated_at", "recorded_at", "update_id", "name", "namespace", "description", "source", "url", "invalid_at", "invalidated_by", "reason")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    """The latest reported state of each concept; valid from its first report, expired 30 days after an explained invalidation.

    Folded once in a session, as are the edges; :func:`palimpsest.scratch.forget` has them folded anew.
    """
    return once(spark, (sf, "concepts"), lambda scratch: (scratch.save(_concepts(spark, sf)),))[0]


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, rel_type, dst between concept ids; set semantics, both ends exist."""
    return once(spark, (sf, "edges"), lambda scratch: (scratch.save(_edges(spark, sf)),))[0]


def _concepts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "concept_updates").where("updated_at is not null")
    last = rows.groupBy("concept_id").agg(F.max(F.struct(*_LAST)).alias("v"), F.min("updated_at").alias("valid_at"))
    text = [clean(F.col(f"v.{c}")).alias(c) for c in ("description", "source", "url", "invalidated_by", "reason")]
    expired = F.when(clean(F.col("v.reason")).isNotNull(), F.col("v.invalid_at") + F.expr("INTERVAL 30 DAYS")).alias("expired_at")
    return last.select("concept_id", "v.name", "v.namespace", "valid_at", "v.updated_at", "v.invalid_at", expired, *text)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    c = concepts(spark, sf)
    n = (c.agg(F.max("concept_id")).first()[0] or 0) + 1
    ids = c.select("concept_id", "name", "invalidated_by", F.lit(n).cast("bigint").alias("n"))
    links = ids.select(
        F.col("concept_id").alias("src"),
        F.explode(
            F.array(
                F.struct(F.lit("USES").alias("rel_type"), F.expr("(concept_id * 13 + 7) % n").alias("dst")),
                F.struct(F.lit("DEPENDS_ON").alias("rel_type"), F.expr("if(concept_id % 2 = 0, (concept_id * 5 + 3) % n, null)").alias("dst")),
                F.struct(F.lit("PART_OF").alias("rel_type"), F.expr("if(concept_id >= 10, cast(floor(concept_id / 10) as bigint), null)").alias("dst")),
                F.struct(F.lit("SUPERSEDES").alias("rel_type"), F.expr("if(concept_id % 4 <> 0, concept_id - 1, null)").alias("dst")),
            )
        ).alias("e"),
    ).select("src", "e.rel_type", "e.dst")
    caused = ids.where("invalidated_by is not null").select(F.col("concept_id").alias("src"), "invalidated_by")
    caused = caused.join(c.select(F.col("name").alias("invalidated_by"), F.col("concept_id").alias("dst")), "invalidated_by").select("src", F.lit("INVALIDATED_BY").alias("rel_type"), "dst")
    return links.unionByName(caused).join(c.select(F.col("concept_id").alias("dst")), "dst", "left_semi").select("src", "rel_type", "dst").distinct()


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections attached to concepts: one per quote, valid from its meeting's extraction."""
    q, m = table(spark, sf, "quotes"), table(spark, sf, "meetings")
    p = q.join(m.select("meeting_id", F.col("extracted_at").alias("valid_at")), "meeting_id")
    return p.select(
        F.col("quote_id").alias("patch_id"),
        F.concat(F.lit("patch-"), F.col("quote_id")).alias("name"),
        F.col("meeting_id").alias("concept_id"),
        clean(F.col("text")).alias("content"),
        "valid_at",
        F.expr("if(quote_id % 5 = 0, valid_at + INTERVAL 90 DAYS, null)").alias("invalid_at"),
        F.lit(None).cast("timestamp").alias("expired_at"),
        F.expr("quote_id % 3 <> 0").alias("has_patch"),
        F.expr("quote_id % 2 = 0").alias("corrects"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, concept_id, name, namespace, embedding of the usable concept vectors."""
    v = table(spark, sf, "concept_vectors")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return v.where((F.size("embedding") == 64) & ~bad & F.exists("embedding", lambda x: x != 0))


def fulltext(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The full-text index of documents or concepts: built at its first use in a session, then read."""
    from .operators.search import build_index

    def make(scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        docs = (table(spark, sf, "documents"), "doc_id", ["text"]) if name == "documents" else (concepts(spark, sf), "concept_id", ["name", "description"])
        return build_index(*docs, scratch)

    return once(spark, (sf, "fulltext", name), make)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct turn of the transcripts (its smallest row holds)."""
    lines = table(spark, sf, "session_lines").where("uuid <> ''")
    first = lines.groupBy("uuid").agg(F.min(F.struct("row_id", "session_id", "line_no", "line_type", "parent_uuid", "ts", "cwd", "git_branch", "is_sidechain")).alias("l"), F.min_by("message", "row_id").alias("message"))
    return first.select("uuid", "l.*", "message")


#: The same views for DuckDB.
SQL = """
WITH RECURSIVE concepts AS (
  SELECT concept_id, name, namespace, valid_at, updated_at, invalid_at,
         CASE WHEN nullif(reason, '') IS NOT NULL THEN invalid_at + INTERVAL 30 DAY END AS expired_at,
         nullif(description, '') AS description, nullif(source, '') AS source, nullif(url, '') AS url,
         nullif(invalidated_by, '') AS invalidated_by, nullif(reason, '') AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC, recorded_at DESC, update_id DESC) AS rn,
               min(updated_at) OVER (PARTITION BY concept_id) AS valid_at
        FROM concept_updates WHERE updated_at IS NOT NULL) WHERE rn = 1),
size AS (SELECT max(concept_id) + 1 AS n FROM concepts),
edges AS (
  SELECT DISTINCT src, rel_type, dst FROM (
    SELECT concept_id AS src, 'USES' AS rel_type, (concept_id * 13 + 7) % n AS dst FROM concepts, size
    UNION ALL SELECT concept_id, 'DEPENDS_ON', (concept_id * 5 + 3) % n FROM concepts, size WHERE concept_id % 2 = 0
    UNION ALL SELECT concept_id, 'PART_OF', concept_id // 10 FROM concepts WHERE concept_id >= 10
    UNION ALL SELECT concept_id, 'SUPERSEDES', concept_id - 1 FROM concepts WHERE concept_id % 4 <> 0
    UNION ALL SELECT a.concept_id, 'INVALIDATED_BY', b.concept_id FROM concepts a JOIN concepts b ON a.invalidated_by = b.name)
  WHERE dst IN (SELECT concept_id FROM concepts)),
patches AS (
  SELECT quote_id AS patch_id, 'patch-' || quote_id AS name, q.meeting_id AS concept_id, nullif(text, '') AS content, extracted_at AS valid_at,
         CASE WHEN quote_id % 5 = 0 THEN extracted_at + INTERVAL 90 DAY END AS invalid_at, quote_id % 3 <> 0 AS has_patch, quote_id % 2 = 0 AS corrects
  FROM quotes q JOIN meetings m ON m.meeting_id = q.meeting_id),
vectors AS (
  SELECT * FROM concept_vectors WHERE len(embedding) = 64 AND NOT list_bool_or([isnan(x) OR x IS NULL FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
turns AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY row_id) AS rn FROM session_lines WHERE uuid <> '') WHERE rn = 1)
"""
