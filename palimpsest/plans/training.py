"""Queries of the two general training-data operators: attribute history (p1) and hierarchies (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import descendants, hierarchy
from ..operators.history import as_of, history, versions

#: What a null ``as_of`` means in the queries below, so that their results can be compared.
NOW = "2027-01-01T00:00:00Z"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _seconds(c: str):
    return F.coalesce(F.floor(F.col(c) / 1_000_000), F.lit(0)).cast("bigint")


def p1_found(spark, sf):
    h = history(_table(spark, sf, "concept_updates"))
    return h.select("concept_id", _seconds("valid_from").alias("valid_from"), _seconds("valid_to").alias("valid_to"))


def p1_versions(spark, sf):
    h = history(_table(spark, sf, "concept_updates"))
    return h.select("concept_id", _seconds("valid_from").alias("valid_from"), _seconds("valid_to").alias("valid_to"), "description", "source", "url", F.coalesce(F.unix_micros("invalid_at"), F.lit(0)).alias("invalid_at_us"), "invalidated_by", F.col("valid_from").alias("from_us"), F.coalesce(F.col("valid_to"), F.lit(0)).alias("to_us"))


def p1_asof(spark, sf):
    answered = as_of(versions(_table(spark, sf, "concept_updates")), _table(spark, sf, "temporal_queries"), now=NOW)
    return answered.select("query_id", "concept_id", _seconds("valid_from").alias("valid_from"), "description", "source", "url", "invalidated_by")


def p3_found(spark, sf):
    h = hierarchy(_table(spark, sf, "session_lines"))
    return h.select(F.col("node").alias("uuid"), F.col("root").alias("root_uuid"), "depth")


def p3_paths(spark, sf):
    h = hierarchy(_table(spark, sf, "session_lines"), paths=True)
    return h.select(F.col("node").alias("uuid"), F.array_join("path", "/").alias("path"), "n_descendants")


def p3_descendants(spark, sf):
    return descendants(_table(spark, sf, "session_lines"))


QUERIES = {f.__name__: f for f in (p1_found, p1_versions, p1_asof, p3_found, p3_paths, p3_descendants)}

_VERSIONS = """
WITH held AS (
  SELECT *, row_number() OVER (PARTITION BY concept_id, updated_at ORDER BY recorded_at DESC NULLS LAST, update_id DESC) AS rn
  FROM concept_updates WHERE updated_at IS NOT NULL AND concept_id IS NOT NULL),
clean AS (
  SELECT concept_id, updated_at, nullif(description, '') AS description, nullif(source, '') AS source, nullif(url, '') AS url,
         invalid_at, nullif(invalidated_by, '') AS invalidated_by FROM held WHERE rn = 1),
marked AS (
  SELECT *, row_number() OVER w AS k, row(description, source, url, invalid_at, invalidated_by) AS st,
         lag(row(description, source, url, invalid_at, invalidated_by)) OVER w AS before
  FROM clean WINDOW w AS (PARTITION BY concept_id ORDER BY updated_at)),
raw AS (
  SELECT *, lead(updated_at) OVER (PARTITION BY concept_id ORDER BY updated_at) AS next_at
  FROM marked WHERE k = 1 OR st IS DISTINCT FROM before),
versions AS (SELECT *, least(next_at, invalid_at) AS ended FROM raw)
"""

_CHAIN = """
WITH RECURSIVE n AS (
  SELECT uuid, max(nullif(parent_uuid, '')) AS up FROM session_lines WHERE uuid IS NOT NULL AND uuid <> '' GROUP BY uuid),
l AS (SELECT n.uuid, p.uuid AS up FROM n LEFT JOIN n p ON n.up = p.uuid),
t AS (
  SELECT uuid, uuid AS root, 0 AS depth, uuid AS path FROM l WHERE up IS NULL
  UNION ALL
  SELECT l.uuid, t.root, t.depth + 1, t.path || '/' || l.uuid FROM l JOIN t ON l.up = t.uuid)
"""

ORACLES = {
    "p1_found": _VERSIONS + """
SELECT concept_id, CAST(floor(epoch_us(updated_at) / 1000000) AS BIGINT) AS valid_from,
       CAST(coalesce(floor(epoch_us(ended) / 1000000), 0) AS BIGINT) AS valid_to
FROM versions WHERE ended IS NULL OR ended > updated_at""",
    "p1_versions": _VERSIONS + """
SELECT concept_id, CAST(floor(epoch_us(updated_at) / 1000000) AS BIGINT) AS valid_from,
       CAST(coalesce(floor(epoch_us(ended) / 1000000), 0) AS BIGINT) AS valid_to, description, source, url,
       coalesce(epoch_us(invalid_at), 0) AS invalid_at_us, invalidated_by, epoch_us(updated_at) AS from_us, coalesce(epoch_us(ended), 0) AS to_us
FROM versions WHERE ended IS NULL OR ended > updated_at""",
    "p1_asof": _VERSIONS + f""",
q AS (SELECT *, coalesce(as_of, TIMESTAMPTZ '{NOW}') AS t FROM temporal_queries),
hit AS (
  SELECT q.query_id, q.concept_id, q.t, q.include_expired, v.*, row_number() OVER (PARTITION BY q.query_id ORDER BY v.updated_at DESC) AS rn
  FROM q JOIN versions v ON v.concept_id = q.concept_id AND v.updated_at <= q.t),
force AS (SELECT * FROM hit WHERE rn = 1 AND (include_expired OR ended IS NULL OR ended > t))
SELECT q.query_id, q.concept_id, CAST(coalesce(floor(epoch_us(f.updated_at) / 1000000), 0) AS BIGINT) AS valid_from,
       f.description, f.source, f.url, f.invalidated_by
FROM q LEFT JOIN force f ON f.query_id = q.query_id""",
    "p3_found": _CHAIN + """
SELECT n.uuid, coalesce(t.root, '') AS root_uuid, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth
FROM n LEFT JOIN t ON t.uuid = n.uuid""",
    "p3_paths": _CHAIN + """,
below AS (SELECT a.uuid, count(*) AS c FROM t b, unnest(string_split(b.path, '/')) AS a(uuid) WHERE a.uuid <> b.uuid GROUP BY 1)
SELECT n.uuid, t.path, coalesce(below.c, 0) AS n_descendants
FROM n LEFT JOIN t ON t.uuid = n.uuid LEFT JOIN below ON below.uuid = n.uuid""",
    "p3_descendants": _CHAIN + """,
steps AS (SELECT uuid AS descendant, depth, unnest(string_split(path, '/')) AS ancestor, generate_subscripts(string_split(path, '/'), 1) AS k FROM t)
SELECT ancestor, descendant, CAST(depth - (k - 1) AS INTEGER) AS distance FROM steps WHERE k - 1 < depth""",
}
