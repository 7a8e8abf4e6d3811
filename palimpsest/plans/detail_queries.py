"""Queries of smaller parts: reports, limits, replies, caches, searches over turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import scalars, temporal
from ..operators import audit, graph, search, sessions
from ..scratch import once
from ..sources import readers
from . import search_queries
from ._register import Registry
from .graph_queries import _WALK, AT, NOW
from .search_queries import _KNN, _TEXT, ASKED, TOKEN_SQL
from .transcript_queries import _TEXT as _SAID

q = Registry(model.SQL)


def _at(text: str = AT):
    return F.lit(text).cast("timestamp")


@q("SELECT namespace, place, round(avg(v), 6) AS mean FROM (SELECT namespace, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS place FROM (SELECT *, first_value(len(embedding)) OVER (PARTITION BY namespace ORDER BY vec_id) AS n FROM concept_vectors WHERE namespace IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or([coalesce(isnan(x), true) FOR x IN embedding])) WHERE len(embedding) = n) GROUP BY 1, 2", plain=True)
def centroid_first_dimension(spark, sf):
    """Means of vectors of several lengths: those as long as a group's first count."""
    v = model.table(spark, sf, "concept_vectors").where(F.col("namespace").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    m = sessions.centroid(sessions.first_dimension(v, "namespace", "vec_id"), "namespace")
    return m.select("namespace", F.col("at").alias("place"), F.round("mean", 6).alias("mean"))


@q("SELECT (SELECT count(*) FROM concepts) AS concepts, (SELECT count(*) FROM concepts WHERE invalid_at IS NULL AND expired_at IS NULL) AS live, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM patches) AS patches, (SELECT count(*) FROM patches WHERE content IS NULL) AS empty_patches, (SELECT count(*) FROM concepts WHERE concept_id NOT IN (SELECT concept_id FROM vectors WHERE concept_id IS NOT NULL)) AS without_vector, (SELECT count(*) FROM concepts WHERE description IS NULL) AS without_description, (SELECT count(*) FROM turns) AS turns, (SELECT count(DISTINCT session_id) FROM session_lines) AS sessions")
def health_report(spark, sf):
    """One row of counts; each is an aggregate of its own table."""
    c, p = model.concepts(spark, sf), model.patches(spark, sf)
    return audit.counted({
        "concepts": c, "live": c.where(temporal.never_ended()), "edges": model.edges(spark, sf), "patches": p, "empty_patches": p.where("content is null"),
        "without_vector": c.join(model.vectors(spark, sf).select("concept_id"), "concept_id", "left_anti"), "without_description": c.where("description is null"),
        "turns": model.turns(spark, sf), "sessions": model.table(spark, sf, "session_lines").where("session_id is not null").select("session_id").distinct(),
    })


_LIVE = f"(invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '{AT}') AND (expired_at IS NULL OR expired_at > TIMESTAMPTZ '{AT}') AND c.namespace IN ('global', 'atlas', 'intake')"
_HYBRID = _TEXT + ", " + _KNN + f", kw AS (SELECT c.name, c.namespace, rank AS ra FROM (SELECT concept_id, row_number() OVER (ORDER BY round(score, 6) DESC, concept_id) AS rank FROM scored) s JOIN concepts c ON c.concept_id = s.concept_id WHERE rank <= 20 AND {_LIVE}), vc AS (SELECT c.name, c.namespace, min(rank) AS rb FROM knn k JOIN concepts c ON c.concept_id = k.concept_id WHERE rank <= 20 AND {_LIVE} GROUP BY 1, 2), fused AS (SELECT coalesce(kw.name, vc.name) AS name, coalesce(kw.namespace, vc.namespace) AS namespace, round(least((coalesce(0.4::DOUBLE / (60 + ra), 0) + coalesce(0.6::DOUBLE / (60 + rb), 0)) * 61, 1.0::DOUBLE), 6) AS similarity FROM kw FULL JOIN vc ON kw.name = vc.name AND kw.namespace = vc.namespace)"


@q("SELECT name, namespace, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, name, namespace) AS rn FROM fused) WHERE rn <= 5", more=_HYBRID)
def hybrid_search(spark, sf):
    """Full text and vector, both filtered after their limits, fused and cut."""
    c = model.concepts(spark, sf).where(temporal.not_ended(_at()) & temporal.in_namespaces(["global", "atlas", "intake"])).select("concept_id", "name", "namespace")
    text = search.search_index(*model.fulltext(spark, sf, "concepts"), ASKED, {"name": 3.0, "description": 1.0}).select(F.col("key").alias("concept_id"), F.round("score", 6).alias("score"))
    kw = search.top(text, 20, F.desc("score"), F.col("concept_id")).join(c, "concept_id").select("name", "namespace", "rank")
    near = search.nearest(model.vectors(spark, sf).select("vec_id", "concept_id", "embedding"), search_queries._query_vector(spark, sf), 20)
    vec = near.join(c, "concept_id").groupBy("name", "namespace").agg(F.min("rank").alias("rank"))
    fused = search.fuse(kw, vec, ASKED).withColumn("similarity", F.round("similarity", 6))
    return fused.orderBy(F.desc("similarity"), "name", "namespace").limit(5)


@q("SELECT concept_id, suggestion FROM (SELECT e.src AS concept_id, b.name AS suggestion, row_number() OVER (PARTITION BY e.src ORDER BY b.name) AS rn FROM (SELECT src, dst FROM edges WHERE rel_type IN ('USES', 'PART_OF', 'DEPENDS_ON') UNION SELECT dst, src FROM edges WHERE rel_type IN ('USES', 'PART_OF', 'DEPENDS_ON')) e JOIN (SELECT concept_id, name FROM concepts) b ON b.concept_id = e.dst) WHERE rn <= 2")
def suggestions_first(spark, sf):
    """The first names next to each concept."""
    e = graph.undirected(graph.one_hop(model.edges(spark, sf), ["USES", "PART_OF", "DEPENDS_ON"])).select("src", "dst").distinct()
    c = model.concepts(spark, sf).select(F.col("concept_id").alias("dst"), F.col("name").alias("suggestion"))
    return graph.top_per(e.join(c, "dst").select(F.col("src").alias("concept_id"), "suggestion"), "concept_id", 2, F.col("suggestion"))


@q("SELECT start, dst, hops FROM (SELECT start, spot AS dst, min(hops) AS hops, row_number() OVER (PARTITION BY start ORDER BY min(hops), spot) AS rn FROM w WHERE hops > 0 GROUP BY 1, 2) WHERE rn <= 3", more=_WALK.format(d=2))
def walk_limited(spark, sf):
    """The three nearest ends of each walk."""
    starts = model.concepts(spark, sf).select(F.col("concept_id").alias("start"))
    return graph.walk(model.edges(spark, sf), starts, 2, limit=3)


@q("SELECT concept_id, CASE WHEN strlen(t) > coalesce(strlen(description), 0) THEN t ELSE description END AS description FROM concepts LEFT JOIN (SELECT concept_id // 3 * 3 AS id, arg_max(description, (strlen(description), description)) AS t FROM concepts WHERE concept_id % 3 <> 0 AND description IS NOT NULL GROUP BY 1) b ON b.id = concept_id")
def adopted_descriptions(spark, sf):
    c = model.concepts(spark, sf)
    merges = c.where("concept_id % 3 <> 0 and description is not null").select(F.col("concept_id").alias("duplicate"), F.expr("concept_id - concept_id % 3").alias("canonical"))
    return audit.adopt_descriptions(c, merges).select("concept_id", "description")


@q(f"SELECT url, content, CAST(epoch(seen) AS BIGINT) AS fetched_at FROM (SELECT url, max(description) AS content, max(updated_at) AS seen FROM concepts WHERE url IS NOT NULL AND NOT contains(url, '1') GROUP BY 1) WHERE epoch(TIMESTAMPTZ '{NOW}') - floor(epoch(seen)) <= 86400 * 500 UNION ALL SELECT DISTINCT url, 'fetched', CAST(epoch(TIMESTAMPTZ '{NOW}') AS BIGINT) FROM concepts WHERE contains(url, '1')")
def cache_write(spark, sf):
    """Pages fetched again, then entries that are too old dropped."""
    c = model.concepts(spark, sf).where("url is not null")
    cache = c.groupBy("url").agg(F.max("description").alias("content"), F.max("updated_at").alias("fetched_at"))
    new = c.where(F.contains("url", F.lit("1"))).select("url", F.lit("fetched").alias("content"))
    out = readers.cache_sweep(readers.cache_put(cache, new, _at(NOW)), _at(NOW), 86400 * 500)
    return out.select("url", "content", F.unix_seconds("fetched_at").alias("fetched_at"))


@q("SELECT topic_id, x AS name FROM (SELECT topic_id, unnest(list_distinct([replace(lower(trim(p, ' ')), ' ', '-') FOR p IN string_split(reply, ',')])) AS x FROM (SELECT topic_id, CASE WHEN topic_id % 5 = 0 THEN 'NONE' ELSE coalesce(name, '') || ', ' || coalesce(normalized_name, '') || ', api, the code' END AS reply FROM topics) WHERE trim(reply, ' ') <> 'NONE') WHERE strlen(x) BETWEEN 3 AND 60 AND regexp_full_match(x, '[\\p{L}\\p{N}-]+') AND x NOT IN ('type', 'system', 'hook', 'subtype', 'empty', 'none', 'database', 'api', 'code', 'app', 'stuff', 'things', 'service', 'domain', 'generic', 'term', 'concept')", plain=True)
def extracted_names(spark, sf):
    """Names out of replies that list them with commas, or say NONE."""
    t = model.table(spark, sf, "topics")
    reply = F.when(F.col("topic_id") % 5 == 0, "NONE").otherwise(F.concat(F.coalesce("name", F.lit("")), F.lit(", "), F.coalesce("normalized_name", F.lit("")), F.lit(", api, the code")))
    return sessions.listed_names(t.select("topic_id", reply.alias("reply")), "reply").select("topic_id", "name")


@q("SELECT row_id, CASE WHEN row_id % 2 = 0 THEN line_type ELSE 'not json: ' || coalesce(line_type, '') END AS answer FROM session_lines", plain=True)
def answers(spark, sf):
    """Replies that are JSON with an answer, or else plain text."""
    t = model.table(spark, sf, "session_lines")
    reply = F.when(F.col("row_id") % 2 == 0, F.to_json(F.struct(F.col("line_type").alias("answer")))).otherwise(F.concat(F.lit("not json: "), F.coalesce("line_type", F.lit(""))))
    return t.select("row_id", reply.alias("r"), "line_type").select("row_id", F.when(F.try_parse_json("r").isNotNull(), F.get_json_object("r", "$.answer")).otherwise(F.col("r")).alias("answer"))


@q("SELECT uuid, tool_call, nullif(input->>'$.file_path', '') AS path, nullif(trim(input->>'$.command'), '') AS command FROM (SELECT uuid, b.id AS tool_call, b.input AS input FROM (SELECT uuid, unnest(message.blocks) AS b FROM turns) WHERE b.block_type = 'tool_use')")
def typed_fields(spark, sf):
    """Fields of tool inputs, empty ones as null."""
    b = sessions.blocks(model.turns(spark, sf), "tool_use")
    get = lambda k: scalars.clean(F.trim(F.get_json_object("b.input", f"$.{k}")))
    return b.select("uuid", F.col("b.id").alias("tool_call"), get("file_path").alias("path"), get("command").alias("command"))


@q("SELECT lower(pattern) AS pattern, min(level) AS level FROM (SELECT label AS pattern, 0 AS level FROM topic_reference WHERE canon_id % 2 = 0 UNION ALL SELECT normalized_name, 1 FROM topic_reference UNION ALL SELECT upper(label), 2 FROM topic_reference) GROUP BY 1", plain=True)
def trigger_levels(spark, sf):
    """Patterns of several levels merged, the first level that has one counts."""
    r = model.table(spark, sf, "topic_reference")
    parts = [r.where("canon_id % 2 = 0").select(F.col("label").alias("pattern"), F.lit(0).alias("level")), r.select("normalized_name", F.lit(1)), r.select(F.upper("label"), F.lit(2))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy(F.lower("pattern").alias("pattern")).agg(F.min("level").alias("level"))


def _turn_index(spark, sf):
    said = model.turns(spark, sf).select("uuid", sessions.turn_text().alias("text")).where("text is not null")
    return once(spark, (sf, "fulltext", "turns"), lambda scratch: search.build_index(said, "uuid", ["text"], scratch))


_TURNS = rf"said AS (SELECT uuid, row_id, {_SAID} AS text FROM turns WHERE {_SAID} IS NOT NULL), w AS (SELECT uuid, row_id, regexp_extract_all(lower(text), '{TOKEN_SQL}') AS t FROM said), s AS (SELECT count(*)::DOUBLE AS docs, avg(len(t)) AS average FROM w WHERE len(t) > 0), h AS (SELECT uuid, len(t) AS n, len(list_filter(t, lambda x: x = 'gateway')) AS tf FROM w), ft AS (SELECT uuid, score FROM (SELECT uuid, round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / average)), 6) AS score, row_number() OVER (ORDER BY round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / average)), 6) DESC, uuid) AS rn FROM (SELECT *, count(*) OVER () AS df FROM h WHERE tf > 0), s) WHERE rn <= 20), vt AS (SELECT uuid, (1 + similarity) / 2 AS score FROM (SELECT t.uuid, k.similarity, row_number() OVER (ORDER BY k.similarity DESC, k.vec_id) AS rn FROM knn k JOIN turns t ON t.row_id = k.vec_id) WHERE rn <= 20)"


@q("SELECT coalesce(ft.uuid, vt.uuid) AS uuid, round(CASE WHEN ft.score IS NOT NULL AND vt.score IS NOT NULL THEN (ft.score + vt.score) / 2 ELSE coalesce(ft.score, vt.score * 0.8::DOUBLE) END, 6) AS score FROM ft FULL JOIN vt ON ft.uuid = vt.uuid", more=_KNN + ", " + _TURNS)
def turn_search(spark, sf):
    """Turns by words and by vectors, both scores averaged."""
    text = search.search_index(*_turn_index(spark, sf), "gateway", {"text": 1.0}).select(F.col("key").alias("uuid"), F.round("score", 6).alias("score"))
    text = search.top(text, 20, F.desc("score"), F.col("uuid")).select("uuid", "score")
    own = model.vectors(spark, sf).select("vec_id", "embedding").join(model.turns(spark, sf).select(F.col("row_id").alias("vec_id"), "uuid"), "vec_id")
    near = search.nearest(own, search_queries._query_vector(spark, sf), 20).select("uuid", "score")
    return search.average(text, near, "uuid").withColumn("score", F.round("score", 6))


QUERIES, ORACLES = q.queries, q.oracles
