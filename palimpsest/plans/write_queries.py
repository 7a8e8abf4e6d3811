"""Queries of the write layer: upserts, links, invalidation, moves, sources, triggers, transcripts, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import audit, graph, sessions, writes
from ._register import Registry
from .graph_queries import AT, NOW

q = Registry(model.SQL)
_T, _N = f"TIMESTAMPTZ '{AT}'", f"TIMESTAMPTZ '{NOW}'"


def _at(text: str = AT):
    return F.lit(text).cast("timestamp")


def _s(c: str):
    return F.unix_seconds(c).alias(c)


@q("SELECT concept_id, CASE WHEN concept_id % 3 = 0 THEN 'set by hand' ELSE description END AS description FROM concepts")
def update_descriptions(spark, sf):
    c = model.concepts(spark, sf)
    changes = c.where("concept_id % 3 = 0").select("concept_id", F.lit("set by hand").alias("description")).unionByName(spark.createDataFrame([(-1, "nobody")], "concept_id bigint, description string"))
    return writes.set_columns(c, changes, "concept_id", ["description"]).select("concept_id", "description")


@q("SELECT vec_id, concept_id FROM vectors WHERE concept_id IS NOT NULL AND concept_id NOT IN (SELECT concept_id FROM concepts)")
def update_unmatched(spark, sf):
    v = model.vectors(spark, sf).where("concept_id is not null").select("vec_id", "concept_id")
    return writes.unmatched(v, model.concepts(spark, sf), "concept_id").select("vec_id", "concept_id")


@q("SELECT concept_id, coalesce(v.s, 0) AS numbers FROM concepts LEFT JOIN (SELECT concept_id AS id, max(len(embedding)) AS s FROM vectors GROUP BY 1) v ON v.id = concept_id")
def update_embeddings(spark, sf):
    """Vectors written onto their concepts; the others keep none."""
    c = model.concepts(spark, sf).select("concept_id", F.lit(None).cast("array<float>").alias("embedding"))
    v = model.vectors(spark, sf).where("concept_id is not null").select("concept_id", "embedding")
    return writes.set_columns(c, v, "concept_id", ["embedding"]).select("concept_id", F.when(F.col("embedding").isNull(), 0).otherwise(F.size("embedding")).cast("bigint").alias("numbers"))


@q(f"SELECT name, CASE WHEN patch_id % 6 = 0 THEN 'again' ELSE content END AS content, CAST(epoch(CASE WHEN patch_id % 3 = 0 THEN {_N} ELSE valid_at END) AS BIGINT) AS valid_at, CAST(epoch(CASE WHEN patch_id % 3 <> 0 THEN invalid_at END) AS BIGINT) AS invalid_at FROM patches UNION ALL SELECT 'patch-new', 'fresh', CAST(epoch({_N}) AS BIGINT), NULL")
def patch_upsert(spark, sf):
    """Adding a patch again resets its start and clears its end."""
    p = model.patches(spark, sf)
    new = p.where("patch_id % 3 = 0").select("name", F.when(F.col("patch_id") % 6 == 0, "again").otherwise("").alias("content")).unionByName(spark.createDataFrame([("patch-new", "fresh")], "name string, content string"))
    return writes.upsert_patches(p, new, _at(NOW)).select("name", "content", _s("valid_at"), _s("invalid_at"))


@q("SELECT DISTINCT c.concept_id AS src, 'HAS_PATCH' AS rel_type, p.patch_id AS dst FROM patches p JOIN concepts c ON c.concept_id = p.concept_id WHERE p.has_patch OR p.patch_id % 4 = 1")
def link_patches(spark, sf):
    c, p = model.concepts(spark, sf), model.patches(spark, sf)
    old = p.where("has_patch").join(c, "concept_id", "left_semi").select(F.col("concept_id").alias("src"), F.lit("HAS_PATCH").alias("rel_type"), F.col("patch_id").alias("dst"))
    new = p.where("patch_id % 4 = 1").select(F.col("concept_id").alias("src"), F.lit("HAS_PATCH").alias("rel_type"), F.col("patch_id").alias("dst")).join(c.select(F.col("concept_id").alias("src")), "src", "left_semi")
    return old.unionByName(new).distinct()


@q("SELECT lower(name) AS trigger, max(concept_id) AS concept_id FROM concepts WHERE concept_id % 7 <> 0 GROUP BY 1")
def trigger_writes(spark, sf):
    """Triggers upserted by name, then every seventh concept's deleted."""
    c = model.concepts(spark, sf).select(F.lower("name").alias("trigger"), "concept_id")
    old = c.where("concept_id % 7 <> 0").groupBy("trigger").agg(F.min("concept_id").alias("concept_id"))
    kept = writes.replace_rows(old, c, "trigger")
    gone = c.groupBy("trigger").agg(F.bool_and(F.col("concept_id") % 7 == 0).alias("gone")).where("gone")
    alive = c.where("concept_id % 7 <> 0").groupBy("trigger").agg(F.max("concept_id").alias("concept_id"))
    return writes.replace_rows(kept.join(gone, "trigger", "left_anti"), alive, "trigger")


_SOURCES = "src AS (SELECT url, max(source) AS name, min(valid_at) AS created_at FROM concepts WHERE url IS NOT NULL GROUP BY 1), fresh AS (SELECT DISTINCT url FROM concepts WHERE url IS NOT NULL AND concept_id % 2 = 0 UNION SELECT 'https://new.example/page')"


def _sources(spark, sf):
    c = model.concepts(spark, sf).where("url is not null")
    return c.groupBy("url").agg(F.max("source").alias("name"), F.min("valid_at").alias("created_at")).withColumn("last_indexed", F.lit(None).cast("timestamp"))


@q(f"SELECT coalesce(s.url, f.url) AS url, coalesce(CASE WHEN f.url IS NOT NULL THEN 'renamed' END, s.name) AS name, CAST(epoch(coalesce(s.created_at, {_N})) AS BIGINT) AS created_at, CASE WHEN f.url IS NOT NULL THEN CAST(epoch({_N}) AS BIGINT) END AS last_indexed FROM src s FULL JOIN fresh f ON f.url = s.url", more=_SOURCES)
def source_upsert(spark, sf):
    new = model.concepts(spark, sf).where("url is not null and concept_id % 2 = 0").select("url").union(spark.createDataFrame([("https://new.example/page",)], "url string"))
    out = writes.upsert_sources(_sources(spark, sf), new.select("url", F.lit("renamed").alias("name")), _at(NOW))
    return out.select("url", "name", _s("created_at"), _s("last_indexed"))


@q("SELECT (SELECT count(*) FROM src WHERE NOT contains(url, '1')) AS sources, (SELECT count(*) FROM concepts WHERE url IS NOT NULL AND NOT contains(url, '1')) AS links", more=_SOURCES)
def source_detach(spark, sf):
    s = _sources(spark, sf)
    links = model.concepts(spark, sf).where("url is not null").select(F.col("concept_id").alias("src"), F.col("url").alias("dst"))
    nodes, edges = writes.detach(s, links, s.where(F.contains("url", F.lit("1"))), "url")
    return audit.counted({"sources": nodes, "links": edges})


_CAUSES = "causes AS (SELECT concept_id, CASE WHEN concept_id % 4 = 0 THEN 'moved elsewhere' ELSE (SELECT min(name) FROM concepts) END AS cause FROM concepts WHERE concept_id % 2 = 0), target AS (SELECT min(concept_id) AS id FROM concepts WHERE name = (SELECT min(name) FROM concepts))"


def _causes(spark, sf):
    c = model.concepts(spark, sf)
    first = c.select(F.min("name")).first()[0]
    return c, c.where("concept_id % 2 = 0").select("concept_id", F.when(F.col("concept_id") % 4 == 0, "moved elsewhere").otherwise(F.lit(first)).alias("cause"))


@q("SELECT concept_id AS src, 'INVALIDATED_BY' AS rel_type, id AS dst FROM causes, target WHERE cause <> 'moved elsewhere' AND concept_id <> id", more=_CAUSES)
def invalidate_edges(spark, sf):
    c, changes = _causes(spark, sf)
    return writes.invalidation_edges(changes, c)[0]


@q("SELECT concept_id, cause AS reason FROM causes WHERE cause = 'moved elsewhere'", more=_CAUSES)
def invalidate_free_text(spark, sf):
    c, changes = _causes(spark, sf)
    return writes.invalidation_edges(changes, c)[1]


@q("SELECT src, rel_type, dst FROM edges UNION SELECT concept_id + 1, 'SUPERSEDES', concept_id FROM concepts WHERE concept_id % 5 = 0")
def supersede_edges(spark, sf):
    pairs = model.concepts(spark, sf).where("concept_id % 5 = 0").select((F.col("concept_id") + 1).alias("new"), F.col("concept_id").alias("old"))
    return writes.supersession_edges(model.edges(spark, sf), pairs)


@q("SELECT p.patch_id, CASE WHEN regexp_full_match(c.name, '(?i)linear[-_:].*') AND c.namespace = n.namespace THEN 'lab' ELSE n.namespace END AS namespace FROM patches p JOIN concepts c ON c.concept_id = p.concept_id JOIN (SELECT patch_id, CASE WHEN patch_id % 3 = 0 THEN 'elsewhere' ELSE c.namespace END AS namespace FROM patches p JOIN concepts c ON c.concept_id = p.concept_id) n ON n.patch_id = p.patch_id")
def move_cascade(spark, sf):
    """A moved concept takes along the patches of its old namespace."""
    c = model.concepts(spark, sf)
    p = model.patches(spark, sf).join(c.select("concept_id", "namespace"), "concept_id").withColumn("namespace", F.when(F.col("patch_id") % 3 == 0, "elsewhere").otherwise(F.col("namespace")))
    return writes.move_patches(p, c, writes.move(c, "linear", "lab")).select("patch_id", "namespace")


@q("SELECT patch_id, CASE WHEN patch_id % 5 = 0 THEN NULL WHEN patch_id % 5 = 1 THEN 'from file ' || patch_id ELSE content END AS content FROM patches")
def patch_contents(spark, sf):
    """Content cleared for some patches and set for others."""
    p = model.patches(spark, sf).withColumn("content", F.when(F.col("patch_id") % 5 != 0, F.col("content")))
    new = p.where("patch_id % 5 = 1").select("patch_id", F.concat(F.lit("from file "), "patch_id").alias("content"))
    return writes.set_columns(p, new, "patch_id", ["content"]).select("patch_id", "content")


def mentioned(spark, sf):
    """Edges from sessions to the concepts that the last two words of their summaries name."""
    words = F.split(F.lower("summary"), " ")
    said = model.table(spark, sf, "session_lines").where("summary <> ''").select("session_id", F.array_join(F.when(F.size(words) > 2, F.slice(words, -2, 2)).otherwise(words), "-").alias("word")).distinct()
    c = model.concepts(spark, sf).select(F.regexp_replace(F.lower("name"), "-[0-9]+$", "").alias("word"), "concept_id")
    return said.join(c, "word").select(F.col("session_id").alias("src"), F.lit("MENTIONED_IN").alias("rel_type"), F.col("concept_id").alias("dst")).distinct()


# -- transcripts ------------------------------------------------------------------------------
@q("SELECT session_id, min(ingested_at) AS first_seen, max(ingested_at) AS last_seen FROM session_lines GROUP BY 1", plain=True)
def session_upsert(spark, sf):
    """A second batch merged into the sessions of the first."""
    lines = model.table(spark, sf, "session_lines")
    seen = lambda half: lines.where(F.col("row_id") % 2 == half).groupBy("session_id").agg(F.min("ingested_at").alias("first_seen"), F.max("ingested_at").alias("last_seen"))
    return writes.merge_seen(seen(0), seen(1), ["session_id"])


_BLOCKS = "bl AS (SELECT uuid, session_id, row_id, ingested_at, unnest(message.blocks) AS b FROM turns), calls AS (SELECT * FROM (SELECT b.id AS tool_call_id, uuid, session_id, b.name AS name, b.input AS input, ingested_at, row_number() OVER (PARTITION BY b.id ORDER BY uuid, session_id) AS rn FROM bl WHERE b.block_type = 'tool_use' AND b.id <> '') WHERE rn = 1)"


@q("SELECT cmd, min(row_id) AS first_seen, max(row_id) AS last_seen FROM (SELECT trim(b.input->>'$.command') AS cmd, row_id FROM bl WHERE b.block_type = 'tool_use' AND b.name = 'Bash') WHERE cmd <> '' GROUP BY 1", more=_BLOCKS)
def command_upsert(spark, sf):
    t = model.turns(spark, sf)
    b = t.select("row_id", F.explode("message.blocks").alias("b")).where("b.block_type = 'tool_use' and b.name = 'Bash'").select("row_id", F.trim(F.get_json_object("b.input", "$.command")).alias("cmd")).where("cmd <> ''")
    seen = lambda half: b.where(F.col("row_id") % 2 == half).groupBy("cmd").agg(F.min("row_id").alias("first_seen"), F.max("row_id").alias("last_seen"))
    return writes.merge_seen(seen(0), seen(1), ["cmd"])


@q("SELECT uuid, line_type, row_id FROM turns")
def turn_upsert(spark, sf):
    """Turns replaced by their newly read state, unknown ones added."""
    t = model.turns(spark, sf).select("uuid", "line_type", "row_id")
    old = t.where("row_id % 3 <> 0").withColumn("line_type", F.lit("stale"))
    return writes.replace_rows(old, t, "uuid")


@q("SELECT uuid || '#r' || place AS reflection_id, b.thinking AS text, strlen(b.thinking) >= 50 AS embed FROM (SELECT uuid, unnest(message.blocks) AS b, generate_subscripts(message.blocks, 1) - 1 AS place FROM turns) WHERE b.block_type = 'thinking' AND b.thinking <> ''")
def reflection_upsert(spark, sf):
    r = sessions.blocks(model.turns(spark, sf), "thinking").where("b.thinking <> ''").select(F.concat("uuid", F.lit("#r"), "at").alias("reflection_id"), F.col("b.thinking").alias("text"))
    return writes.replace_rows(r.where(F.length("text") % 2 == 0), r, "reflection_id").withColumn("embed", F.octet_length("text") >= 50)


@q("SELECT c.tool_call_id, c.name, r.is_error, CASE WHEN r.is_error THEN r.error_text END AS error_text FROM calls c LEFT JOIN (SELECT b.tool_use_id AS tool_call_id, bool_or(coalesce(b.is_error, false)) AS is_error, min(nullif(CASE WHEN coalesce(b.is_error, false) THEN b.content END, '')) AS error_text FROM bl WHERE b.block_type = 'tool_result' AND b.tool_use_id <> '' GROUP BY 1) r ON r.tool_call_id = c.tool_call_id", more=_BLOCKS)
def tool_backfill(spark, sf):
    """Calls with the outcome of their results: errors and what they said."""
    return sessions.tool_calls(model.turns(spark, sf)).select("tool_call_id", "name", "is_error", "error_text")


@q("SELECT session_id, count(*) AS n_turns, sum(coalesce(message.usage.input_tokens, 0))::BIGINT AS input_tokens, max(ingested_at) AS deep_indexed_at FROM turns GROUP BY 1")
def session_aggregates(spark, sf):
    """Totals written back onto the sessions they belong to."""
    t = model.turns(spark, sf)
    lines = model.table(spark, sf, "session_lines").where("uuid <> ''").select("uuid", "row_id", "ingested_at")
    s = t.select("session_id", "row_id").join(lines.select("row_id", "ingested_at"), "row_id").groupBy("session_id").agg(F.max("ingested_at").alias("deep_indexed_at"), F.lit(None).cast("bigint").alias("n_turns"), F.lit(None).cast("bigint").alias("input_tokens"))
    totals = sessions.session_totals(t).select("session_id", "n_turns", "input_tokens")
    return writes.set_columns(s, totals, "session_id", ["n_turns", "input_tokens"])


@q("SELECT DISTINCT s.session_id AS src, 'MENTIONED_IN' AS rel_type, c.concept_id AS dst FROM (SELECT session_id, array_to_string(string_split(lower(summary), ' ')[-2:], '-') AS word FROM session_lines WHERE summary <> '') s JOIN concepts c ON regexp_replace(lower(c.name), '-[0-9]+$', '') = s.word")
def mention_edges(spark, sf):
    return mentioned(spark, sf)


@q("SELECT session_id AS path, max(CAST(epoch(ingested_at) AS BIGINT)) AS mtime FROM session_lines GROUP BY 1", plain=True)
def state_save(spark, sf):
    files = model.table(spark, sf, "session_lines").groupBy(F.col("session_id").alias("path")).agg(F.max(F.unix_seconds("ingested_at")).alias("mtime"), F.min(F.unix_seconds("ingested_at")).alias("old"))
    return writes.save_state(files.where("old % 2 = 0").select("path", F.col("old").alias("mtime")), files)


@q("SELECT src, rel_type, dst FROM edges WHERE src NOT IN (SELECT concept_id FROM concepts WHERE invalid_at IS NOT NULL) AND dst NOT IN (SELECT concept_id FROM concepts WHERE invalid_at IS NOT NULL)")
def detach_ended(spark, sf):
    """Edges that are left when ended concepts go."""
    c, e = model.concepts(spark, sf), model.edges(spark, sf)
    gone = c.where("invalid_at is not null").select("concept_id")
    return writes.detach(c, writes.detach(c, e, gone, "concept_id", "src")[1], gone, "concept_id", "dst")[1].select("src", "rel_type", "dst")


QUERIES, ORACLES = q.queries, q.oracles
