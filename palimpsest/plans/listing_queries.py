"""Queries of listings, patches, sources, triggers and small helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import scalars, temporal
from ..operators import graph, search, sessions, writes
from ..sources import readers
from ._register import Registry
from .graph_queries import AT, NOW

q = Registry(model.SQL)


def _at(text: str = AT):
    return F.lit(text).cast("timestamp")


# -- listings ---------------------------------------------------------------------------
@q("SELECT p.name AS patch, c.name AS corrected FROM patches p LEFT JOIN concepts c ON c.concept_id = p.concept_id AND p.corrects")
def list_patches(spark, sf):
    c = model.concepts(spark, sf).select("concept_id", F.col("name").alias("corrected"))
    p = model.patches(spark, sf)
    hit = p.where("corrects").select("patch_id", "concept_id").join(c, "concept_id").select("patch_id", "corrected")
    return p.select("patch_id", F.col("name").alias("patch")).join(hit, "patch_id", "left").select("patch", "corrected")


@q("SELECT canon_id, label, coalesce(len(aliases), 0) AS n_aliases FROM topic_reference", plain=True)
def list_triggers(spark, sf):
    t = model.table(spark, sf, "topic_reference")
    return t.select("canon_id", "label", F.coalesce(F.size("aliases"), F.lit(0)).cast("bigint").alias("n_aliases"))


@q("SELECT url, count(*) AS n FROM concepts WHERE url IS NOT NULL AND namespace IN ('global', 'atlas') GROUP BY 1")
def list_sources(spark, sf):
    return model.concepts(spark, sf).where(F.col("url").isNotNull() & temporal.in_namespaces(["global", "atlas"])).groupBy("url").agg(F.count("*").alias("n"))


@q("SELECT e.dst AS concept_id, count(DISTINCT c.url) AS n_sources FROM edges e JOIN concepts c ON c.concept_id = e.src WHERE c.url IS NOT NULL GROUP BY 1")
def sources_for_concept(spark, sf):
    c = model.concepts(spark, sf).where("url is not null").select(F.col("concept_id").alias("src"), "url")
    return model.edges(spark, sf).join(c, "src").groupBy(F.col("dst").alias("concept_id")).agg(F.countDistinct("url").alias("n_sources"))


@q("SELECT line_type, row_id, session_id FROM (SELECT line_type, row_id, session_id, row_number() OVER (ORDER BY row_id DESC) AS rn FROM session_lines WHERE line_type = 'summary') WHERE rn <= 20", plain=True)
def last_lines(spark, sf):
    return model.table(spark, sf, "session_lines").where("line_type = 'summary'").orderBy(F.desc("row_id")).limit(20).select("line_type", "row_id", "session_id")


@q("SELECT DISTINCT a.concept_id, b.name AS suggestion FROM concepts a JOIN (SELECT src, dst FROM edges WHERE rel_type IN ('USES', 'PART_OF') UNION SELECT dst, src FROM edges WHERE rel_type IN ('USES', 'PART_OF')) e ON e.src = a.concept_id JOIN concepts b ON b.concept_id = e.dst")
def neighbour_suggestions(spark, sf):
    e = graph.undirected(graph.one_hop(model.edges(spark, sf), ["USES", "PART_OF"]))
    c = model.concepts(spark, sf).select(F.col("concept_id").alias("dst"), F.col("name").alias("suggestion"))
    return e.join(c, "dst").select(F.col("src").alias("concept_id"), "suggestion").distinct()


@q("SELECT t.topic_id, bool_or(coalesce(contains(lower(t.normalized_name), r.normalized_name) OR contains(r.normalized_name, lower(nullif(t.normalized_name, ''))), false)) AS known FROM topics t, topic_reference r GROUP BY 1", plain=True)
def known_split(spark, sf):
    """Topics whose name contains that of an entry or is contained in one."""
    t = model.table(spark, sf, "topics").select("topic_id", F.lower("normalized_name").alias("name"))
    r = model.table(spark, sf, "topic_reference").select(F.col("canon_id").cast("bigint").alias("pattern_id"), F.col("normalized_name").alias("pattern"))
    over = search.contained(t.select(F.col("topic_id").alias("text_id"), F.col("name").alias("text")), r).select(F.col("text_id").alias("topic_id"))
    # the other way round: all stretches of the entries' names, whose number is that of the entries times a name's length squared
    n = F.length("pattern")
    parts = r.select(F.explode(F.sequence(F.lit(1), n)).alias("at"), "pattern", n.alias("n")).select("pattern", "at", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("at") + 1)).alias("long"))
    parts = parts.select(F.substring(F.col("pattern"), F.col("at"), F.col("long")).alias("name")).distinct()
    under = t.join(parts, "name", "left_semi").select("topic_id")
    known = over.unionByName(under).distinct().withColumn("known", F.lit(True))
    return t.select("topic_id").distinct().join(known, "topic_id", "left").select("topic_id", F.coalesce("known", F.lit(False)).alias("known"))


@q("SELECT c.concept_id, count(p.patch_id) FILTER (p.content IS NULL) AS empty_patches FROM concepts c LEFT JOIN patches p ON p.concept_id = c.concept_id GROUP BY 1")
def empty_patches(spark, sf):
    p = model.patches(spark, sf).where("content is null").groupBy("concept_id").agg(F.count("*").alias("n"))
    return model.concepts(spark, sf).select("concept_id").join(p, "concept_id", "left").select("concept_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("empty_patches"))


@q("SELECT concept_id FROM concepts WHERE concept_id NOT IN (SELECT concept_id FROM vectors WHERE concept_id IS NOT NULL)")
def missing_embedding(spark, sf):
    return model.concepts(spark, sf).join(model.vectors(spark, sf).select("concept_id"), "concept_id", "left_anti").select("concept_id")


@q("SELECT namespace, count(*) AS concepts, count(url) AS with_url, count(*) FILTER (invalid_at IS NOT NULL) AS ended, count(DISTINCT source) AS sources FROM concepts GROUP BY ROLLUP (namespace)")
def health(spark, sf):
    return model.concepts(spark, sf).rollup("namespace").agg(F.count("*").alias("concepts"), F.count("url").alias("with_url"), F.count("invalid_at").alias("ended"), F.countDistinct("source").alias("sources"))


@q("SELECT session_id, max(ingested_at) > TIMESTAMPTZ '2025-06-01' AS waiting FROM session_lines GROUP BY 1 HAVING max(ingested_at) > TIMESTAMPTZ '2025-06-01'", plain=True)
def unenriched(spark, sf):
    s = model.table(spark, sf, "session_lines").groupBy("session_id").agg(F.max("ingested_at").alias("indexed"))
    return s.where(F.col("indexed") > F.lit("2025-06-01").cast("timestamp")).select("session_id", F.lit(True).alias("waiting"))


@q("SELECT m.meeting_id, count(t.topic_id) AS topics, count(DISTINCT t.normalized_name) AS names FROM meetings m LEFT JOIN topics t ON t.meeting_id = m.meeting_id GROUP BY 1", plain=True)
def mentions(spark, sf):
    t = model.table(spark, sf, "topics").groupBy("meeting_id").agg(F.count("*").alias("topics"), F.countDistinct("normalized_name").alias("names"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return model.table(spark, sf, "meetings").select("meeting_id").join(t, "meeting_id", "left").select("meeting_id", zero("topics"), zero("names"))


# -- writes -----------------------------------------------------------------------------------
@q(f"SELECT concept_id, coalesce(CASE WHEN namespace <> 'atlas' THEN namespace END, 'global') AS namespace, CAST(epoch(coalesce(CASE WHEN concept_id % 3 <> 0 THEN valid_at END, updated_at)) AS BIGINT) AS valid_at FROM concepts")
def migrate(spark, sf):
    c = model.concepts(spark, sf).withColumn("namespace", F.when(F.col("namespace") != "atlas", F.col("namespace"))).withColumn("valid_at", F.when(F.col("concept_id") % 3 != 0, F.col("valid_at")))
    return writes.migrate(c, _at(NOW)).select("concept_id", "namespace", F.unix_seconds("valid_at").alias("valid_at"))


@q(f"SELECT concept_id, CAST(epoch(expired_at) AS BIGINT) AS expired_at FROM concepts")
def dedupe_undo(spark, sf):
    c = model.concepts(spark, sf)
    merges = c.where("expired_at is null and concept_id % 9 = 1").select(F.col("concept_id").alias("duplicate"), (F.col("concept_id") - 1).alias("canonical"))
    return writes.undo_merges(writes.apply_merges(c, merges, _at(), "run-1"), "run-1").select("concept_id", F.unix_seconds("expired_at").alias("expired_at"))


# -- readers and formats --------------------------------------------------------------------------
@q("SELECT url, concept_id FROM (SELECT url, concept_id, row_number() OVER (PARTITION BY url ORDER BY updated_at DESC, concept_id) AS rn FROM concepts WHERE url IS NOT NULL AND updated_at >= TIMESTAMPTZ '" + NOW + "' - INTERVAL 700 DAY) WHERE rn = 1")
def fresh_cache(spark, sf):
    c = model.concepts(spark, sf).where("url is not null").select("url", "concept_id", F.col("updated_at").alias("fetched_at"))
    return readers.fresh(c, _at(NOW), 700 * 86400, "concept_id").select("url", "concept_id")


@q("SELECT meeting_id, '| ' || rpad(title, greatest(5, max(length(title)) OVER ())::INTEGER, ' ') || ' | ' || rpad(coalesce(meeting_date, ''), greatest(12, max(length(meeting_date)) OVER ())::INTEGER, ' ') || ' |' AS line FROM meetings", plain=True)
def csv_markdown(spark, sf):
    m = model.table(spark, sf, "meetings")
    lines = readers.csv_markdown(["title", "meeting_date"], m, keep=["meeting_id"])
    return lines.select("meeting_id", "line")


@q("SELECT quote_id, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda w: length(w) > 3), ' ') AS kept FROM quotes", plain=True)
def word_filter(spark, sf):
    w = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: F.length(x) > 3)
    return model.table(spark, sf, "quotes").select("quote_id", F.array_join(w, " ").alias("kept"))


@q("SELECT meeting_id, regexp_extract(meeting_date || '-' || title, '^(\\d{4}-\\d{2}-\\d{2})', 1) AS day FROM meetings WHERE meeting_date IS NOT NULL", plain=True)
def file_dates(spark, sf):
    """The date at the start of a file name made of date and title."""
    m = model.table(spark, sf, "meetings").where("meeting_date is not null")
    return m.select("meeting_id", F.regexp_extract(F.concat("meeting_date", F.lit("-"), "title"), r"^(\d{4}-\d{2}-\d{2})", 1).alias("day"))


@q("SELECT quote_id, coalesce(contains(upper(last), 'CORRECT') AND NOT contains(upper(last), 'INCORRECT'), false) AS right, picks FROM (SELECT quote_id, string_split(rtrim(reply, chr(10) || ' '), chr(10))[-1] AS last, CASE WHEN quote_id % 4 = 3 THEN '1,2,3' ELSE '2,' || (1 + quote_id % 3 % 2 * 2)::VARCHAR END AS picks FROM (SELECT quote_id, 'The INCORRECT one was first.' || chr(10) || CASE quote_id % 3 WHEN 0 THEN 'Verdict: correct' WHEN 1 THEN 'Incorrect' ELSE 'unclear' END || chr(10) AS reply FROM quotes))", plain=True)
def replies(spark, sf):
    """What judges and rankers answered: a verdict in the last line, and places as numbers."""
    k = F.col("quote_id")
    said = F.concat(F.lit("The INCORRECT one was first.\n"), F.when(k % 3 == 0, "Verdict: correct").when(k % 3 == 1, "Incorrect").otherwise("unclear"), F.lit("\n"))
    listed = F.when(k % 4 == 3, "none of them").otherwise(F.concat(F.lit("[2], 2, 99 and "), (1 + k % 3 % 2 * 2).cast("string")))
    return model.table(spark, sf, "quotes").select("quote_id", search.verdict(said).alias("right"), F.array_join(search.picked(listed, 3).cast("array<string>"), ",").alias("picks"))


@q("SELECT event_id, CASE right(ts_text, 1) WHEN 's' THEN n WHEN 'm' THEN n * 60 ELSE n * 3600 END AS seconds FROM (SELECT event_id, event_id % 90 AS n, (event_id % 90)::VARCHAR || ['s', 'm', 'h'][1 + event_id % 3] AS ts_text FROM events)", plain=True)
def interval_seconds(spark, sf):
    e = model.table(spark, sf, "events").select("event_id", F.concat((F.col("event_id") % 90).cast("string"), F.element_at(F.array(F.lit("s"), F.lit("m"), F.lit("h")), (1 + F.col("event_id") % 3).cast("int"))).alias("t"))
    return e.select("event_id", scalars.interval_seconds(F.col("t")).alias("seconds"))


@q("SELECT to_json({'query_id': query_id, 'concept_id': concept_id, 'include_expired': include_expired})::VARCHAR AS json FROM temporal_queries", plain=True)
def report_json(spark, sf):
    return model.table(spark, sf, "temporal_queries").select(F.to_json(F.struct("query_id", "concept_id", "include_expired")).alias("json"))


@q("SELECT session_id, cmds FROM (SELECT session_id, array_to_string(list(name ORDER BY name), ',') AS cmds FROM (SELECT DISTINCT session_id, b.name AS name FROM (SELECT session_id, unnest(message.blocks) AS b FROM turns) WHERE b.block_type = 'tool_use' AND b.name <> '') GROUP BY 1)")
def session_tools(spark, sf):
    b = sessions.blocks(model.turns(spark, sf), "tool_use").where("b.name <> ''")
    return b.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("b.name")), ",").alias("cmds"))


@q("SELECT namespace, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM concepts GROUP BY 1")
def sources_per_namespace(spark, sf):
    g = model.concepts(spark, sf).groupBy("namespace").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return g.withColumn("sources", F.nullif("sources", F.lit("")))


QUERIES, ORACLES = q.queries, q.oracles
