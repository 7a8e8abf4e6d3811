"""Queries of files read and written, of the loop's tables, and of triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import search, sessions
from ..scratch import base_dir
from ..sources import exports, readers
from ..streaming import deadends
from . import search_queries
from ._register import Registry

q = Registry(model.SQL)


def _folder(spark, name: str) -> str:
    """A folder of this run's own for files that are written and read again."""
    import uuid

    from ..scratch import _written

    path = f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


# -- files ----------------------------------------------------------------------------------
@q("SELECT row_id, line_type, uuid, parent_uuid, ts, message.role AS role, CASE WHEN message.content IS NOT NULL THEN message.content END AS content, coalesce(message.usage.output_tokens, 0) AS output_tokens, len(message.blocks) AS n_blocks, array_to_string([b.block_type FOR b IN message.blocks], ',') AS kinds FROM session_lines WHERE message IS NOT NULL", plain=True)
def transcript_files(spark, sf):
    """Transcripts written as JSON lines and read again, blocks included; broken lines are dropped."""
    t = model.table(spark, sf, "session_lines").where("message is not null")
    block = F.transform("message.blocks", lambda b: F.struct(b["block_type"].alias("type"), *[b[c].alias(c) for c in ("text", "thinking", "id", "name", "input", "tool_use_id", "is_error", "content")]))
    usage = F.to_json(F.struct("message.usage.output_tokens"))
    body = F.when(F.col("message.content").isNotNull(), F.to_json(F.struct(F.col("message.content").alias("c")))).otherwise(F.to_json(F.struct(block.alias("c"))))
    inner = F.regexp_extract(body, r'(?s)^\{"c":(.*)\}$', 1)
    outer = F.to_json(F.struct(F.col("row_id").alias("row"), F.col("line_type").alias("type"), "uuid", F.col("parent_uuid").alias("parentUuid"), F.col("ts").alias("timestamp")))
    role = F.coalesce(F.concat(F.lit('"role":'), F.regexp_extract(F.to_json(F.array("message.role")), r"(?s)^\[(.*)\]$", 1)), F.lit('"role":null'))
    message = F.concat(F.lit(',"message":{'), role, F.lit(',"usage":'), usage, F.when(inner != "", F.concat(F.lit(',"content":'), inner)).otherwise(""), F.lit("}}"))
    path = _folder(spark, "transcripts")
    t.select(F.concat(F.regexp_replace(outer, r"\}$", ""), message).alias("value")).union(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    raw = readers.transcripts(spark, path).select("value", F.get_json_object("value", "$.row").cast("bigint").alias("row_id"))
    m = F.col("message")
    kinds = F.array_join(F.transform(m["blocks"], lambda b: b["block_type"]), ",")
    n = F.when(m["blocks"].isNotNull(), F.size(m["blocks"]).cast("bigint"))
    return sessions.transcript_lines(raw).select("row_id", "line_type", "uuid", "parent_uuid", "ts", m["role"].alias("role"), m["content"].alias("content"), F.coalesce(m["usage"]["output_tokens"], F.lit(0)).alias("output_tokens"), n.alias("n_blocks"), kinds.alias("kinds"))


@q("SELECT session_id, summary, count(*) AS n FROM session_lines WHERE session_id IS NOT NULL AND summary <> '' GROUP BY 1, 2", plain=True)
def index_files(spark, sf):
    """An index of sessions written as one document per file and read again."""
    s = model.table(spark, sf, "session_lines").where("session_id is not null and summary <> ''").groupBy("session_id", "summary").agg(F.count("*").alias("messageCount"))
    path = _folder(spark, "index")
    some = s.select(F.col("session_id").alias("sessionId"), "summary", "messageCount", F.pmod(F.xxhash64("session_id"), F.lit(20)).alias("file"))
    docs = some.groupBy("file", F.pmod(F.xxhash64("sessionId", "summary"), F.lit(50))).agg(F.collect_list(F.struct("sessionId", "summary", "messageCount")).alias("entries")).select("entries")
    docs.repartition(8).write.option("maxRecordsPerFile", 1).json(path)
    return readers.session_index(spark, path).select(F.col("sessionId").alias("session_id"), "summary", F.col("messageCount").alias("n"))


@q("SELECT props->>'$.k' AS query, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1", plain=True)
def queue_files(spark, sf):
    """Misses logged to an inbox and read from it; lines that aren't JSON are dropped."""
    path = _folder(spark, "inbox")
    e = model.table(spark, sf, "events").where("event_type = 'error'")
    rows = e.select(F.col("ts").cast("string").alias("timestamp"), F.col("user_id").alias("session"), F.lit("global").alias("namespace"), F.lit("walk").alias("command"), F.get_json_object("props", "$.k").alias("query"), F.lit(None).cast("string").alias("context"))
    deadends.log_misses(rows, path)
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(path)
    return readers.queue(spark, path).where("query is not null").groupBy("query").agg(F.count("*").alias("n"))


@q("SELECT lower(label) AS pattern FROM topic_reference", plain=True)
def trigger_files(spark, sf):
    path = _folder(spark, "triggers")
    t = model.table(spark, sf, "topic_reference").select(F.lower("label").alias("value")).union(spark.createDataFrame([("# a comment",), ("",), ("  ",)], "value string"))
    t.write.text(path)
    return readers.triggers(spark, path).select("pattern")


@q("SELECT quote_id, coalesce(text, '') || chr(10) || chr(10) || coalesce(speaker, '') AS text FROM quotes", plain=True)
def meeting_texts(spark, sf):
    """Transcripts of meetings as lists of blocks, flattened."""
    raw = F.to_json(F.array(*[F.struct(F.coalesce(c, F.lit("")).alias("text")) for c in ("text", "speaker")]))
    return model.table(spark, sf, "quotes").select("quote_id", readers.meeting_text(raw).alias("text"))


@q("SELECT label, count(*) AS n, bool_or(contains(json, 'embedding')) AS embedded FROM (SELECT 'Concept' AS label, name AS json FROM concepts UNION ALL SELECT 'Patch', name FROM patches UNION ALL SELECT 'Meeting', '' FROM meetings UNION ALL SELECT 'Turn', '' FROM turns UNION ALL SELECT 'Vector', '' FROM vectors) GROUP BY 1")
def export_all(spark, sf):
    """Documents of five kinds of nodes, vectors stripped."""
    kinds = {"Concept": (model.concepts(spark, sf), ["concept_id", "name", "namespace"]), "Patch": (model.patches(spark, sf), ["patch_id", "name", "content"]), "Meeting": (model.table(spark, sf, "meetings"), ["meeting_id", "title"]), "Turn": (model.turns(spark, sf), ["uuid", "line_type"]), "Vector": (model.vectors(spark, sf), ["vec_id", "embedding"])}
    out = exports.all_nodes(kinds, strip=["embedding"])
    return out.groupBy("label").agg(F.count("*").alias("n"), F.bool_or(F.contains("json", F.lit("embedding"))).alias("embedded"))


# -- the loop's tables ------------------------------------------------------------------------
_PENDING = "pend AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad name!' ELSE lower(replace(props->>'$.k', ' ', '-')) END AS concept, CASE WHEN event_id % 2 = 0 THEN 'atlas' END AS namespace, 'r' || event_type AS reason FROM events WHERE event_type = 'error')"


def _pending(spark, sf):
    e = model.table(spark, sf, "events").where("event_type = 'error'")
    return e.select("event_id", F.when(F.col("event_id") % 7 == 0, "bad name!").otherwise(F.lower(F.replace(F.get_json_object("props", "$.k"), F.lit(" "), F.lit("-")))).alias("concept"), F.when(F.col("event_id") % 2 == 0, "atlas").alias("namespace"), F.concat(F.lit("r"), "event_type").alias("reason"))


@q("SELECT name, namespace, description FROM concepts UNION ALL SELECT concept, coalesce(namespace, 'global'), min(reason) FROM pend p WHERE concept <> 'bad name!' AND NOT EXISTS (SELECT 1 FROM concepts c WHERE c.name = p.concept AND c.namespace = coalesce(p.namespace, 'global')) GROUP BY 1, 2", more=_PENDING)
def apply_pending(spark, sf):
    return deadends.apply_pending(_pending(spark, sf), model.concepts(spark, sf))[0].select("name", "namespace", "description")


@q("SELECT event_id, concept FROM pend WHERE concept = 'bad name!' OR concept IS NULL", more=_PENDING)
def retained_pending(spark, sf):
    return deadends.apply_pending(_pending(spark, sf), model.concepts(spark, sf))[1].select("event_id", "concept")


@q("SELECT choice, count(*) AS n FROM (SELECT CASE length(props->>'$.k') % 3 WHEN 0 THEN 'commit' WHEN 1 THEN 'skip' ELSE 'wait' END AS choice FROM events WHERE event_type = 'error' AND props->>'$.k' IS NOT NULL) GROUP BY 1", plain=True)
def reviews(spark, sf):
    """A review queue parted by what people decided."""
    e = model.table(spark, sf, "events").where("event_type = 'error'").select(F.get_json_object("props", "$.k").alias("query"), "event_id").where("query is not null")
    n = F.length("query") % 3
    told = e.select("query").distinct().select("query", F.when(n == 0, "COMMIT").when(n == 1, "skip").otherwise("later").alias("choice"))
    parts = deadends.reviewed(e, told)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("choice"), "n").where("n > 0")
    return count(parts[0], "commit").unionByName(count(parts[1], "skip")).unionByName(count(parts[2], "wait"))


@q("SELECT event_type AS queue, count(*) AS n, count(*) > count(*) FILTER (user_id % 2 = 0) * 2 AS notify FROM events GROUP BY 1", plain=True)
def notify_state(spark, sf):
    e = model.table(spark, sf, "events").withColumnRenamed("event_type", "queue")
    now = e.groupBy("queue").agg(F.count("*").alias("n"))
    before = e.groupBy("queue").agg((F.count_if(F.col("user_id") % 2 == 0) * 2).alias("n"))
    return deadends.told_state(before, now)


@q("SELECT query, CASE WHEN query IS NULL OR length(trim(query)) < 4 THEN 'DISCARD' WHEN query LIKE '%a%' THEN 'QUEUE' ELSE 'COMMIT' END AS decision FROM (SELECT DISTINCT props->>'$.k' AS query FROM events WHERE props->>'$.k' IS NOT NULL)", plain=True)
def decisions(spark, sf):
    """A classifier that fails on some rows: these wait for review, the others don't."""

    def fails(queries):
        if queries.str.contains("a").any():
            raise RuntimeError("no answer")
        return deadends.by_rule(queries)

    e = model.table(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("query")).where("query is not null").distinct()
    out = deadends.decided(e, fails)
    return out.select("query", F.when(F.length(F.trim("query")) < 4, "DISCARD").otherwise(F.col("decision")).alias("decision"))


# -- triggers ------------------------------------------------------------------------------------
@q("SELECT t.topic_id, min_by(r.pattern, r.canon_id) AS pattern FROM topics t LEFT JOIN (SELECT canon_id, replace(normalized_name, '-', '[- _]') AS pattern FROM topic_reference) r ON regexp_matches(lower(t.name), r.pattern) GROUP BY 1", plain=True)
def trigger_match(spark, sf):
    """The first pattern that matches, in the order of the list."""
    t = model.table(spark, sf, "topics").select(F.col("topic_id").alias("prompt_id"), F.col("name").alias("text"))
    p = model.table(spark, sf, "topic_reference").select(F.col("canon_id").alias("at"), F.replace("normalized_name", F.lit("-"), F.lit("[- _]")).alias("pattern"))
    none = spark.createDataFrame([], "prompt_id bigint, concept string")
    return search.triggered(t, p, none).select(F.col("prompt_id").alias("topic_id"), "pattern")


@q("SELECT t.topic_id, CASE WHEN p.pattern IS NULL THEN v.name END AS concept, p.pattern FROM topics t LEFT JOIN (SELECT t.topic_id, min(r.pattern) AS pattern FROM topics t JOIN (SELECT 'budget' AS pattern UNION ALL SELECT 'review(' ) r ON contains(lower(t.name), r.pattern) GROUP BY 1) p ON p.topic_id = t.topic_id LEFT JOIN vectors v ON v.vec_id = t.topic_id")
def trigger_fallback(spark, sf):
    """Patterns first, one of them no regular expression, then what is nearest."""
    t = model.table(spark, sf, "topics").select(F.col("topic_id").alias("prompt_id"), F.col("name").alias("text"))
    p = spark.createDataFrame([(1, "budget"), (2, "review(")], "at int, pattern string")
    near = model.vectors(spark, sf).select(F.col("vec_id").alias("prompt_id"), F.col("name").alias("concept"))
    return search.triggered(t, p, near).select(F.col("prompt_id").alias("topic_id"), "concept", "pattern")


# -- the rest of what is measured ----------------------------------------------------------------------
@q("SELECT count(*) AS asked, count(recall) AS scored, round(avg(recall)::DOUBLE, 6) AS recall FROM (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN NULL WHEN query_id % 3 = 1 THEN 0.0 ELSE recall END AS recall FROM m)", more=search_queries._METRICS)
def scored_only(spark, sf):
    """Skipped queries don't count, failed ones count as 0."""
    m = search_queries._label_metrics(spark, sf)
    r = F.when(F.col("query_id") % 3 == 0, F.lit(None)).when(F.col("query_id") % 3 == 1, 0.0).otherwise(F.col("recall"))
    return m.select(r.alias("recall")).agg(F.count("*").alias("asked"), F.count("recall").alias("scored"), F.round(F.avg("recall"), 6).alias("recall"))


@q("SELECT row_id, line_type, uuid FROM session_lines ORDER BY row_id DESC LIMIT 20", plain=True)
def last_rows(spark, sf):
    """The latest twenty, the newest first."""
    return model.table(spark, sf, "session_lines").orderBy(F.desc("row_id")).limit(20).select("row_id", "line_type", "uuid")


QUERIES, ORACLES = q.queries, q.oracles
