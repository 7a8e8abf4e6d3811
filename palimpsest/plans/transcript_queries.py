"""Queries on transcripts, queues and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import scalars
from ..operators import sessions
from ..streaming import deadends
from ._register import Registry

q = Registry(model.SQL)
_ROLE = "coalesce(nullif(lower(trim(message.role)), ''), line_type)"
_TEXT = "coalesce(nullif(message.content, ''), nullif(array_to_string([b.text FOR b IN message.blocks IF b.block_type = 'text' AND b.text <> ''], chr(10)), ''))"
_BLOCKS = "bl AS (SELECT uuid, session_id, unnest(message.blocks) AS b, generate_subscripts(message.blocks, 1) - 1 AS place FROM turns)"
_CALLS = _BLOCKS + ", calls AS (SELECT * FROM (SELECT b.id AS tool_call_id, uuid, session_id, b.name AS name, b.input AS input, row_number() OVER (PARTITION BY b.id ORDER BY uuid, session_id) AS rn FROM bl WHERE b.block_type = 'tool_use' AND b.id <> '') WHERE rn = 1), results AS (SELECT b.tool_use_id AS tool_call_id, bool_or(coalesce(b.is_error, false)) AS is_error FROM bl WHERE b.block_type = 'tool_result' AND b.tool_use_id <> '' GROUP BY 1)"


@q(f"SELECT uuid, {_ROLE} AS role, {_TEXT} AS text, strlen({_TEXT}) >= 50 AS embed FROM turns")
def turn_texts(spark, sf):
    t = model.turns(spark, sf).withColumn("text", sessions.turn_text())
    return t.select("uuid", sessions.role().alias("role"), "text", (F.octet_length("text") >= 50).alias("embed"))


@q("SELECT c.tool_call_id, c.uuid, c.name, r.is_error FROM calls c LEFT JOIN results r ON r.tool_call_id = c.tool_call_id", more=_CALLS)
def tool_calls(spark, sf):
    return sessions.tool_calls(model.turns(spark, sf)).select("tool_call_id", "uuid", "name", "is_error")


@q("SELECT uuid || '#r' || place AS reflection_id, b.thinking AS text FROM bl WHERE b.block_type = 'thinking' AND b.thinking <> ''", more=_BLOCKS)
def reflections(spark, sf):
    r = sessions.blocks(model.turns(spark, sf), "thinking").where("b.thinking <> ''")
    return r.select(F.concat("uuid", F.lit("#r"), "at").alias("reflection_id"), F.col("b.thinking").alias("text"))


@q("SELECT uuid, array_to_string(list_distinct_ordered, ',') AS tools FROM (SELECT uuid, list(name ORDER BY place) AS list_distinct_ordered FROM (SELECT uuid, b.name AS name, min(place) AS place FROM bl WHERE b.block_type = 'tool_use' GROUP BY 1, 2) GROUP BY 1)", more=_BLOCKS)
def tool_names(spark, sf):
    names = F.array_distinct(F.transform(F.filter("message.blocks", lambda b: b["block_type"] == "tool_use"), lambda b: b["name"]))
    t = model.turns(spark, sf).withColumn("names", names).where("size(names) > 0")
    return t.select("uuid", F.array_join("names", ",").alias("tools"))


_PATHS = "paths AS (SELECT DISTINCT tool_call_id, session_id, unnest([input->>'$.file_path', input->>'$.path', input->>'$.notebook_path']) AS path, CASE name WHEN 'Read' THEN 'read' WHEN 'Edit' THEN 'edit' WHEN 'MultiEdit' THEN 'edit' WHEN 'NotebookEdit' THEN 'edit' WHEN 'Write' THEN 'write' WHEN 'Grep' THEN 'grep' WHEN 'Glob' THEN 'glob' END AS action FROM calls)"


@q("SELECT path, action, count(*) AS n FROM paths WHERE path <> '' AND action IS NOT NULL GROUP BY 1, 2", more=_CALLS + ", " + _PATHS)
def file_touches(spark, sf):
    t = sessions.file_touches(sessions.tool_calls(model.turns(spark, sf)))
    return t.groupBy("path", "action").agg(F.count("*").alias("n"))


@q("SELECT path, n FROM (SELECT path, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, path) AS rn FROM paths WHERE path <> '' AND action IS NOT NULL GROUP BY 1) WHERE rn <= 100", more=_CALLS + ", " + _PATHS)
def files_topn(spark, sf):
    t = sessions.file_touches(sessions.tool_calls(model.turns(spark, sf)))
    return t.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(100)


@q("SELECT cmd, n FROM (SELECT trim(input->>'$.command') AS cmd, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, trim(input->>'$.command')) AS rn FROM calls WHERE name = 'Bash' AND trim(input->>'$.command') <> '' GROUP BY 1) WHERE rn <= 50", more=_CALLS)
def commands_topn(spark, sf):
    c = sessions.commands(sessions.tool_calls(model.turns(spark, sf)))
    return c.groupBy("cmd").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cmd").limit(50)


_TOTALS = "tot AS (SELECT session_id, count(*) AS n_turns, sum(coalesce(message.usage.input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(message.usage.output_tokens, 0))::BIGINT AS output_tokens, sum(coalesce(message.usage.cache_creation_input_tokens, 0))::BIGINT AS cache_creation_input_tokens, sum(coalesce(message.usage.cache_read_input_tokens, 0))::BIGINT AS cache_read_input_tokens, sum(coalesce(len([1 FOR b IN message.blocks IF b.block_type = 'tool_use']), 0))::BIGINT AS n_tool_calls, bool_or(coalesce(is_sidechain, false)) AS has_sidechain FROM turns GROUP BY 1)"


@q("SELECT * FROM tot", more=_TOTALS)
def session_totals(spark, sf):
    return sessions.session_totals(model.turns(spark, sf))


@q("SELECT session_id, input_tokens + output_tokens AS tokens FROM (SELECT *, row_number() OVER (ORDER BY input_tokens + output_tokens DESC, session_id) AS rn FROM tot) WHERE rn <= 20", more=_TOTALS)
def session_cost_topn(spark, sf):
    t = sessions.session_totals(model.turns(spark, sf)).select("session_id", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return t.orderBy(F.desc("tokens"), "session_id").limit(20)


@q("SELECT count(*) AS n, sum(tokens)::BIGINT AS tokens FROM (SELECT input_tokens + output_tokens AS tokens FROM tot ORDER BY tokens DESC, session_id LIMIT 20)", more=_TOTALS)
def shown_totals(spark, sf):
    return session_cost_topn(spark, sf).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@q("SELECT uuid, round(((coalesce(message.usage.input_tokens, 0) + coalesce(message.usage.cache_read_input_tokens, 0) * 0.1::DOUBLE + coalesce(message.usage.cache_creation_input_tokens, 0) * 1.25::DOUBLE) * 3 + coalesce(message.usage.output_tokens, 0) * 15) / 1000000, 9) AS usd FROM turns WHERE message.model IS NOT NULL")
def cost_estimate(spark, sf):
    t = model.turns(spark, sf).where("message.model is not null")
    u = lambda c: F.col(f"message.usage.{c}")
    usd = scalars.cost_usd(F.lit("a-sonnet-model"), u("input_tokens"), u("output_tokens"), u("cache_read_input_tokens"), u("cache_creation_input_tokens"))
    return t.select("uuid", F.round(usd, 9).alias("usd"))


@q("SELECT session_id, arg_min(cwd, (line_no, row_id)) FILTER (cwd <> '') AS cwd, arg_min(git_branch, (line_no, row_id)) FILTER (git_branch <> '') AS git_branch, arg_max(summary, (line_no, row_id)) FILTER (summary <> '') AS summary, arg_max(title, (line_no, row_id)) FILTER (title <> '') AS title, arg_max(ts, (line_no, row_id)) FILTER (ts <> '') AS last_ts FROM session_lines GROUP BY 1", plain=True)
def session_meta(spark, sf):
    return sessions.session_meta(model.table(spark, sf, "session_lines"))


@q(f"SELECT session_id, arg_min(text, (line_no, row_id))[1:4096] AS prompt FROM (SELECT session_id, line_no, row_id, {_TEXT} AS text, {_ROLE} AS role FROM session_lines) WHERE role = 'user' AND text IS NOT NULL GROUP BY 1", plain=True)
def first_prompt(spark, sf):
    return sessions.first_prompt(model.table(spark, sf, "session_lines"))


@q("SELECT t.uuid, p.uuid AS parent, p.line_type AS parent_type FROM turns t JOIN turns p ON p.uuid = t.parent_uuid")
def reply_chain(spark, sf):
    t = model.turns(spark, sf)
    p = t.select(F.col("uuid").alias("parent_uuid"), F.col("line_type").alias("parent_type"))
    return t.select("uuid", "parent_uuid").join(p, "parent_uuid").select("uuid", F.col("parent_uuid").alias("parent"), "parent_type")


@q("SELECT session_id, last_ts FROM (SELECT session_id, max(ts) FILTER (regexp_matches(ts, '^\\d{4}-')) AS last_ts FROM session_lines GROUP BY 1) ORDER BY last_ts DESC NULLS LAST, session_id LIMIT 50", plain=True)
def sessions_recent(spark, sf):
    s = model.table(spark, sf, "session_lines").groupBy("session_id").agg(F.max(F.when(F.col("ts").rlike(r"^\d{4}-"), F.col("ts"))).alias("last_ts"))
    return s.orderBy(F.desc_nulls_last("last_ts"), "session_id").limit(50)


@q("SELECT session_id, count(*) FILTER (coalesce(is_sidechain, false)) AS sidechain, count(*) FILTER (NOT coalesce(is_sidechain, false)) AS main FROM turns GROUP BY 1")
def sidechain_counts(spark, sf):
    side = F.coalesce("is_sidechain", F.lit(False))
    return model.turns(spark, sf).groupBy("session_id").agg(F.count_if(side).alias("sidechain"), F.count_if(~side).alias("main"))


@q("SELECT session_id, first_seen, CAST(epoch(first_seen) AS BIGINT) % 2 = 0 AS skipped FROM (SELECT session_id, min(ingested_at) AS first_seen FROM session_lines GROUP BY 1) WHERE CAST(epoch(first_seen) AS BIGINT) % 2 <> 0", plain=True)
def incremental_skip(spark, sf):
    files = model.table(spark, sf, "session_lines").groupBy(F.col("session_id").alias("path")).agg(F.min("ingested_at").alias("first_seen")).withColumn("mtime", F.unix_seconds("first_seen"))
    state = files.where("mtime % 2 = 0").select("path", "mtime")
    return sessions.changed_files(files, state).select(F.col("path").alias("session_id"), "first_seen", F.lit(False).alias("skipped"))


# -- failed lookups ------------------------------------------------------------------------------
_INBOX = "inbox AS (SELECT props->>'$.k' AS query, ts, event_id, user_id FROM events WHERE event_type = 'error'), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ts, event_id) AS rn FROM inbox) WHERE rn = 1)"


def _firsts(spark, sf):
    e = model.table(spark, sf, "events").where("event_type = 'error'")
    rows = e.select(F.get_json_object("props", "$.k").alias("query"), "ts", "event_id", "user_id")
    first = rows.groupBy("query").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("v"))
    return first.select("query", "v.event_id", "v.user_id")


@q(f"WITH {_INBOX} SELECT query, event_id, user_id FROM firsts", plain=True)
def inbox_first(spark, sf):
    return _firsts(spark, sf)


@q(f"WITH {_INBOX} SELECT CASE WHEN length(query) < 4 THEN 'DISCARD' ELSE 'COMMIT' END AS decision, count(*) AS n FROM firsts GROUP BY 1", plain=True)
def route_counts(spark, sf):
    return deadends.route_counts(deadends.decided(_firsts(spark, sf)))


@q("SELECT event_type AS queue, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > coalesce(sum((user_id % 2)::BIGINT) * 2, 0)", plain=True)
def queues_grown(spark, sf):
    e = model.table(spark, sf, "events")
    now = e.groupBy(F.col("event_type").alias("queue")).agg(F.count("*").alias("n"))
    told = e.groupBy(F.col("event_type").alias("queue")).agg((F.sum(F.col("user_id") % 2) * 2).alias("n"))
    return deadends.grown(told, now)


@q("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2", plain=True)
def misses_per_hour(spark, sf):
    e = model.table(spark, sf, "events").where("event_type = 'error'")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


_SALIENT = f"""tx AS (SELECT t.session_id, t.uuid, t.line_no, {_TEXT} AS text, {_ROLE} AS role, coalesce(len([1 FOR b IN message.blocks IF b.block_type = 'tool_use']), 0) AS tools, v.embedding FROM turns t LEFT JOIN vectors v ON v.vec_id = t.row_id WHERE {_TEXT} IS NOT NULL),
dims AS (SELECT session_id, generate_subscripts(embedding, 1) AS place, unnest(embedding::DOUBLE[]) AS x FROM tx WHERE embedding IS NOT NULL),
center AS (SELECT session_id, list(m ORDER BY place) AS c FROM (SELECT session_id, place, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1),
sc AS (SELECT tx.session_id, uuid, line_no, strlen(text) AS size, round(CASE WHEN embedding IS NULL THEN 0.3 ELSE list_cosine_similarity(embedding::DOUBLE[], c) END + CASE WHEN tools > 0 THEN 0.15 ELSE 0 END
  + CASE WHEN role = 'user' AND row_number() OVER (PARTITION BY tx.session_id ORDER BY line_no, uuid) = 1 THEN 0.25 ELSE 0 END, 6) AS score FROM tx LEFT JOIN center ON center.session_id = tx.session_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, line_no, uuid) AS r FROM sc),
pack AS (SELECT session_id, r, uuid, size <= 600 AS kept, 600 - CASE WHEN size <= 600 THEN size ELSE 0 END AS room FROM rk WHERE r = 1
  UNION ALL SELECT k.session_id, k.r, k.uuid, k.size <= p.room, p.room - CASE WHEN k.size <= p.room THEN k.size ELSE 0 END FROM pack p JOIN rk k ON k.session_id = p.session_id AND k.r = p.r + 1),
anyk AS (SELECT session_id, bool_or(kept) AS any_kept FROM pack GROUP BY 1)"""


@q("SELECT k.session_id, k.uuid, k.line_no, k.score, p.kept OR (k.r = 1 AND NOT s.any_kept) AS kept FROM rk k JOIN pack p ON p.session_id = k.session_id AND p.r = k.r JOIN anyk s ON s.session_id = k.session_id", more=_SALIENT)
def salient_turns(spark, sf):
    return _salient(spark, sf, 600)


def _said(spark, sf):
    return model.turns(spark, sf).withColumn("text", sessions.turn_text()).where("text is not null")


def _salient(spark, sf, budget):
    v = model.vectors(spark, sf).groupBy(F.col("vec_id").alias("row_id")).agg(F.first("embedding").alias("embedding"))
    tools = F.size(F.filter("message.blocks", lambda b: b["block_type"] == "tool_use"))
    return sessions.salient(_said(spark, sf).join(v, "row_id", "left").select("session_id", "uuid", "line_no", "text", "embedding", tools.alias("tools"), sessions.role().alias("role")), budget)


# -- reading and enriching sessions ----------------------------------------------------------------
_BYTES = "list_max([k FOR k IN range(0, length({c}) + 1) IF strlen({c}[1:k]) <= {n}])"


def _cut(c: str, n: int, mark: str = "") -> str:
    return f"CASE WHEN strlen({c}) <= {n} THEN {c} ELSE {c}[1:{_BYTES.format(c=c, n=n)}] || '{mark}' END"


@q(f"SELECT session_id, {_cut('p', 40, '...')} AS prompt, cwd, git_branch FROM (SELECT session_id, arg_min(text, (line_no, row_id)) FILTER (line_no <= 20 AND role = 'user' AND text IS NOT NULL) AS p, arg_min(cwd, (line_no, row_id)) FILTER (line_no <= 10 AND cwd <> '') AS cwd, arg_min(git_branch, (line_no, row_id)) FILTER (line_no <= 10 AND git_branch <> '') AS git_branch FROM (SELECT session_id, line_no, row_id, cwd, git_branch, {_TEXT} AS text, {_ROLE} AS role FROM session_lines WHERE line_no <= 20) GROUP BY 1)", plain=True)
def session_heads(spark, sf):
    """What the first lines of each session tell."""
    return sessions.head(model.table(spark, sf, "session_lines"), longest=40)


@q("SELECT b.tool_use_id AS tool_call_id, nullif(b.content, '') AS text FROM bl WHERE b.block_type = 'tool_result'", more=_BLOCKS)
def result_texts(spark, sf):
    r = sessions.blocks(model.turns(spark, sf), "tool_result")
    return r.select(F.col("b.tool_use_id").alias("tool_call_id"), sessions.result_text(F.col("b.content")).alias("text"))


_INDEX = "idx AS (SELECT session_id, min(summary) AS summary, count(*) AS lines FROM session_lines WHERE session_id IS NOT NULL GROUP BY 1)"


@q("SELECT session_id, CASE WHEN lines % 2 = 0 THEN 'index' ELSE 'file' END AS origin, CASE WHEN lines % 2 = 0 THEN 'listed' END AS summary FROM idx", more=_INDEX)
def index_precedence(spark, sf):
    """Sessions of an index first, files only for those that it doesn't name."""
    s = model.table(spark, sf, "session_lines").where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n"))
    listed = s.where("n % 2 = 0").select("session_id", F.lit("listed").alias("summary"))
    return sessions.indexed_first(listed, s.select("session_id")).select("session_id", "origin", "summary")


_TOP = ", tp AS (SELECT session_id, list(path ORDER BY n DESC, path)[1:5] AS files FROM (SELECT session_id, path, count(*) AS n FROM paths WHERE path <> '' AND action IS NOT NULL GROUP BY 1, 2) GROUP BY 1), tc AS (SELECT session_id, list(cmd ORDER BY n DESC, cmd)[1:3] AS commands FROM (SELECT session_id, trim(input->>'$.command') AS cmd, count(*) AS n FROM calls WHERE name = 'Bash' AND trim(input->>'$.command') <> '' GROUP BY 1, 2) GROUP BY 1), th AS (SELECT session_id, count(*) AS n FROM bl WHERE b.block_type = 'thinking' AND b.thinking <> '' GROUP BY 1), ei AS (SELECT t.session_id, t.n_turns, coalesce(files, []) AS files, coalesce(commands, []) AS commands, coalesce(th.n, 0) AS n_reflections FROM (SELECT session_id, count(*) AS n_turns FROM turns GROUP BY 1) t LEFT JOIN tp ON tp.session_id = t.session_id LEFT JOIN tc ON tc.session_id = t.session_id LEFT JOIN th ON th.session_id = t.session_id)"


@q("SELECT session_id, n_turns, array_to_string(files, '|') AS files, array_to_string(commands, '|') AS commands, n_reflections FROM ei", more=_CALLS + ", " + _PATHS + _TOP)
def enrichment_inputs(spark, sf):
    i = sessions.enrichment_inputs(model.turns(spark, sf), 5, 3)
    return i.select("session_id", "n_turns", F.array_join("files", "|").alias("files"), F.array_join("commands", "|").alias("commands"), "n_reflections")


@q("SELECT session_id, CASE WHEN len(files) = 0 THEN '' ELSE '[files touched]' || chr(10) || array_to_string(['- ' || x || chr(10) FOR x IN files], '') END || CASE WHEN len(commands) = 0 THEN '' ELSE '[commands run]' || chr(10) || array_to_string(['- ' || replace(x, chr(10), ' ') || chr(10) FOR x IN commands], '') END AS signal FROM ei", more=_CALLS + ", " + _PATHS + _TOP)
def signal_blocks(spark, sf):
    """Files and commands of each session; the cap is wide here, and tight in the tests."""
    i = sessions.enrichment_inputs(model.turns(spark, sf), 5, 3)
    return i.select("session_id", sessions.signal_block(F.col("files"), F.col("commands"), 1_000_000, 100_000).alias("signal"))


@q(f"SELECT session_id, {_cut('whole', 300)} AS text FROM (SELECT session_id, string_agg(chr(10) || '---' || chr(10) || '[' || role || ']' || chr(10) || text, '' ORDER BY line_no, uuid) AS whole FROM tx JOIN rk USING (session_id, uuid, line_no) JOIN pack USING (session_id, uuid) JOIN anyk USING (session_id) WHERE pack.kept OR (rk.r = 1 AND NOT any_kept) GROUP BY 1)", more=_SALIENT)
def enrichment_texts(spark, sf):
    """The kept turns of each session in order, cut to bytes."""
    t = _said(spark, sf).select("session_id", "uuid", "line_no", "text", sessions.role().alias("role"))
    return sessions.session_text(t.join(_salient(spark, sf, 600).select("session_id", "uuid", "kept"), ["session_id", "uuid"]), 300)


_WIN = f"o AS (SELECT session_id, line_no, uuid, strlen({_TEXT}) + 10 AS size, row_number() OVER (PARTITION BY session_id ORDER BY line_no, uuid) AS r FROM turns WHERE {_TEXT} IS NOT NULL), w AS (SELECT session_id, r, size AS used, 0 AS slot FROM o WHERE r = 1 UNION ALL SELECT o.session_id, o.r, CASE WHEN w.used + o.size > 400 THEN o.size ELSE w.used + o.size END, CASE WHEN w.used + o.size > 400 THEN w.slot + 1 ELSE w.slot END FROM w JOIN o ON o.session_id = w.session_id AND o.r = w.r + 1)"


@q('SELECT session_id, slot AS "window", count(*) AS turns, sum(size)::BIGINT AS bytes FROM w JOIN o USING (session_id, r) GROUP BY 1, 2', more=_WIN)
def turn_windows(spark, sf):
    """Consecutive turns in windows of bounded size, for work on one window at a time."""
    t = _said(spark, sf).where("session_id is not null").select("session_id", "line_no", "uuid", "text")
    w = sessions.windows(t, 400, 10).join(t, ["session_id", "line_no", "uuid"])
    return w.groupBy("session_id", "window").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text") + 10).alias("bytes"))


_NAMED = "nm AS (SELECT topic_id, replace(lower(trim(name, ' ')), ' ', '-') AS name, trim(coalesce(context, ''), ' ') AS description FROM topics), ok AS (SELECT topic_id, name, " + _cut("description", 30, "...") + " AS description FROM nm WHERE strlen(name) BETWEEN 3 AND 60 AND regexp_full_match(name, '[\\p{L}\\p{N}-]+') AND name NOT IN ('type', 'system', 'hook', 'subtype', 'empty', 'none', 'database', 'api', 'code', 'app', 'stuff', 'things', 'service', 'domain', 'generic', 'term', 'concept') AND description <> '')"


@q(f"WITH {_NAMED} SELECT topic_id, name, description FROM ok", plain=True)
def concept_names(spark, sf):
    t = model.table(spark, sf, "topics").select("topic_id", "name", F.coalesce("context", F.lit("")).alias("description"))
    return sessions.concept_names(t, 30)


@q(f"WITH {_NAMED} SELECT name, topic_id, description FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY topic_id) AS rn FROM ok) WHERE rn = 1", plain=True)
def concept_merge(spark, sf):
    """Names found in several windows once, as first found."""
    return sessions.merged_concepts(concept_names(spark, sf), "topic_id")


@q("SELECT session_id, hits FROM (SELECT session_id, hits, row_number() OVER (ORDER BY hits DESC, last DESC, session_id) AS rn FROM (SELECT session_id, sum(contains(lower(coalesce(summary, '') || ' ' || coalesce(title, '')), 'the')::INT)::BIGINT AS hits, max(ingested_at) AS last FROM session_lines GROUP BY 1) WHERE hits > 0) WHERE rn <= 10", plain=True)
def session_search(spark, sf):
    """Sessions by how often their headings have a word, the latest first."""
    s = model.table(spark, sf, "session_lines").withColumn("hit", F.contains(F.lower(F.concat_ws(" ", "summary", "title")), F.lit("the")).cast("int"))
    s = s.groupBy("session_id").agg(F.sum("hit").alias("hits"), F.max("ingested_at").alias("last")).where("hits > 0")
    return s.orderBy(F.desc("hits"), F.desc("last"), "session_id").limit(10).select("session_id", "hits")


@q("SELECT row_id, CASE WHEN regexp_full_match(trim(ts), '\\d{4}-\\d\\d-\\d\\d[Tt ]\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?([Zz]|[+-]\\d\\d:\\d\\d)') THEN epoch_us(TRY_CAST(trim(ts) AS TIMESTAMPTZ)) WHEN regexp_full_match(trim(ts), '\\d{4}-\\d\\d-\\d\\d') THEN epoch_us(TRY_CAST(trim(ts) || 'T00:00:00Z' AS TIMESTAMPTZ)) END AS at_us FROM session_lines", plain=True)
def moments(spark, sf):
    return model.table(spark, sf, "session_lines").select("row_id", F.unix_micros(scalars.moment_of(F.col("ts"))).alias("at_us"))


@q("SELECT row_id, nullif(regexp_extract(url, '/d/([a-zA-Z0-9_-]+)', 1), '') AS document_id, md5(url)[1:16] AS key FROM (SELECT row_id, 'https://docs.google.com/document/' || CASE WHEN row_id % 2 = 0 THEN 'd/' || uuid ELSE '' END || '/edit' AS url FROM session_lines WHERE uuid IS NOT NULL)", plain=True)
def document_ids(spark, sf):
    t = model.table(spark, sf, "session_lines").where("uuid is not null")
    url = F.concat(F.lit("https://docs.google.com/document/"), F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("d/"), "uuid")).otherwise(""), F.lit("/edit"))
    return t.select("row_id", scalars.document_id(url).alias("document_id"), scalars.url_key(url).alias("key"))


@q("SELECT row_id, ts[1:10] AS day, CASE WHEN length(summary) <= 12 THEN replace(summary, chr(10), ' ') ELSE replace(summary, chr(10), ' ')[1:12] || '...' END AS short FROM session_lines WHERE summary <> ''", plain=True)
def snippets(spark, sf):
    t = model.table(spark, sf, "session_lines").where("summary <> ''")
    return t.select("row_id", scalars.day(F.col("ts")).alias("day"), scalars.snippet(F.col("summary"), 12).alias("short"))


@q("SELECT row_id, message.model AS model, coalesce(message.usage.output_tokens, 0) AS tokens FROM session_lines WHERE message.model IS NOT NULL", plain=True)
def parsed_events(spark, sf):
    """Replies written as fenced JSON and parsed again."""
    t = model.table(spark, sf, "session_lines").where("message.model is not null")
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("message.model").alias("model"), F.col("message.usage.output_tokens").alias("tokens"))), F.lit("\n```"))
    back = F.from_json(scalars.unfenced(raw), "model string, tokens bigint")
    return t.select("row_id", back["model"].alias("model"), F.coalesce(back["tokens"], F.lit(0)).alias("tokens"))


@q("SELECT quote_id, [trim(replace(x, '\"\"', '\"')) FOR x IN [coalesce(speaker, ''), coalesce(text, ''), quote_id::VARCHAR]] AS cells FROM (SELECT quote_id, speaker, replace(replace(text, chr(10), ' '), '\"', '') AS text FROM quotes)", plain=True)
def csv_cells(spark, sf):
    """Rows written as CSV with quotes and read again."""
    t = model.table(spark, sf, "quotes").withColumn("text", F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("")))
    line = F.concat(F.lit('"'), F.coalesce("speaker", F.lit("")), F.lit('","'), F.coalesce("text", F.lit("")), F.lit('",'), F.col("quote_id").cast("string"))
    return t.select("quote_id", scalars.csv_cells(line).alias("cells"))


QUERIES, ORACLES = q.queries, q.oracles
