"""Transcript tables: sessions, turns, tool calls, files, costs, salience."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, truncate_bytes

#: What each tool does to a file (fixed values).
ACTIONS = {"Read": "read", "Edit": "edit", "MultiEdit": "edit", "NotebookEdit": "edit", "Write": "write", "Grep": "grep", "Glob": "glob"}
COUNTS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")


def role(df: Column | str = "message.role") -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(F.col(df) if isinstance(df, str) else df)), F.lit("")), F.col("line_type"))


def turn_text() -> Column:
    """The words of a turn: its string content, or its text blocks joined by line ends."""
    texts = F.transform(F.filter("message.blocks", lambda b: (b["block_type"] == "text") & (b["text"] != "")), lambda b: b["text"])
    return F.coalesce(F.nullif(F.col("message.content"), F.lit("")), F.nullif(F.array_join(texts, "\n"), F.lit("")))


def blocks(turns: DataFrame, kind: str) -> DataFrame:
    """uuid, session_id, at (place among the blocks, from 0), b: the blocks of one type."""
    return turns.select("uuid", "session_id", F.posexplode("message.blocks").alias("at", "b")).where(F.col("b.block_type") == kind)


def result_text(content: Column) -> Column:
    """Words of a tool result: a string as it is, the texts of a JSON list of blocks joined by line ends; null where there are none."""
    texts = F.transform(F.filter(F.from_json(content, "array<struct<text string>>"), lambda b: b["text"].isNotNull()), lambda b: b["text"])
    return F.nullif(F.when(content.startswith("["), F.coalesce(F.array_join(texts, "\n"), content)).otherwise(content), F.lit(""))


def tool_calls(turns: DataFrame) -> DataFrame:
    """tool_call_id, uuid, session_id, name, input, is_error, error_text of every call; errors come from the results that name it, of several texts the smallest."""
    calls = blocks(turns, "tool_use").where("b.id <> ''").select(F.col("b.id").alias("tool_call_id"), "uuid", "session_id", F.col("b.name").alias("name"), F.col("b.input").alias("input"))
    calls = calls.groupBy("tool_call_id").agg(F.min(F.struct("uuid", "session_id", "name", "input")).alias("c")).select("tool_call_id", "c.*")
    bad = F.coalesce("b.is_error", F.lit(False))
    results = blocks(turns, "tool_result").where("b.tool_use_id <> ''").groupBy(F.col("b.tool_use_id").alias("tool_call_id")).agg(F.bool_or(bad).alias("is_error"), F.min(F.when(bad, result_text(F.col("b.content")))).alias("error_text"))
    return calls.join(results, "tool_call_id", "left")


def file_touches(calls: DataFrame) -> DataFrame:
    """tool_call_id, path, action: each distinct path in a file tool's input."""
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("name")]
    found = F.filter(F.array(*[F.get_json_object("input", f"$.{k}") for k in ("file_path", "path", "notebook_path")]), lambda p: p.isNotNull() & (p != ""))
    return calls.select("tool_call_id", F.explode(F.array_distinct(found)).alias("path"), action.alias("action")).where("action is not null")


def commands(calls: DataFrame) -> DataFrame:
    """tool_call_id, cmd of shell calls with a command."""
    return calls.where("name = 'Bash'").select("tool_call_id", F.trim(F.get_json_object("input", "$.command")).alias("cmd")).where("cmd <> ''")


def session_totals(turns: DataFrame) -> DataFrame:
    """Token, turn and tool-call totals per session; partial sums before the shuffle, so a hot session is no burden."""
    tools = F.size(F.filter(F.coalesce("message.blocks", F.array().cast(turns.select("message.blocks").schema[0].dataType)), lambda b: b["block_type"] == "tool_use"))
    sums = [F.sum(F.coalesce(F.col(f"message.usage.{c}"), F.lit(0))).alias(c) for c in COUNTS]
    return turns.groupBy("session_id").agg(F.count("*").alias("n_turns"), *sums, F.sum(tools).alias("n_tool_calls"), F.bool_or(F.coalesce("is_sidechain", F.lit(False))).alias("has_sidechain"))


def session_meta(lines: DataFrame) -> DataFrame:
    """session_id, cwd, git_branch (first non-empty), summary, title, last_ts (last non-empty)."""
    first = lambda c: F.min(F.when(F.col(c) != "", F.struct("line_no", "row_id", c)))[c].alias(c)
    last = lambda c, to: F.max(F.when(F.col(c) != "", F.struct("line_no", "row_id", c)))[c].alias(to)
    return lines.groupBy("session_id").agg(first("cwd"), first("git_branch"), last("summary", "summary"), last("title", "title"), last("ts", "last_ts"))


def first_prompt(lines: DataFrame, longest: int = 4096) -> DataFrame:
    """session_id, prompt: the first non-empty user text, cut to ``longest`` bytes."""
    said = lines.where(role() == "user").withColumn("text", turn_text()).where("text is not null")
    return said.groupBy("session_id").agg(F.min(F.struct("line_no", "row_id", "text"))["text"].alias("p")).select("session_id", truncate_bytes(F.col("p"), longest).alias("prompt"))


def changed_files(listing: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Files (path, mtime) that the state doesn't have with the same mtime."""
    return listing if force else listing.join(state, ["path", "mtime"], "left_anti")


def centroid(vectors: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """key, at, mean: the mean vector of each group by position."""
    return vectors.select(key, F.posexplode(embedding).alias("at", "v")).groupBy(key, "at").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def first_dimension(vectors: DataFrame, key: str, *order: str, embedding: str = "embedding") -> DataFrame:
    """Of each group the vectors that have as many numbers as its first one."""
    first = vectors.where(F.size(embedding) > 0).groupBy(key).agg(F.min(F.struct(*order, F.size(embedding).alias("_n")))["_n"].alias("_n"))
    return vectors.join(first, key).where(F.size(embedding) == F.col("_n")).drop("_n")


def salient(turns: DataFrame, budget: int) -> DataFrame:
    """session_id, uuid, line_no, score, kept: all turns, of which those are kept that greedy packing by score fits into ``budget`` bytes per session.

    turns: session_id, uuid, line_no, text, embedding, tools. The score is the cosine to the session's
    centroid (0.3 without a vector), plus 0.15 with tool calls and 0.25 for the opening user turn. The pass
    that skips what doesn't fit is sequential, so it runs per session over (uuid, size, score) only.
    """
    middle = centroid(turns.where("embedding is not null"), "session_id").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("center"))
    opening = turns.groupBy("session_id").agg(F.min(F.struct("line_no", "uuid"))["uuid"].alias("opening"))
    near = F.when(F.col("embedding").isNull() | F.col("center").isNull(), 0.3).otherwise(cosine(F.col("embedding"), F.col("center")))
    score = near + F.when(F.col("tools") > 0, 0.15).otherwise(0.0) + F.when((F.col("uuid") == F.col("opening")) & (F.col("role") == "user"), 0.25).otherwise(0.0)
    scored = turns.join(middle, "session_id", "left").join(opening, "session_id").select("session_id", "uuid", "line_no", F.octet_length("text").alias("size"), F.round(score, 6).alias("score"))
    # of turns of one size only the first budget / size can fit, so what a session's task gets is bounded whatever the session holds
    place = F.row_number().over(Window.partitionBy("session_id", "size").orderBy(F.desc("score"), "line_no", "uuid"))
    ranked = scored.withColumn("place", place).where(F.col("place") <= budget)
    some = ranked.where(F.col("place") * F.greatest("size", F.lit(1)) <= budget).drop("place")
    # one turn is kept even where none fits
    best = scored.groupBy("session_id").agg(F.min(F.struct((-F.col("score")).alias("down"), "line_no", "uuid", "size", "score")).alias("v")).select("session_id", "v.uuid", "v.line_no", "v.size", "v.score")
    some = some.unionByName(best).distinct()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["score", "line_no", "uuid"], ascending=[False, True, True])
        left, kept = budget, np.zeros(len(order), dtype=bool)
        for i, size in enumerate(order["size"].to_numpy()):
            if size <= left:
                kept[i] = True
                left -= size
        if not kept.any():
            kept[0] = True
        return order.assign(kept=kept)[["session_id", "uuid", "score", "kept"]]

    packed = some.groupBy("session_id").applyInPandas(pack, "session_id string, uuid string, score double, kept boolean")
    kept = packed.where("kept").select("session_id", "uuid", "kept")
    return scored.join(kept, ["session_id", "uuid"], "left").select("session_id", "uuid", "line_no", F.round("score", 6).alias("score"), F.coalesce("kept", F.lit(False)).alias("kept"))


_BLOCK = "array<struct<type string, text string, thinking string, signature string, id string, name string, input string, tool_use_id string, is_error boolean, content string>>"


def transcript_lines(texts: DataFrame) -> DataFrame:
    """Rows of raw transcript text (value) parsed tolerantly; bad lines are dropped.

    line_type, uuid, parent_uuid, ts, cwd, git_branch, is_sidechain, summary, title, message (role, model, usage,
    content, blocks): content is a string content, blocks the list of a list content with inputs and results as JSON text.
    """
    v = F.try_parse_json("value")
    get = lambda p, kind="string": F.expr(f"try_variant_get(v, '{p}', '{kind}')")
    body = F.get_json_object("value", "$.message.content")
    listed = F.trim(body).startswith("[") & (F.expr("schema_of_variant(try_variant_get(v, '$.message.content', 'variant'))").startswith("ARRAY"))
    raw = F.from_json(body, _BLOCK)
    blocks = F.transform(raw, lambda b: F.struct(b["type"].alias("block_type"), *[b[c].alias(c) for c in ("text", "thinking", "signature", "id", "name", "input", "tool_use_id", "is_error", "content")]))
    usage = F.struct(*[get(f"$.message.usage.{c}", "bigint").alias(c) for c in COUNTS])
    content = F.when(~F.coalesce(listed, F.lit(False)), get("$.message.content"))
    message = F.struct(get("$.message.role").alias("role"), get("$.message.model").alias("model"), usage.alias("usage"), content.alias("content"), F.when(listed, blocks).alias("blocks"))
    names = {"type": "line_type", "uuid": "uuid", "parentUuid": "parent_uuid", "timestamp": "ts", "cwd": "cwd", "gitBranch": "git_branch", "summary": "summary", "title": "title"}
    kept = [c for c in texts.columns if c != "value"]
    out = texts.withColumn("v", v).where("v is not null")
    return out.select(*kept, *[get(f"$.{a}").alias(b) for a, b in names.items()], get("$.isSidechain", "boolean").alias("is_sidechain"), message.alias("message"), get("$.message.role").alias("role"), content.alias("content"))


def head(lines: DataFrame, prompt_lines: int = 20, meta_lines: int = 10, longest: int = 500) -> DataFrame:
    """session_id, prompt, cwd, git_branch from the first lines alone: the first user text (cut to bytes, with an ellipsis) and the first non-empty metadata."""
    some = lines.where(F.col("line_no") <= max(prompt_lines, meta_lines)).withColumn("text", turn_text())
    said = F.min(F.when((F.col("line_no") <= prompt_lines) & (role() == "user") & F.col("text").isNotNull(), F.struct("line_no", "row_id", "text")))["text"]
    first = lambda c: F.min(F.when((F.col("line_no") <= meta_lines) & (F.col(c) != ""), F.struct("line_no", "row_id", c)))[c].alias(c)
    return some.groupBy("session_id").agg(said.alias("p"), first("cwd"), first("git_branch")).select("session_id", truncate_bytes(F.col("p"), longest, "...").alias("prompt"), "cwd", "git_branch")


def indexed_first(entries: DataFrame, found: DataFrame, key: str = "session_id") -> DataFrame:
    """The entries of an index, and of what else was found only what the index doesn't name."""
    return entries.withColumn("origin", F.lit("index")).unionByName(found.join(entries.select(key), key, "left_anti").withColumn("origin", F.lit("file")), allowMissingColumns=True)


def enrichment_inputs(turns: DataFrame, files: int = 100, shell: int = 50) -> DataFrame:
    """session_id, n_turns, files, commands, n_reflections: what a session's summary is made from; lists by count, then by name."""
    calls = tool_calls(turns)
    own = calls.select("tool_call_id", "session_id")

    def listed(rows: DataFrame, what: str, most: int, name: str) -> DataFrame:
        n = rows.join(own, "tool_call_id").groupBy("session_id", what).agg(F.count("*").alias("n"))
        order = Window.partitionBy("session_id").orderBy(F.desc("n"), what)
        n = n.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
        return n.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", what))), lambda x: x[what]).alias(name))

    base = turns.groupBy("session_id").agg(F.count("*").alias("n_turns"))
    thought = blocks(turns, "thinking").where("b.thinking <> ''").groupBy("session_id").agg(F.count("*").alias("n_reflections"))
    none = F.array().cast("array<string>")
    out = base.join(listed(file_touches(calls), "path", files, "files"), "session_id", "left").join(listed(commands(calls), "cmd", shell, "commands"), "session_id", "left").join(thought, "session_id", "left")
    return out.select("session_id", "n_turns", F.coalesce("files", none).alias("files"), F.coalesce("commands", none).alias("commands"), F.coalesce("n_reflections", F.lit(0)).alias("n_reflections"))


def signal_block(files: Column, shell: Column, cap: int, longest: int = 120) -> Column:
    """Files and commands as lines under a heading each, as far as ``cap`` bytes go; a list ends at the first line that no longer fits."""
    one = lambda c: F.concat(F.lit("- "), truncate_bytes(F.replace(c, F.lit("\n"), F.lit(" ")), longest, "…"), F.lit("\n"))
    plain = lambda c: F.concat(F.lit("- "), c, F.lit("\n"))

    def grown(start: Column, lines: Column) -> Column:
        state = F.aggregate(lines, F.struct(start.alias("s"), F.lit(True).alias("open")), lambda a, x: F.when(a["open"] & (F.octet_length(a["s"]) + F.octet_length(x) <= cap), F.struct(F.concat(a["s"], x).alias("s"), F.lit(True).alias("open"))).otherwise(F.struct(a["s"].alias("s"), F.lit(False).alias("open"))))
        return state["s"]

    a = F.when(F.size(files) > 0, grown(F.lit("[files touched]\n"), F.transform(files, plain))).otherwise(F.lit(""))
    b = F.when((F.size(shell) > 0) & (F.octet_length(a) < cap), grown(F.concat(a, F.lit("[commands run]\n")), F.transform(shell, one))).otherwise(a)
    return F.when(F.lit(cap) > 0, b).otherwise(F.lit(""))


def session_text(turns: DataFrame, budget: int) -> DataFrame:
    """session_id, text: kept turns (session_id, line_no, uuid, role, text, kept) in order with their roles, cut to ``budget`` bytes.

    The texts of one session were packed into the budget before, so what a group holds is bounded by it.
    """
    said = turns.where("kept").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "uuid", "role", "text"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(F.lit("\n---\n["), x["role"], F.lit("]\n"), x["text"])), "")
    return said.select("session_id", truncate_bytes(whole, budget).alias("text"))


def windows(texts: DataFrame, budget: int, overhead: int = 0) -> DataFrame:
    """session_id, line_no, uuid, window: consecutive turns in windows of at most ``budget`` bytes (a longer one alone), counted from 0.

    Greedy, so in order of the session; each session streams through its task in sorted pieces of (id, size) only.
    """
    rows = texts.select("session_id", "line_no", "uuid", (F.octet_length("text") + overhead).alias("size"))
    kind = "session_id string, line_no int, uuid string, window int"

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, at = None, 0, 0
        for pdf in parts:
            out = np.zeros(len(pdf), dtype=np.int32)
            for i, (s, n) in enumerate(zip(pdf["session_id"], pdf["size"])):
                if s != now:
                    now, used, at = s, 0, 0
                elif used and used + n > budget:
                    used, at = 0, at + 1
                used += n
                out[i] = at
            yield pdf[["session_id", "line_no", "uuid"]].assign(window=out)

    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "line_no", "uuid")
    return ordered.mapInPandas(fill, kind)


#: Names that say nothing (fixed values).
EMPTY_NAMES = ("type", "system", "hook", "subtype", "empty", "none", "database", "api", "code", "app", "stuff", "things", "service", "domain", "generic", "term", "concept")


def concept_names(named: DataFrame, longest: int = 220) -> DataFrame:
    """``named`` (name, description, ...) with names as slugs; those too short, too long, odd or empty of meaning left out, descriptions cut to bytes."""
    name = F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("-"))
    out = named.withColumn("name", name).withColumn("description", F.trim("description"))
    fine = F.octet_length("name").between(3, 60) & F.col("name").rlike(r"^[\p{L}\p{N}-]+$") & ~F.col("name").isin(*EMPTY_NAMES) & (F.col("description") != "")
    return out.where(fine).withColumn("description", truncate_bytes(F.col("description"), longest, "..."))


def merged_concepts(named: DataFrame, *order: str) -> DataFrame:
    """The first of each name in some order."""
    rest = [c for c in named.columns if c not in ("name", *order)]
    first = named.groupBy("name").agg(F.min(F.struct(*order, *rest)).alias("v"))
    return first.select("name", *[F.col(f"v.{c}") for c in (*order, *rest)])


def chunks(it: Iterator[str], budget: int) -> Iterator[list[str]]:
    """Consecutive texts in groups of at most ``budget`` bytes (a longer one alone), for callers that work on one session's texts."""
    held, size = [], 0
    for t in it:
        n = len(t.encode())
        if held and size + n > budget:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def listed_names(replies: DataFrame, reply: str) -> DataFrame:
    """``replies`` with a row for each distinct proper name of a reply that lists them with commas; one that says NONE has none."""
    told = replies.where(F.trim(reply) != "NONE")
    names = told.withColumn("name", F.explode(F.array_distinct(F.transform(F.split(reply, ","), lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("-"))))))
    return concept_names(names.withColumn("description", F.lit("-"))).drop("description")
