"""Write layer, full-text index, cascade, session text, loop: edges of their inputs, and the golden questions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars
from palimpsest.operators import audit, graph, search, sessions, writes
from palimpsest.streaming import deadends

T = "2024-01-01T00:00:00Z"


def at(text=T):
    return F.lit(text).cast("timestamp")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- writes -------------------------------------------------------------------------------
def test_upsert_keeps_columns_and_folds_repeated_keys(spark):
    old = spark.createDataFrame([("a", "g", "old", 1, "x"), ("b", None, "old", 2, "y"), ("c", "g", "old", 3, "z")], "name string, namespace string, description string, created int, more string")
    new = spark.createDataFrame([("a", "g", "", 9), ("b", None, "new", 9), ("b", None, "new", 9), ("d", None, None, 9), ("d", None, "first", 8)], "name string, namespace string, description string, created int")
    got = rows(graph.upsert(old, new, ["name", "namespace"], ["description"], ["created"]))
    assert got == sorted([("a", "g", "old", 1, "x"), ("b", None, "new", 2, "y"), ("c", "g", "old", 3, "z"), ("d", None, "first", 9, None)], key=str)
    assert rows(graph.upsert(old, new.limit(0), ["name", "namespace"], ["description"], ["created"])) == rows(old)
    assert graph.upsert(old.limit(0), new.limit(0), ["name", "namespace"], ["description"], ["created"]).count() == 0


def test_merge_runs_are_undone_one_by_one(spark):
    c = spark.createDataFrame([(1, None), (2, None), (3, None), (4, None)], "concept_id bigint, expired_at timestamp")
    m = lambda *p: spark.createDataFrame(list(p), "duplicate bigint, canonical bigint")
    one = writes.apply_merges(c, m((2, 1), (2, 1)), at(), "run-1")
    two = writes.apply_merges(one, m((3, 1), (2, 4)), at(), "run-2")
    told = lambda df: {r.concept_id: (r.merged_into, r.merge_run, r.expired_at is not None) for r in df.collect()}
    assert told(two) == {1: (None, None, False), 2: (1, "run-1", True), 3: (1, "run-2", True), 4: (None, None, False)}
    assert told(writes.undo_merges(two, "run-2"))[3] == (None, None, False) and told(writes.undo_merges(two, "run-2"))[2] == (1, "run-1", True)
    assert told(writes.undo_merges(two, "run-1"))[2] == (None, None, False)


def test_column_updates_and_replaced_rows(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2), (None, "n", 3)], "id int, v string, k int")
    new = spark.createDataFrame([(1, None, 0), (2, "b", 0), (2, "a", 0), (9, "z", 0)], "id int, v string, k int")
    assert rows(writes.set_columns(old, new, "id", ["v"])) == sorted([(1, "a", 1), (2, "b", 2), (None, "n", 3)], key=str)
    assert rows(writes.unmatched(new, old, "id")) == [(9, "z", 0)]
    assert rows(writes.replace_rows(old, new, "id")) == sorted([(1, None, 0), (2, "b", 0), (9, "z", 0), (None, "n", 3)], key=str)
    assert rows(writes.set_columns(old, new.limit(0), "id", ["v"])) == rows(old)


def test_patches_sources_and_moves(spark):
    p = spark.createDataFrame([("a", "old", None, None, 1), ("b", "old", None, None, 2)], "name string, content string, valid_at timestamp, invalid_at timestamp, concept_id int").withColumn("invalid_at", at()).withColumn("valid_at", at("2020-01-01T00:00:00Z"))
    got = {r.name: r for r in writes.upsert_patches(p, spark.createDataFrame([("a", ""), ("c", "x"), ("c", "x")], "name string, content string"), at()).collect()}
    assert got["a"].content == "old" and got["a"].invalid_at is None and got["a"].valid_at.year == 2024 and got["b"].invalid_at is not None and got["c"].content == "x" and len(got) == 3
    e, free = writes.invalidation_edges(spark.createDataFrame([(1, "b"), (2, "free words"), (2, "free words"), (3, None), (4, "d")], "concept_id bigint, cause string"), spark.createDataFrame([(2, "b"), (7, "b"), (4, "d")], "concept_id bigint, name string"))
    assert rows(e) == [(1, "INVALIDATED_BY", 2)] and rows(free) == [(2, "free words")]
    before = spark.createDataFrame([(1, "x"), (2, None)], "concept_id int, namespace string")
    moved = writes.move_patches(spark.createDataFrame([(1, "x", "p"), (1, "y", "q"), (2, None, "r")], "concept_id int, namespace string, n string"), before, before.withColumn("namespace", F.lit("new")))
    assert rows(moved) == [(1, "new", "p"), (1, "y", "q"), (2, "new", "r")]
    assert writes.move(spark.createDataFrame([("a.b-1", "x"), ("aXb-1", "x")], "name string, namespace string"), "a.b", "y").where("namespace = 'y'").count() == 1


# -- full text ------------------------------------------------------------------------------
def test_index_scores_as_the_scan(spark):
    rnd = random.Random(4)
    words = ["red", "blue", "green", "it's", "x1", "Ünder"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), rnd.choice(words)) for i in range(60)] + [(100, None, ""), (101, "red blue red blue", None)]
    df = spark.createDataFrame(docs, "key bigint, text string, score string")
    index = search.build_index(df, "key", ["text", "score"])
    for query in ("red", "red blue", "It's under", "nothing here", "", "red red"):
        w = {"text": 1.0, "score": 3.0}
        scan = search.bm25(df.withColumnRenamed("score", "head"), {"text": 1.0, "head": 3.0}, query, keep=["key"])
        found = search.search_index(*index, query, w)
        near = lambda d: {r.key: round(r.score, 9) for r in d.collect()}
        assert near(found) == near(scan)
    empty = search.build_index(df.limit(0), "key", ["text"])
    assert search.search_index(*empty, "red", {"text": 1.0}).count() == 0
    assert search.search_index(*index, "rad", {"text": 1.0}, fuzzy="text").count() > 0 and search.search_index(*index, "rad", {"text": 1.0}).count() == 0


#: A small invented world and questions about it (fixed values).
WORLD = [
    ("Quorrin Labs", "A fictional applied-research lab."),
    ("Project Zephyr", "A Quorrin Labs networking project that uses a mesh network topology."),
    ("Project Marlowe", "A Quorrin Labs database project."),
    ("Driftwood", "A columnar time-series database, distributed under the GPL license."),
    ("Halberd", "A coastal city in Norvenia."),
    ("Tomas Reyne", "An engineer at Quorrin Labs."),
    ("Zephyr lead: Mira Calden", "Project Zephyr is led by Mira Calden."),
    ("Zephyr lead: Selka Voss", "Project Zephyr is led by Selka Voss."),
    ("Zephyr lead: Ade Okonkwo", "Project Zephyr is led by Ade Okonkwo."),
]
GOLDEN = [
    ("Where is Quorrin Labs headquartered?", ["Quorrin Labs", "Halberd"]),
    ("columnar time-series database", ["Driftwood"]),
    ("who designed Driftwood's storage engine", ["Tomas Reyne", "Driftwood"]),
    ("Project Zephyr network topology", ["Project Zephyr"]),
    ("Driftwood software license", ["Driftwood"]),
    ("engineer who works at Quorrin Labs", ["Tomas Reyne"]),
    ("coastal city in Norvenia", ["Halberd"]),
    ("Quorrin Labs database project", ["Project Marlowe"]),
]


def test_golden_questions(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(WORLD)], "key bigint, name string, description string")
    index = search.build_index(df, "key", ["name", "description"])
    results, expected = [], []
    for k, (query, names) in enumerate(GOLDEN):
        found = search.search_index(*index, query, {"name": 3.0, "description": 1.0}).collect()
        best = sorted(found, key=lambda r: (-r.score, r.key))
        results += [(k, WORLD[r.key][0], i + 1) for i, r in enumerate(best)] or [(k, "", 1)]
        expected += [(k, n) for n in names]
    m = search.ranked_metrics(spark.createDataFrame(results, "query_id int, item string, rank int"), spark.createDataFrame(expected, "query_id int, item string"), 3)
    r = m.agg(F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("mrr")).first()
    assert r.recall == pytest.approx(0.875) and r.mrr == pytest.approx(0.8125)
    assert search.require_recall(m, 0.8) == pytest.approx(0.875)
    with pytest.raises(AssertionError):
        search.require_recall(m, 0.9)


def test_entries_come_from_the_first_tier_that_knows(spark):
    one = lambda *r: spark.createDataFrame(list(r), "concept_id bigint, name string, score double, rank int")
    none, named = one().select("concept_id", "name"), one((1, "a b", 1.0, 1)).select("concept_id", "name")
    hybrid = one(*[(i, f"h{i}", 0.5, i) for i in range(1, 6)])
    tier = lambda *a, **k: rows(search.entries(*a, **k).select("tier", "concept_id"))
    assert tier("a b", named, one(), hybrid) == [("exact", 1)]
    assert tier("red ledger", none, one((1, "odd", 60.0, 1), (2, "red-ledger-1", 3.0, 2)), hybrid) == [("fulltext", 2)]
    assert tier("red old ledger", none, one((2, "red-ledger-1", 3.0, 1)), hybrid) == [("hybrid", 1), ("hybrid", 2), ("hybrid", 3)]
    assert tier("red old ledger", none, one((2, "red-ledger-1", 50.0, 1)), hybrid) == [("fulltext", 2)]
    assert tier("x", none, one(), hybrid, semantic=False) == []


def test_triggers_patterns_and_replies(spark):
    p = spark.createDataFrame([(1, "A Budget", "x"), (2, None, "x"), (3, "the (odd", "x"), (4, "", "x")], "prompt_id bigint, text string, pattern string")
    pats = spark.createDataFrame([(2, "bud.et"), (1, "(odd"), (3, None), (4, "")], "at int, pattern string")
    near = spark.createDataFrame([(2, "c2"), (1, "c1")], "prompt_id bigint, concept string")
    assert rows(search.triggered(p, pats, near)) == [(1, "bud.et", None), (2, None, "c2"), (3, "(odd", None), (4, None, None)]
    t = spark.createDataFrame([(1, "abcab"), (2, None), (3, "")], "text_id bigint, text string")
    k = spark.createDataFrame([(1, "ab"), (2, "bca"), (3, "ab"), (4, None), (5, "")], "pattern_id bigint, pattern string")
    assert rows(search.contained(t, k)) == [(1, 1), (1, 2), (1, 3)] and search.contained(t, k.limit(0)).count() == 0
    s = spark.createDataFrame([("[2], 2, 9 1",), ("none",), (None,)], "r string").select(search.picked(F.col("r"), 3).alias("p"))
    assert [r.p for r in s.collect()][:2] == [[2, 1], [1, 2, 3]]
    v = spark.createDataFrame([("x\nCorrect\n\n",), ("correct\nincorrect",), ("",), (None,)], "r string").select(search.verdict(F.col("r")).alias("v"))
    assert [r.v for r in v.collect()] == [True, False, False, False]


# -- scalars and session text ---------------------------------------------------------------------
def test_bytes_csv_and_times(spark):
    texts = ["abc", "äöü€😀z", "", None, "€€€€"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(1, 9):
        got = [r.c for r in df.select(scalars.truncate_bytes(F.col("t"), n).alias("c")).collect()]
        want = [None if t is None else max((t[:k] for k in range(len(t) + 1) if len(t[:k].encode()) <= n), key=len) for t in texts]
        assert got == want
    lines = ['a,"b, c",d', '"say ""hi""",, x ', "", '""', None]
    got = [r.c for r in spark.createDataFrame([(x,) for x in lines], "t string").select(scalars.csv_cells(F.col("t")).alias("c")).collect()]
    assert got == [["a", "b, c", "d"], ['say "hi"', "", "x"], [""], [""], None]
    s = [r.s for r in spark.createDataFrame([("30s",), ("5m",), ("1h",), ("7",), ("x",), ("",), (None,)], "t string").select(scalars.interval_seconds(F.col("t")).alias("s")).collect()]
    assert s == [30, 300, 3600, 7, None, None, None]
    u = [r.u for r in spark.createDataFrame([("```json\n{}\n```",), ("{}",), (None,)], "t string").select(scalars.unfenced(F.col("t")).alias("u")).collect()]
    assert u == ["{}", "{}", None]


def test_signal_block_and_windows(spark):
    df = spark.createDataFrame([(["a" * 5, "b" * 30, "c"], ["ls\n-l", "x" * 200]), ([], []), ([], ["pwd"])], "f array<string>, c array<string>")
    block = lambda cap: [r.s for r in df.select(sessions.signal_block(F.col("f"), F.col("c"), cap).alias("s")).collect()]
    assert block(40)[0] == "[files touched]\n- aaaaa\n[commands run]\n" and block(0) == ["", "", ""]
    assert block(10_000)[0] == "[files touched]\n- aaaaa\n- " + "b" * 30 + "\n- c\n[commands run]\n- ls -l\n- " + "x" * 120 + "…\n" and block(100)[2] == "[commands run]\n- pwd\n"
    t = spark.createDataFrame([("s", i, f"u{i}", "y" * n) for i, n in enumerate((5, 5, 20, 1, 9, 1))] + [("t", 0, "v", "y")], "session_id string, line_no int, uuid string, text string")
    got = {r.uuid: r.window for r in sessions.windows(t, 10).collect()}
    assert got == {"u0": 0, "u1": 0, "u2": 1, "u3": 2, "u4": 2, "u5": 3, "v": 0} and sessions.windows(t.limit(0), 10).count() == 0


def test_transcript_lines_keep_blocks(spark):
    lines = [
        {"type": "user", "uuid": "u1", "parentUuid": None, "timestamp": T, "cwd": "/x", "gitBranch": "main", "isSidechain": False, "message": {"role": "user", "content": "do [it]"}},
        {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "message": {"role": "assistant", "model": "m", "usage": {"input_tokens": 3}, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "uuid": "u2", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "no"}, {"type": "text", "text": "such"}]}]}},
        {"type": "summary", "summary": "what it was"},
    ]
    df = spark.createDataFrame([(json.dumps(x), i) for i, x in enumerate(lines)] + [("{broken", 9), ("", 10), (None, 11)], "value string, at int")
    got = {r["at"]: r for r in sessions.transcript_lines(df).collect()}
    assert set(got) == {0, 1, 2, 3} and got[0].message.content == "do [it]" and got[0].message.blocks is None and got[0].is_sidechain is False
    assert [b.block_type for b in got[1].message.blocks] == ["thinking", "tool_use"] and json.loads(got[1].message.blocks[1].input) == {"command": "ls"} and got[1].message.usage.input_tokens == 3
    text = sessions.transcript_lines(df).where("at = 2").select(sessions.result_text(F.col("message.blocks")[0]["content"]).alias("t")).first().t
    assert text == "no\nsuch" and got[3].summary == "what it was"


# -- audits and the loop --------------------------------------------------------------------------
def test_older_comes_first_and_missing_starts_last(spark):
    c = spark.createDataFrame([(1, "b", "n", "2024-01-02"), (2, "a", "n", "2024-01-01"), (3, "a", "n", None), (4, "a", None, None)], "concept_id bigint, name string, namespace string, d string").withColumn("valid_at", F.to_timestamp("d"))
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 1, 0.95), (1, 3, 0.99), (3, 4, 0.91), (4, 4, 1.0)], "a bigint, b bigint, similarity double")
    assert [tuple(r) for r in audit.older_newer(pairs, c).collect()] == [(1, 3, 0.99), (2, 1, 0.95), (4, 3, 0.91)]


def test_loop_keeps_bad_times_fails_safe_and_repeats_nothing(spark, tmp_path):
    inbox, out = tmp_path / "inbox", tmp_path / "out"
    inbox.mkdir()

    def moody(queries):
        if queries.str.contains("boom").any():
            raise RuntimeError("no answer")
        return deadends.by_rule(queries)

    said = [{"query": "boom box"}, {"timestamp": "never", "query": "plain thing"}, {"timestamp": "1970-01-01T00:00:00Z", "query": "old thing"}, {"query": "plain thing"}]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, said)))
    seen = []
    for _ in range(2):
        deadends.run(spark, str(inbox), str(out), str(tmp_path / "state"), moody, apply=lambda df: seen.append(df.count())).awaitTermination()
    (inbox / "2.json").write_text(json.dumps({"timestamp": "1960-01-01T00:00:00Z", "query": "older thing"}))
    deadends.run(spark, str(inbox), str(out), str(tmp_path / "state"), moody).awaitTermination()
    got = {n: sorted(r.query for r in spark.read.json(str(out / n)).collect()) for n in ("pending", "review")}
    assert got == {"pending": ["old thing", "older thing", "plain thing"], "review": ["boom box"]} and sum(seen) == 2


def test_pending_and_reviews(spark):
    c = spark.createDataFrame([("a", "global", "d", 1)], "name string, namespace string, description string, more int")
    p = spark.createDataFrame([("a", None, "r"), ("b", "x", "r2"), ("b", "x", "r1"), ("no good", None, "r"), (None, None, "r")], "concept string, namespace string, reason string")
    after, left = deadends.apply_pending(p, c)
    assert rows(after) == sorted([("a", "global", "d", 1), ("b", "x", "r1", None)], key=str) and left.count() == 2
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query string")
    parts = deadends.reviewed(q, spark.createDataFrame([("a", "Commit"), ("b", "skip"), ("c", "quit")], "query string, choice string"))
    assert [rows(x) for x in parts] == [[("a",)], [("b",)], [("c",)]]


def test_guards_caches_and_first_dimensions(spark):
    from palimpsest.sources import readers

    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    with pytest.raises(ValueError):
        audit.require_unique(df, ["k"])
    assert audit.require_unique(df, ["k", "v"]).count() == 3
    cache = spark.createDataFrame([("u", "old"), ("w", "old")], "url string, content string").withColumn("fetched_at", at("2023-12-31T23:50:00Z"))
    new = spark.createDataFrame([("u", "new"), ("u", "new"), ("x", None)], "url string, content string")
    put = readers.cache_put(cache, new, at())
    assert sorted((r.url, r.content) for r in put.collect()) == [("u", "new"), ("w", "old"), ("x", None)]
    assert sorted(r.url for r in readers.cache_sweep(put, at()).collect()) == ["u", "x"] and readers.cache_put(cache, new, at(), 0).count() == 2
    v = spark.createDataFrame([("g", 2, [1.0]), ("g", 1, [1.0, 2.0]), ("g", 3, [3.0, 4.0]), ("g", 0, []), ("h", 1, None)], "k string, o int, embedding array<double>")
    assert sorted(r.o for r in sessions.first_dimension(v, "k", "o").collect()) == [1, 3]
    walks = graph.walk(spark.createDataFrame([(1, "R", 2), (1, "R", 3), (2, "R", 4)], "src int, rel_type string, dst int"), spark.createDataFrame([(1,)], "start int"), 2, limit=2)
    assert rows(walks) == [(1, 2, 1), (1, 3, 1)]
    c = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, None), (4, "x")], "concept_id int, description string")
    m = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3)], "duplicate int, canonical int")
    assert rows(audit.adopt_descriptions(c, m)) == [(1, "abcd"), (2, "abcd"), (3, "x"), (4, "x")]
