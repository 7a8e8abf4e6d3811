import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audit, search, sessions, writes
from palimpsest.scratch import Scratch, spread
from palimpsest.sources import exports, readers


def test_transcript_files_and_incremental_state(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"user","uuid":"u1","message":{"role":"user","content":"hi"}}\n{oops\n')
    lines = readers.transcripts(spark, str(tmp_path))
    assert [r.uuid for r in sessions.transcript_lines(lines).collect()] == ["u1"]
    listing = lines.select("path", "mtime").distinct()
    assert sessions.changed_files(listing, listing).count() == 0
    assert sessions.changed_files(listing, listing.withColumn("mtime", F.col("mtime") - 1)).count() == 1
    assert sessions.changed_files(listing, listing, force=True).count() == 1


def test_session_index_queue_and_triggers(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"entries": [{"sessionId": "s1", "messageCount": 3}, {"sessionId": "s2", "isSidechain": True}]}))
    got = {r.sessionId: (r.messageCount, r.isSidechain) for r in readers.session_index(spark, str(tmp_path / "index.json")).collect()}
    assert got == {"s1": (3, None), "s2": (None, True)}
    (tmp_path / "inbox.json").write_text('{"query":"a"}\n\n{bad\n{"query":"b","namespace":"g"}\n')
    assert sorted(r.query for r in readers.queue(spark, str(tmp_path / "inbox.json")).collect()) == ["a", "b"]
    (tmp_path / "triggers.txt").write_text("# comment\n\n  first.*\nsecond\n")
    assert [r.pattern for r in readers.triggers(spark, str(tmp_path / "triggers.txt")).orderBy("at").collect()] == ["first.*", "second"]


@pytest.mark.parametrize(("raw", "want"), [('[{"type":"t","text":"a"},{"text":"b"},{"text":null}]', "a\n\nb"), ('["a","b"]', "a\n\nb"), ("plain text", "plain text"), ("", "")])
def test_meeting_text(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(readers.meeting_text(F.col("c"))).first()[0] == want


def test_cache_expires_strictly_after_its_time(spark):
    rows = [("u", "old", 0), ("u", "new", 100), ("v", "edge", 50), ("w", "late", 49)]
    cache = spark.createDataFrame(rows, "url string, content string, s int").withColumn("fetched_at", F.timestamp_seconds("s"))
    now = F.timestamp_seconds(F.lit(350))
    assert {(r.url, r.content) for r in readers.fresh(cache, now).collect()} == {("u", "new"), ("v", "edge")}
    assert readers.fresh(cache, now, 0).count() == 0


def test_markdown_and_exports(spark):
    t = spark.createDataFrame([("a", "long cell"), (None, "b")], "x string, y string")
    assert {r.line for r in readers.csv_markdown(["x", "y"], t).collect()} == {"| a | long cell |", "|   | b         |"}
    n = spark.createDataFrame([(1, "it's", "global", None), (2, "b", "lab", "s\\t")], "concept_id int, name string, namespace string, source string")
    assert [json.loads(r.json)["properties"] for r in exports.json_nodes(n, "Concept", ["name", "source"], ["atlas"]).collect()] == [{"name": "it's"}]
    assert sorted(r.statement for r in exports.create_nodes(n, "Concept", ["name", "source"]).collect()) == ["CREATE (:Concept {name: 'b', source: 's\\\\t'});", "CREATE (:Concept {name: 'it\\'s'});"]


def test_salience_packs_by_score_within_the_budget(spark):
    rows = [("s", "u1", 1, "opening " * 5, [1.0, 0.0], 0, "user"), ("s", "u2", 2, "x" * 30, [1.0, 0.1], 2, "assistant"), ("s", "u3", 3, "y" * 30, [-1.0, 0.0], 0, "user"), ("s", "u4", 4, "z" * 5, None, 0, "user")]
    t = spark.createDataFrame(rows, "session_id string, uuid string, line_no int, text string, embedding array<float>, tools int, role string")
    got = {r.uuid: (round(r.score, 3), r.kept) for r in sessions.salient(t, 80).collect()}
    assert got["u1"][1] and got["u2"][1] and not got["u3"][1] and got["u4"] == (0.3, True)


def test_block_search_in_many_blocks(spark):
    rows = [(i, [float(i % 7) + 1, float(i % 5), float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    one = {tuple(r) for r in search.block_search(df.where("vec_id % 10 = 0"), df, 4).collect()}
    many = {tuple(r) for r in search.block_search(df.where("vec_id % 10 = 0"), df, 4, block_rows=9).collect()}
    assert one == many and len(one) == 24
    assert search.block_search(df.limit(0), df, 4).count() == 0


def test_merges_are_undone_by_run(spark):
    c = spark.sql("SELECT id AS concept_id, cast(null AS timestamp) AS expired_at FROM range(3)")
    m = spark.createDataFrame([(1, 0)], "duplicate bigint, canonical bigint")
    done = writes.apply_merges(c, m, F.lit("2024-01-01").cast("timestamp"), "r1")
    assert {r.concept_id: (r.expired_at is not None, r.merge_run) for r in done.collect()} == {0: (False, None), 1: (True, "r1"), 2: (False, None)}
    assert all(r.expired_at is None for r in writes.undo_merges(done, "r1").collect())
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "src int, run string")
    assert {r.src for r in audit.rollback(e).collect()} == {1, 3} and {r.src for r in audit.rollback(e, "a").collect()} == {2, 3}


def test_scratch_tables_and_spreading(spark, tmp_path):
    df = spark.range(100)
    s = Scratch(spark, "t")
    kept = s.save(df)
    assert kept.count() == 100 and s.path in kept.inputFiles()[0]
    s.drop(kept)
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one, "id").rdd.getNumPartitions() > 1 and spread(one, "id").count() == 100
