"""Edits, retries and deletions of turns fold into their last version."""

from pyspark.sql import functions as F

from palimpsest.llm import conversations

LINES = "row_id bigint, session_id string, line_type string, uuid string, parent_uuid string, ts string, is_sidechain boolean, message struct<role string, content string, blocks array<struct<block_type string, text string>>>, ingested_at timestamp, gone boolean"


def line(row, uuid, parent, role, ts, content="hi", gone=None):
    return (row, "s", "user", uuid, parent, f"2024-01-01T00:00:{ts:02d}Z", None, (role, content, None), None, gone)


def told(df, **k):
    return sorted((r.root_uuid, r.seq_no, r.uuid) for r in conversations.conversations(df, **k).collect())


def test_edits_replace_text_and_parent(spark):
    rows = [
        line(1, "a1", None, "user", 1, content=" "), line(2, "a1", None, "user", 2, content="now filled"), line(3, "a2", "a1", "assistant", 3),
        line(4, "b1", None, "user", 1), line(5, "b2", "b1", "assistant", 2), line(6, "b2", "b1", "assistant", 3, content=""),  # edited to nothing
        line(7, "c1", None, "user", 1), line(8, "c2", "a1", "assistant", 1), line(9, "c2", "c1", "assistant", 5),  # moved to another parent
    ]
    assert told(spark.createDataFrame(rows, LINES)) == [("a1", 1, "a1"), ("a1", 2, "a2"), ("c1", 1, "c1"), ("c1", 2, "c2")]


def test_deletions_count_if_they_come_last(spark):
    rows = [
        line(1, "a1", None, "user", 1), line(2, "a2", "a1", "assistant", 2), line(3, "a2", "a1", "assistant", 3, gone=True),  # the only reply is deleted
        line(4, "b1", None, "user", 1), line(5, "b2", "b1", "assistant", 2, gone=True), line(6, "b2", "b1", "assistant", 4),  # deleted, then written again
        line(7, "c1", None, "user", 1), line(8, "c2", "c1", "assistant", 9, gone=True), line(9, "c3", "c1", "assistant", 2),  # the reply before counts again
    ]
    df = spark.createDataFrame(rows, LINES)
    gone = F.coalesce(F.col("gone"), F.lit(False))
    assert told(df, deleted=gone) == [("b1", 1, "b1"), ("b1", 2, "b2"), ("c1", 1, "c1"), ("c1", 2, "c3")]
    assert ("a1", 2, "a2") in told(df)
