"""Rebuilding conversations from message rows.

The rows are an event log: creates, edits, retries and repeated deliveries of a turn fold by
version into its final state, and a deletion removes it.  Each turn then keeps the one reply that
is followed, so that the links form chains; the hierarchy operator numbers them, and conversations
with a broken, empty or missing turn are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hierarchy import hierarchy
from ..scratch import Scratch

#: Any character that is not white space; also for the separators that count as white space by name only.
NOT_BLANK = r"[^\s\x1c-\x1f\x85\p{Z}]"


def instant(ts: Column) -> Column:
    """Microseconds since 1970 of a time as text; null where it is missing or unreadable.

    All digits are milliseconds since 1970; a time without zone is UTC.
    """
    t = F.trim(ts)
    millis = F.when(t.rlike(r"^\d+$"), F.expr("1000L") * F.call_function("try_to_number", t, F.lit("9" * 18)).cast("bigint"))
    dated = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]|$)")
    zoned = t.rlike(r"(Z|z|[+-]\d{1,2}(:?\d{2})?|UTC|GMT)$") & F.contains(t, F.lit(":"))
    stamp = F.when(dated, F.when(zoned, t).otherwise(F.concat(t, F.when(F.contains(t, F.lit(":")), F.lit("Z")).otherwise(F.lit("T00:00:00Z")))))
    return F.coalesce(millis, F.unix_micros(stamp.try_cast("timestamp")))


def _has_text(c: Column) -> Column:
    return F.coalesce(c.rlike(NOT_BLANK), F.lit(False))


def fold_turns(lines: DataFrame, deleted: Column | None = None) -> DataFrame:
    """One row per uuid in its final version: uuid, parent, t (micros), sidechain, role, filled, told.

    The version with the latest ``ts`` holds, then the latest ``ingested_at``, then the largest
    ``row_id``; where ``deleted`` holds for the final version, the turn is dropped.  Lines without uuid
    are no turns.  '' is null throughout.
    """
    blocks, kinds = F.col("message.blocks"), F.array(F.lit("tool_use"), F.lit("tool_result"))
    talks = F.exists(blocks, lambda b: ((b["block_type"] == "text") & _has_text(b["text"])) | F.array_contains(kinds, b["block_type"]))
    role = F.lower(F.regexp_replace(F.col("message.role"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    said = F.when(F.coalesce(F.col("message.role"), F.lit("")) == "", F.col("line_type")).otherwise(role)
    turns = lines.where("uuid is not null and uuid <> ''").select(
        "uuid",
        F.struct(
            instant(F.col("ts")).alias("t"),
            F.col("ingested_at").alias("at"),
            F.col("row_id").alias("row"),
            F.nullif(F.col("parent_uuid"), F.lit("")).alias("parent"),
            F.coalesce("is_sidechain", F.lit(False)).alias("sidechain"),
            said.alias("role"),
            (_has_text(F.col("message.content")) | F.coalesce(talks, F.lit(False))).alias("filled"),
            (deleted if deleted is not None else F.lit(False)).alias("gone"),
        ).alias("v"),
    )
    final = turns.groupBy("uuid").agg(F.max("v").alias("v"))
    return final.where("not v.gone").select("uuid", "v.parent", "v.t", "v.sidechain", "v.role", "v.filled")


def conversations(lines: DataFrame, deleted: Column | None = None) -> DataFrame:
    """root_uuid, seq_no (from 1), uuid, role, t: the turns of every conversation that is kept.

    A conversation starts at a turn with null or empty parent and follows, of several replies, the one
    with the latest time (missing or unreadable earliest), then the larger uuid.  Sidechain turns take
    no part.  It is kept if its turns are user, assistant, user, ... and end with an assistant, and none
    is empty.  Rings never start, replies to unknown turns belong nowhere; an empty table gives no rows.
    """
    scratch = Scratch(lines.sparkSession, "conversations")
    turns = scratch.save(fold_turns(lines, deleted).where("not sidechain").drop("sidechain"))
    starts = turns.where("parent is null").select("uuid", F.lit(None).cast("string").alias("parent"))
    followed = turns.where("parent is not null").groupBy("parent").agg(F.max(F.struct("t", "uuid")).alias("next")).select(F.col("next.uuid").alias("uuid"), "parent")
    chains = hierarchy(starts.unionByName(followed), "uuid", "parent").where("not in_ring").select(F.col("node").alias("uuid"), "root", "depth")
    told = chains.join(turns, "uuid")
    right = F.when(F.col("depth") % 2 == 0, F.col("role") == "user").otherwise(F.col("role") == "assistant")
    kept = told.groupBy("root").agg(
        F.bool_and(F.coalesce(right, F.lit(False)) & F.col("filled")).alias("ok"),
        F.max("depth").alias("last"),
        F.bool_or((F.col("depth") == 0) & F.col("parent").isNull()).alias("started"),
    )
    kept = kept.where("ok and started and last % 2 = 1").select("root")
    out = told.join(kept, "root", "left_semi")
    return out.select(F.col("root").alias("root_uuid"), (F.col("depth") + 1).cast("int").alias("seq_no"), "uuid", "role", "t")
