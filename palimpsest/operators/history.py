"""Full history of changing entity attributes from updates and periodic snapshots.

Every entity has a timeline of moments at which its state was reported.  For each pair of
entity and state hash a bitmap holds one bit per moment, set where that state held; runs of
consecutive bits are the versions.  Absent moments set no bit and so close a run.

Timelines longer than ``bucket_rows`` are split by time into buckets at per-entity quantiles, so
that no task ever holds a whole hot entity; runs are extracted per bucket and joined at the
seams, where only one row per bucket is looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

BITS = 32
#: States are told apart by their JSON, with every digit of a moment.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _hot_splits(moments: DataFrame, bucket_rows: int) -> DataFrame | None:
    """``e, splits`` for the entities with more than ``bucket_rows`` moments, or None if there are none.

    The number of such entities is at most rows / bucket_rows, whatever the skew.
    """
    counts = moments.groupBy("e").count().where(F.col("count") > bucket_rows)
    most = counts.agg(F.max("count")).first()[0]
    if most is None:
        return None
    n = math.ceil(most / bucket_rows)
    points = [i / n for i in range(1, n)] or [0.5]
    hot = moments.join(counts.select("e"), "e", "left_semi")
    return hot.groupBy("e").agg(F.percentile_approx("t", points, 20 * n).alias("splits"))


def _bucket(df: DataFrame, splits: DataFrame | None) -> DataFrame:
    """Add ``b``, the time bucket within the entity; 0 for entities that are not hot."""
    if splits is None:
        return df.withColumn("b", F.lit(0))
    held = F.size(F.filter("splits", lambda s: s <= F.col("t")))
    return df.join(splits, "e", "left").withColumn("b", F.when(F.col("splits").isNull(), 0).otherwise(held)).drop("splits")


def _run_starts(words: str) -> Column:
    """Micros at which each run of consecutive bits starts, and whether the run opens its bucket."""

    def of(w: Column, i: Column) -> Column:
        prev = F.get(F.col(words), i - 1)
        joined = (i > 0) & (prev["word"] == w["word"] - 1)
        carry = F.when(joined, F.shiftright(prev["bits"], BITS - 1).bitwiseAND(F.lit(1))).otherwise(F.lit(0)).cast("bigint")
        start = w["bits"].bitwiseAND(F.bitwise_not(F.shiftleft(w["bits"], 1).bitwiseOR(carry)))
        hit = F.filter(w["at"], lambda x: F.getbit(start, x["o"] % BITS) == 1)
        return F.transform(hit, lambda x: F.struct(x["t"].alias("t"), (x["o"] == 0).alias("opens")))

    return F.flatten(F.transform(F.col(words), of))


def versions(
    updates: DataFrame,
    entity: str = "concept_id",
    at: str = "updated_at",
    state: tuple[str, ...] = ("description", "source", "url", "invalid_at", "invalidated_by"),
    invalid_at: str | None = "invalid_at",
    rank: tuple[str, ...] = ("recorded_at", "update_id"),
    present: str | None = None,
    bucket_rows: int = 50_000,
) -> DataFrame:
    """One row per version: ``entity``, ``valid_from``, ``valid_to`` (micros; null = open), ``next_from``, and the state.

    Rows with a null entity or moment do not count.  Of rows for one entity and moment the one with
    the largest ``rank`` holds, nulls lowest, and then the largest state, so that ties and repeated
    rows give one defined result.  '' in a text field is null.  A version ends at the next one or at
    its own ``invalid_at``; a version that would be empty is kept with ``valid_to <= valid_from`` and
    is for :func:`history` to drop.  ``present`` names an optional boolean column: a row where it is
    false says that the entity was missing then, which closes the version without opening another.
    An empty table gives no rows; columns not named here are ignored whatever they are called.
    """
    kinds = dict(updates.dtypes)
    clean = lambda c: F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c)
    s = F.struct(*[clean(c).alias(f"s{i}") for i, c in enumerate(state)])
    there = F.coalesce(F.col(present), F.lit(True)) if present else F.lit(True)
    rows = updates.select(
        F.col(entity).alias("e"),
        _micros(F.col(at)).alias("t"),
        F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(rank)], there.alias("there"), s.alias("s")).alias("row"),
    ).where("e is not null and t is not null")
    splits = _hot_splits(rows.select("e", "t"), bucket_rows)
    moments = rows.groupBy("e", "t").agg(F.max("row").alias("row"))
    moments = _bucket(moments, splits).select("e", "b", "t", F.col("row.s").alias("s"), F.col("row.there").alias("there"))
    moments = moments.withColumn("h", F.when(F.col("there"), F.unhex(F.md5(F.to_json("s", EXACT)))))
    order = Window.partitionBy("e", "b").orderBy("t")
    moments = moments.withColumn("o", F.row_number().over(order) - 1)
    words = moments.groupBy("e", "b", "h", F.floor(F.col("o") / BITS).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("o") % BITS)).alias("bits"),
        F.collect_list(F.struct("o", "t")).alias("at"),
        F.first("s").alias("s"),
    )
    maps = words.groupBy("e", "b", "h").agg(F.array_sort(F.collect_list(F.struct("word", "bits", "at"))).alias("words"), F.first("s").alias("s"))
    runs = maps.select("e", "b", "h", "s", F.explode(_run_starts("words")).alias("run")).select("e", "b", "h", "s", "run.t", "run.opens")
    if splits is not None:
        runs = _without_seams(runs)
    runs = runs.withColumn("next", F.lead("t").over(order))
    if splits is not None:
        firsts = runs.groupBy("e", "b").agg(F.min("t").alias("first"))
        after = F.lead("first").over(Window.partitionBy("e").orderBy("b"))
        runs = runs.join(firsts.select("e", "b", after.alias("after")), ["e", "b"]).withColumn("next", F.coalesce("next", "after"))
    runs = runs.where("h is not null")
    ends = _micros(F.col(f"s.s{state.index(invalid_at)}")) if invalid_at else F.lit(None).cast("bigint")
    return runs.select(
        F.col("e").alias(entity),
        F.col("t").alias("valid_from"),
        F.least(F.col("next"), ends).alias("valid_to"),
        F.col("next").alias("next_from"),
        *[F.col(f"s.s{i}").alias(c) for i, c in enumerate(state)],
    )


def _without_seams(runs: DataFrame) -> DataFrame:
    """Drop the run that opens a bucket where the bucket before ended in the same state."""
    edge = runs.groupBy("e", "b").agg(F.max_by(F.coalesce("h", F.lit(b"")), "t").alias("last"))
    before = edge.select("e", "b", F.lag("last").over(Window.partitionBy("e").orderBy("b")).alias("before"))
    same = F.col("opens") & F.col("before").isNotNull() & (F.coalesce("h", F.lit(b"")) == F.col("before"))
    return runs.join(before, ["e", "b"]).where(~same).drop("before")


def history(updates: DataFrame, entity: str = "concept_id", **options) -> DataFrame:
    """The versions with a non-empty period; ``valid_to`` is null where neither a next version nor an end exists."""
    return versions(updates, entity, **options).where("valid_to is null or valid_to > valid_from")


def successor(rows: DataFrame, keys: list[str], at: str, tie: str, name: str, bucket_rows: int = 50_000) -> DataFrame:
    """``rows`` with the moment of the next row of the same keys (by ``at``, then ``tie``; null after the last).

    Long series are cut into time buckets like entities, so that a hot key is no task's burden.
    """
    marked = rows.withColumn("e", F.struct(*keys)).withColumn("t", _micros(F.col(at)))
    splits = _hot_splits(marked.where("t is not null").select("e", "t"), bucket_rows)
    marked = _bucket(marked, splits)
    marked = marked.withColumn(name, F.lead(at).over(Window.partitionBy("e", "b").orderBy("t", tie)))
    if splits is not None:
        firsts = marked.groupBy("e", "b").agg(F.min(at).alias("first"))
        after = F.lead("first").over(Window.partitionBy("e").orderBy("b"))
        marked = marked.join(firsts.select("e", "b", after.alias("after")), ["e", "b"]).withColumn(name, F.coalesce(name, "after"))
    return marked.select(*rows.columns, name)


def as_of(
    versions_: DataFrame,
    queries: DataFrame,
    entity: str = "concept_id",
    when: str = "as_of",
    expired: str = "include_expired",
    now: str | None = None,
    bucket_rows: int = 50_000,
) -> DataFrame:
    """Answer each query row by the version in force at its moment (null = ``now``).

    ``versions_`` is the result of :func:`versions`.  The last version that started by then holds;
    unless ``expired`` is true it must not have ended by its own invalidation.  Queries without such a
    version keep null version columns.  Both sides are merged on (entity, time bucket), so no pair of
    a query and a version is ever formed.
    """
    moment = F.coalesce(F.col(when).cast("timestamp"), F.lit(now).cast("timestamp") if now else F.current_timestamp())
    fields = [c for c in versions_.columns if c != entity]
    no = F.lit(None).cast(versions_.select(F.struct(*fields)).schema[0].dataType)
    q = F.struct(*queries.columns)
    left = versions_.select(F.col(entity).alias("e"), F.col("valid_from").alias("t"), F.lit(0).alias("side"), F.struct(*fields).alias("v"), F.lit(None).cast(queries.select(q).schema[0].dataType).alias("q"))
    right = queries.select(F.col(entity).alias("e"), _micros(moment).alias("t"), F.lit(1).alias("side"), no.alias("v"), q.alias("q"))
    both = Scratch(queries.sparkSession, "as_of").save(left.unionByName(right))  # the versions are worked out once
    splits = _hot_splits(both.where("e is not null").select("e", "t"), bucket_rows)
    both = _bucket(both, splits)
    order = Window.partitionBy("e", "b").orderBy("t", "side")
    both = both.withColumn("v", F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if splits is not None:
        ends = both.where("v is not null").groupBy("e", "b").agg(F.max_by("v", F.struct("t", "side")).alias("tail"))
        spans = both.select("e", "b").distinct().join(ends, ["e", "b"], "left")
        before = F.last("tail", ignorenulls=True).over(Window.partitionBy("e").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        both = both.join(spans.select("e", "b", before.alias("tail")), ["e", "b"], "left").withColumn("v", F.coalesce("v", "tail"))
    held = F.coalesce(F.col(f"q.{expired}"), F.lit(False)) | F.col("v.valid_to").isNull() | (F.col("v.valid_to") > F.col("t"))
    out = both.where("side = 1").withColumn("v", F.when(held, F.col("v")))
    return out.select("q.*", *[F.col(f"v.{c}").alias(c if c not in queries.columns else f"version_{c}") for c in fields])
