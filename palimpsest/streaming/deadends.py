"""The loop that learns from failed lookups, as Structured Streaming.

Failed queries arrive as files in an inbox directory; each batch is deduplicated by query, decided
by a pluggable classifier, and routed to one sink per decision.  Offsets in the checkpoint take the
place of truncating the inbox, so nothing that arrives during a batch is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import INBOX

Classifier = Callable[[pd.Series], pd.Series]


def by_rule(queries: pd.Series) -> pd.Series:
    """A deterministic stand-in: short ones are discarded, questions wait for review, the rest is committed."""
    n = queries.fillna("").str.strip()
    return n.map(lambda q: "DISCARD" if len(q) < 4 else "QUEUE" if q.endswith("?") else "COMMIT")


def first_by_query(rows: DataFrame, *order: str) -> DataFrame:
    """Of rows with the same query the first."""
    rest = [c for c in rows.columns if c not in (*order, "query")]
    first = rows.groupBy("query").agg(F.min(F.struct(*order, *rest)).alias("v"))
    return first.select(*[F.col("query") if c == "query" else F.col(f"v.{c}") for c in rows.columns])


def _judged(classify: Classifier, queries: pd.Series) -> pd.Series:
    """The classifier's answers; a row on which it fails waits for review, and so does one without an answer."""
    try:
        return classify(queries).fillna("QUEUE")
    except Exception:  # noqa: BLE001 - whatever the classifier raises; its rows are tried one by one
        if len(queries) == 1:
            return pd.Series(["QUEUE"], index=queries.index)
        return pd.concat([_judged(classify, queries.iloc[i : i + 1]) for i in range(len(queries))])


def decided(rows: DataFrame, classify: Classifier = by_rule) -> DataFrame:
    """``rows`` with decision (COMMIT, DISCARD, else QUEUE) and the concept's slug."""
    judge = F.pandas_udf(lambda s: _judged(classify, s), "string")
    d = F.coalesce(judge("query"), F.lit("QUEUE"))
    return rows.withColumn("decision", F.when(d.isin("COMMIT", "DISCARD"), d).otherwise("QUEUE")).withColumn("concept", F.lower(F.replace("query", F.lit(" "), F.lit("-"))))


def route_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("decision").agg(F.count("*").alias("n"))


def grown(before: DataFrame, now: DataFrame) -> DataFrame:
    """queue, n: the queues that hold more than when last told."""
    return now.join(before.withColumnRenamed("n", "told"), "queue", "left").where("n > coalesce(told, 0)").select("queue", "n")


def run(spark: SparkSession, inbox: str, out: str, checkpoint: str, classify: Classifier = by_rule, once: bool = True, apart: str | None = "7 days", apply: Callable[[DataFrame], None] | None = None):
    """Start the loop: inbox/*.json -> out/{pending,review,discarded,log}/batch=N; returns the streaming query.

    Rows count by their arrival, whatever time they bear, so that a missing or old one loses none.  A query that comes
    again within ``apart`` of its first is dropped (None: within one batch only).  Each batch writes folders of its
    own and writes them whole, so a retried batch changes nothing.  ``apply`` gets the committed rows of each batch.
    """
    stream = spark.readStream.schema(INBOX).json(inbox)
    if apart:
        stream = stream.withColumn("at", F.current_timestamp()).withWatermark("at", apart).dropDuplicatesWithinWatermark(["query"]).drop("at")

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = decided(first_by_query(batch.where("query is not null"), "timestamp"), classify).withColumn("processed_at", F.current_timestamp().cast("string")).persist()
        for decision, name in (("COMMIT", "pending"), ("QUEUE", "review"), ("DISCARD", "discarded")):
            rows.where(F.col("decision") == decision).write.mode("overwrite").json(f"{out}/{name}/batch={batch_id}")
        route_counts(rows).write.mode("overwrite").json(f"{out}/log/batch={batch_id}")
        if apply is not None:
            apply(rows.where("decision = 'COMMIT'"))
        rows.unpersist()

    write = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (write.trigger(availableNow=True) if once else write.trigger(processingTime="1 minute")).start()


def apply_pending(pending: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts (name, namespace, description, ...) after ``pending`` (concept, namespace, reason), and the rows that stay pending.

    A row without a proper name is retained; one whose concept is there already is done.  Of several rows for one
    concept the smallest reason holds.
    """
    fine = F.coalesce(F.col("concept").rlike(r"^[\p{L}\p{N}][\p{L}\p{N}_:.-]*$"), F.lit(False))
    new = pending.where(fine).groupBy(F.col("concept").alias("name"), F.coalesce("namespace", F.lit("global")).alias("namespace")).agg(F.min("reason").alias("description"))
    new = new.join(concepts.select("name", "namespace"), ["name", "namespace"], "left_anti")
    return concepts.unionByName(new, allowMissingColumns=True), pending.where(~fine)


def reviewed(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Committed, skipped and still waiting rows of a review queue by ``decisions`` (query, choice: commit or skip)."""
    told = decisions.groupBy("query").agg(F.min(F.lower("choice")).alias("_choice"))
    both = queue.join(told, "query", "left")
    return tuple(both.where(w).drop("_choice") for w in ("_choice = 'commit'", "_choice = 'skip'", "_choice is null or _choice not in ('commit', 'skip')"))


def told_state(before: DataFrame, now: DataFrame) -> DataFrame:
    """queue, n, notify: the counts to remember, also where they shrank, and whether to tell of each."""
    return now.join(before.withColumnRenamed("n", "_told"), "queue", "left").select("queue", "n", (F.col("n") > F.coalesce("_told", F.lit(0))).alias("notify"))


def log_misses(misses: DataFrame, inbox: str) -> None:
    """Append failed lookups to the inbox as one file per task."""
    misses.select(*[F.col(c.split(" ")[0]).cast("string") for c in INBOX.split(", ")]).write.mode("append").json(inbox)


def misses_per_hour(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts of misses in event-time windows of an hour (an extension of the loop)."""
    return stream.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "namespace").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "namespace", "n")
