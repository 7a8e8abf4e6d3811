"""Readers: transcripts, queues, trigger files, session indexes, cached pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INBOX = "timestamp string, session string, namespace string, command string, query string, context string"
INDEX = "entries array<struct<sessionId string, firstPrompt string, summary string, messageCount bigint, created string, modified string, gitBranch string, projectPath string, isSidechain boolean, fileMtime bigint>>"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """value, path, mtime: raw lines of transcript files, for :func:`palimpsest.operators.sessions.transcript_lines`."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.unix_seconds("_metadata.file_modification_time").alias("mtime"))


def session_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of the index files."""
    return spark.read.schema(INDEX).option("multiLine", "true").json(path).select(F.explode("entries").alias("e")).select("e.*")


def queue(spark: SparkSession, path: str, schema: str = INBOX) -> DataFrame:
    """Lines of a queue directory; unreadable and blank ones dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def triggers(spark: SparkSession, path: str) -> DataFrame:
    """pattern, at: lines of a trigger file without blanks and comments, in order within the file."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).select(F.trim("value").alias("pattern"), "at")
    return lines.where("pattern <> '' and pattern not like '#%'")


def meeting_text(raw: Column) -> Column:
    """Text of a meeting transcript: JSON list of {type, text} or of strings joined by blank lines, anything else as it is."""
    items = F.from_json(raw, "array<struct<type string, text string>>")
    plain = F.from_json(raw, "array<string>")
    said = F.array_join(F.filter(F.transform(items, lambda x: x["text"]), lambda t: t.isNotNull()), "\n\n")
    return F.coalesce(F.nullif(said, F.lit("")), F.when(raw.startswith("["), F.nullif(F.array_join(plain, "\n\n"), F.lit(""))), raw)


def fresh(cache: DataFrame, now: Column, seconds: int = 300, *tie: str) -> DataFrame:
    """The latest cached fetch of each url, if it is no older than ``seconds``; 0 bypasses the cache."""
    latest = Window.partitionBy("url").orderBy(F.desc("fetched_at"), *tie)
    kept = cache.where(F.unix_seconds(now) - F.unix_seconds("fetched_at") <= seconds) if seconds else cache.limit(0)
    return kept.withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn")


def csv_markdown(header: list[str], rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A table's rows as markdown lines, padded to the widest cell of each column."""
    wide = rows.agg(*[F.greatest(F.lit(len(h)), F.coalesce(F.max(F.length(h)), F.lit(0))).alias(h) for h in header]).first()
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    return rows.select(*(keep or []), line([F.rpad(F.coalesce(h, F.lit("")), wide[h], " ") for h in header]).alias("line"))


def cache_put(cache: DataFrame, fetched: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """The cache (url, content, fetched_at) after fetches (url, content): one entry per url; with 0 ``seconds`` the cache is neither read nor written."""
    if not seconds:
        return cache
    new = fetched.groupBy("url").agg(F.max("content").alias("content")).withColumn("fetched_at", now)
    return cache.join(new.select("url"), "url", "left_anti").select("url", "content", "fetched_at").unionByName(new)


def cache_sweep(cache: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """The cache without entries older than ``seconds``."""
    return cache.where(F.unix_seconds(now) - F.unix_seconds("fetched_at") <= seconds)
