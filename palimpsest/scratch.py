"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table under ``spark.checkpoint.dir`` and
reading it back: the files survive the loss of an executor, which a local checkpoint does not.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def base_dir(spark: SparkSession) -> str:
    """The shared folder: the session's checkpoint directory, or, in local mode only, one of our own where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        running = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = running.get() if running.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="palimpsest-")
    return "file://" + _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def clean_up() -> None:
    """Delete what the running sessions wrote, as far as they still can."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended
            pass
    _written.clear()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in enough partitions for all cores, where a table comes in fewer parts than there are cores.

    That happens to tables of few files only (parts of ``spark.sql.files.maxPartitionBytes`` at most), so
    what is shuffled is bounded by that size times the cores; larger tables are left as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    if df.isStreaming or "Exchange" in run.executedPlan().toString():
        return df
    if run.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(3 * cores, F.xxhash64(*by))


_held: dict[tuple, tuple[str, tuple[DataFrame, ...]]] = {}


def once(spark: SparkSession, key: tuple, make) -> tuple[DataFrame, ...]:
    """The tables that ``make`` writes into a scratch area, made at their first use in a session and again if they were deleted meanwhile."""
    key = (spark.sparkContext.applicationId, *key)
    if key in _held:
        path, made = _held[key]
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return made
    scratch = Scratch(spark, "held")
    made = make(scratch)
    _held[key] = scratch.path, made
    return made


def forget() -> None:
    """Make the held tables anew at their next use, for sessions whose stored tables have changed."""
    _held.clear()


class Scratch:
    """Tables of one operator call, written to the shared folder under a name of their own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{base_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        _written.append((spark, self.path))

    def save(self, df: DataFrame, *by: str) -> DataFrame:
        """Write ``df`` (in folders by some columns) and return the written table; its plan no longer depends on ``df``."""
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that no later plan reads."""
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.path.rsplit("/", 1)[1] in name:
                _delete(self.spark, name)
