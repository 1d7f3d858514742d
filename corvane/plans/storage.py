"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local sessions that set none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends, a lost executor repeats nothing.  It goes when the driver ends, if discard() has not deleted it before."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "corvane")
    df.write.option("compression", "zstd").parquet(path)
    stored_paths().append(path)
    _ALL.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_LOCAL = threading.local()
_ALL: list[tuple[SparkSession, str]] = []


def stored_paths() -> list[str]:
    """Paths that this thread has stored tables at, and not deleted."""
    return _LOCAL.__dict__.setdefault("paths", [])


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _end() -> None:
    """What is still stored goes with the driver; where its session has ended already, the folder is the cluster's to clear."""
    for spark, path in _ALL:
        with contextlib.suppress(Exception):
            delete(spark, path)


#: Most rows of a table that a caller hands over and that is sent to every task.
SMALL = 100_000


def small_or_shuffled(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df with a broadcast hint where a count proves it small, else as it is (joined by shuffle)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows that a task should hold at once where it sorts them.
PART_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of so many rows, dealt by its keys over parts that grow in number with the rows, so that what a task sorts does not; as it is where the session's number of parts will do."""
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
