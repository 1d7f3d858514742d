"""What the operators share: the shared folder, word splitting, distributed ranks."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.plans.graphs import components  # noqa: F401
from corvane.plans.storage import delete, shared_dir, stored, stored_paths  # noqa: F401

#: The white space of every word rule here: blank, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Broadcasts of tables that grow with the data are only tried below this many rows of a few numbers each (some 30 MB).
BROADCAST_ROWS = 1_000_000
_LIBC = ctypes.CDLL(None)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for inner use that df does not have, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mark() -> int:
    """A point in the list of this thread's stored tables, for discard()."""
    return len(stored_paths())


def discard(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables stored since a mark, without those that `keep` reads: what was made from the others must be stored by then."""
    kept = " ".join(f for df in keep for f in df.inputFiles())
    for path in [p for p in stored_paths()[since:] if p.rsplit("/", 1)[1] not in kept]:
        delete(spark, path)
        stored_paths().remove(path)
    released(spark)


def released(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that nothing refers to when the driver collects garbage; after a large table is stored that is asked for, so that they don't lie beside the next ones."""
    for _ in range(2):  # what the first round lets go of is only collected by the next
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves it small, else as it is (a shuffle join)."""
    return F.broadcast(df) if small(df, rows) else df


def held_out(column: str = "doc_id", mod: int = 5, rest: int = 0) -> Column:
    """Fold of a row: crc32 of the id as text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod) == rest


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [b or b"" for b in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


#: Rows that a Python worker is sent at a time where the session leaves Spark's default: whole texts are large rows.
BATCH_ROWS = 2_000


def give_back() -> None:
    """A worker serves many tasks: what one has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def lists(values: np.ndarray, ends: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flattened values and the end of each list."""
    offsets = pa.array(np.concatenate([[0], np.asarray(ends, dtype=np.int64)]).astype(np.int32), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def spread(values: np.ndarray) -> np.ndarray:
    """Mix 64-bit numbers (the finaliser of a well known public generator), so any bits can be used."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES.encode())] = False
#: One random-looking number for each byte of a word; blanks add nothing.
_OF_BYTE = np.where(_IS_WORD, spread(np.arange(1, 257, dtype=np.uint64) << np.uint64(20)), np.uint64(0))
#: Bytes of text that are hashed together.
CHUNK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64; the longest list so far is kept."""
    if len(_KEPT_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 2 * CHUNK), base, np.uint64)
        steps[0] = 1
        _KEPT_POWERS[base] = np.multiply.accumulate(steps)
    return _KEPT_POWERS[base][:n]


_KEPT_POWERS: dict[int, np.ndarray] = {}


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    """Runs of texts of about so many bytes, a longer text on its own."""
    held, total = [], 0
    for text in texts:
        if held and total + len(text) > size:
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text) + 1
    if held:
        yield held


def word_hashes(texts: list[bytes], lower: bool = True, apart: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after the other, and the words of each text.

    lower: with A-Z lower-cased; apart: more bytes that part words, besides white space.  A word's
    hash is a polynomial in its bytes' numbers, taken from running sums over all the texts, then mixed.
    """
    whole = b"\n".join(texts) + b"\n"
    data = np.frombuffer(whole.lower() if lower else whole, np.uint8)
    word = _IS_WORD[data]
    if apart:
        word &= ~np.isin(np.arange(256), list(apart))[data]
    turns = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = turns[::2], turns[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_OF_BYTE[data] * _powers(_STEP, len(data)), out=sums[1:])
        found = (sums[ends] - sums[starts]) * _powers(_BACK, len(data))[starts]
        found = spread(found + (ends - starts).astype(np.uint64) * np.uint64(_BACK))
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return found, np.diff(upto, prepend=0)


def n_words(text: Column) -> Column:
    """Number of words, JVM-side; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def dealt_key(*columns: Column) -> Column:
    """An even 60-bit hash of some columns (md5, which every SQL engine has), 0 <= key < 2**60."""
    joined = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, group: list[str], key: str, value: str, ties: list[str], cell_rows: int = 4096) -> DataFrame:
    """Adds `before` (rows of the group ahead of this one in order of key, ties) and `sum_before` (their value).

    A group may be any share of the table: its rows are dealt by ranges of the
    evenly spread key into cells of about cell_rows, cells are summed, and only
    the small table of cells is ordered per group.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    cells = df.join(hinted(sizes), group)
    cells = cells.withColumn("__cell", F.floor(F.col(key) / F.lit(2.0**60) * F.ceil(F.col("__n") / cell_rows)).cast("long")).drop("__n")
    at = cells.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__rows"), F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    at = at.select(*group, "__cell", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__sum"))
    inside = Window.partitionBy(*group, "__cell").orderBy(key, *ties)
    out = cells.withColumn("__row", F.row_number().over(inside) - 1).withColumn("__part", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    out = out.join(at, [*group, "__cell"])
    return out.withColumn("before", F.col("__rows") + F.col("__row")).withColumn("sum_before", F.col("__sum") + F.col("__part")).drop("__cell", "__rows", "__sum", "__row", "__part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LONGS = T.ArrayType(T.LongType())
