"""Streams of arriving rows: copies told and counted by identity, sessions kept open per subject, running reports.

What must be known of earlier batches is state by key in the stream's checkpoint, not the earlier rows: a batch reads its own rows
and the state of the groups of keys it touches.  A watermark lets go of what no row can change any more; rows that come
later than the delay are dropped.  Results are written per batch under the batch's number, so a batch that is run again
overwrites only itself, and `path` and `state` of an earlier run carry it on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.plans.storage import fresh_path

_DAY_MS = 86_400_000


def read_stream(spark: SparkSession, like: DataFrame, path: str, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream of known schema."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def first_seen(stream: DataFrame, identity: Sequence[str], at: str, delay: str) -> DataFrame:
    """Each identity once within the watermark's delay."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(list(identity))


def running_report(stream: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows so far by status and reason, for update mode."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def _batches(stream: DataFrame, mode: str, path: str | None, state: str | None) -> DataFrame:
    """Drain what is there; each batch's rows under its number, read back with it in column batch."""
    spark = stream.sparkSession
    path, state = path or fresh_path(spark, "stream"), state or fresh_path(spark, "state")

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(path)


def to_table(stream: DataFrame, mode: str = "append", path: str | None = None, state: str | None = None) -> DataFrame:
    """Drain what is there into a table in the shared folder and read it: all rows in append mode, in complete mode those of the last batch."""
    rows = _batches(stream, mode, path, state)
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi")
    return rows.drop("batch")


#: Groups that keys are dealt into.  One call of Python and one piece of state serve a group, as a call for each key costs more than its rows.
GROUPS = 8_192
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _grouped(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with their key as a text, __key, and its group."""
    return rows.withColumn("__key", F.to_json(F.struct(*key), _MICROS)).withColumn("__group", F.pmod(F.xxhash64(*key), F.lit(GROUPS)).cast("int")).drop(*key)


def _keys(schema: T.StructType, key: Sequence[str]) -> list:
    """The columns of a key from its text."""
    parsed = F.from_json("__key", T.StructType([T.StructField(c, schema[c].dataType) for c in key]), _MICROS)
    return [parsed[c].alias(c) for c in key]


def _hold(held: GroupState, kept: tuple[list, ...], until: list[int]) -> None:
    """Keeps a group's state until the first of its keys is to be looked at."""
    if until:
        held.update(kept)
        held.setTimeoutTimestamp(max(min(until), held.getCurrentWatermarkMs() + 1))
    else:
        held.remove()


def count_copies(stream: DataFrame, identity: Sequence[str], at: str, delay: str, path: str | None = None, state: str | None = None) -> DataFrame:
    """(identity, first_seen, last_seen, copies): a row for each identity, whose further rows are its copies.

    An identity is held until the watermark is past its last row and the delay; one that
    comes again after that starts over.
    """
    rows = stream.select(*identity, F.col(at).cast("timestamp").alias("__at")).withWatermark("__at", delay)

    def seen(_: tuple, frames: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        keys, *columns = held.get if held.exists else ([],) * 6
        known, new = dict(zip(keys, zip(*columns, strict=True), strict=True)), {}
        for frame in () if held.hasTimedOut else frames:
            for key, us in zip(frame["__key"].tolist(), frame["__us"].tolist(), strict=True):
                low, high, n = new.get(key, (us, us, 0))
                new[key] = min(low, us), max(high, us), n + 1
        passed = held.getCurrentWatermarkMs()
        out, kept = [], {key: row for key, row in known.items() if key not in new and row[-1] >= passed}
        for key, (low, high, n) in new.items():
            opened, first, last, copies, _until = known.get(key, (low, low, high, -1, 0))  # earlier rows may still come: opened names the row that stands for them all
            row = opened, min(low, first), max(high, last), copies + n
            out.append((key, *row))
            kept[key] = *row, max(row[2] // 1000, passed) + 1
        _hold(held, (list(kept), *([list(x) for x in zip(*kept.values(), strict=True)] or [[]] * 5)), [row[-1] for row in kept.values()])
        yield pd.DataFrame(out, columns=["__key", "opened", "first_seen", "last_seen", "copies"])

    known_ = _grouped(rows.filter(F.col("__at").isNotNull()), identity).withColumn("__us", F.unix_micros("__at")).groupBy("__group")
    out = known_.applyInPandasWithState(seen, "__key string, opened long, first_seen long, last_seen long, copies long", "keys array<string>, opened array<long>, first array<long>, last array<long>, copies array<long>, until array<long>", "update", GroupStateTimeout.EventTimeTimeout)
    found = _batches(out.select(*_keys(stream.schema, identity), *[F.timestamp_micros(c).alias(c) for c in ("opened", "first_seen", "last_seen")], "copies"), "update", path, state)
    newest = F.max_by(F.struct("first_seen", "last_seen", "copies"), "batch").alias("now")
    return found.groupBy(*identity, "opened").agg(newest).select(*identity, "now.*")


def folded(days: dict[int, int], window_days: int) -> list[tuple[int, int, int]]:
    """(first, last, n) of the sessions of days with their counts: a day joins the open session within window_days of its first."""
    out: list[tuple[int, int, int]] = []
    for day in sorted(days):
        if out and day - out[-1][0] <= window_days:
            out[-1] = (out[-1][0], day, out[-1][2] + days[day])
        else:
            out.append((day, day, days[day]))
    return out


def keep_sessions(stream: DataFrame, subject: str, day: str, window_days: int, delay: str, path: str | None = None, state: str | None = None) -> DataFrame:
    """(subject, session_first, session_last, n) of all rows so far, as the batch operator gives them.

    State of a subject are its days that a row within the delay can still regroup.  A session no such row can join is
    written as final and forgotten; what follows it starts anew in any case, as it would have.  A
    subject's open sessions are those of the newest batch that names it.
    """
    rows = stream.select(F.col(subject), F.to_date(day).alias("__day")).filter("__day is not null")
    rows = rows.withColumn("__at", F.col("__day").cast("timestamp")).withWatermark("__at", delay)

    def fold(_: tuple, frames: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        keys, sizes, flat, counts, until = held.get if held.exists else ([],) * 5
        known, start = {}, 0
        for key, size, look in zip(keys, sizes, until, strict=True):
            known[key] = dict(zip(flat[start : start + size], counts[start : start + size], strict=True)), look
            start += size
        passed, now = held.getCurrentWatermarkMs(), {}
        for frame in () if held.hasTimedOut else frames:
            for key, number in zip(frame["__key"].tolist(), frame["__number"].tolist(), strict=True):
                days = now.get(key)
                if days is None:
                    days = now[key] = known[key][0] if key in known else {}
                days[number] = days.get(number, 0) + 1
        now |= {key: days for key, (days, look) in known.items() if key not in now and look < passed}
        kept, out = {key: x for key, x in known.items() if key not in now}, []
        for key, days in now.items():
            found = [(first, last, n, (first + window_days) * _DAY_MS <= passed) for first, last, n in folded(days, window_days)]
            out += [(key, *x) for x in found]
            open_from = next((first for first, _, _, final in found if not final), None)
            if open_from is not None:
                kept[key] = {d: n for d, n in days.items() if d >= open_from}, max((open_from + window_days) * _DAY_MS, passed) + 1
        lists = [days for days, _ in kept.values()]
        looks = [look for _, look in kept.values()]
        _hold(held, (list(kept), [len(x) for x in lists], [d for x in lists for d in x], [n for x in lists for n in x.values()], looks), looks)
        yield pd.DataFrame(out, columns=["__key", "first", "last", "n", "final"])

    grouped = _grouped(rows.withColumn("__number", F.unix_date("__day")).drop("__day"), [subject]).groupBy("__group")
    out = grouped.applyInPandasWithState(fold, "__key string, first int, last int, n long, final boolean", "keys array<string>, sizes array<int>, days array<int>, counts array<long>, until array<long>", "update", GroupStateTimeout.EventTimeTimeout)
    ends = [F.date_from_unix_date(c).alias(f"session_{c}") for c in ("first", "last")]
    found = _batches(out.select(*_keys(stream.schema, [subject]), *ends, "n", "final"), "update", path, state)
    newest = found.groupBy(F.col(subject).alias("__s")).agg(F.max("batch").alias("__batch"))
    return found.join(newest, F.col(subject).eqNullSafe(F.col("__s"))).filter("final or batch = __batch").select(subject, "session_first", "session_last", "n")
