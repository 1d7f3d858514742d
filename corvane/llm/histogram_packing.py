"""Best-fit packing planned on the histogram of lengths.

Documents become token ids, and ids pieces of at most `room`.  The driver sees
only how many pieces have each length: best fit by falling length is worked
out on these counts, many like pieces at a time, in as many steps as lengths and
halvings of `room` allow, however many pieces there are.  A step of the plan
gives pieces of one length, from one rank on, their places in a run of like
sequences.  Pieces are ranked within their length by the task that cut them, and
the sums of the tasks before; then each takes the place of its rank.

Tokens are those of a file of the tokenizers library.  For byte-level files
whose ids follow the order of their merges, texts of Latin letters go through a faster
encoder of the same ranks, and each task compares some of its texts with the
library first; all other texts go through the library itself.  Strings of special tokens are ordinary text.

Defined results: a null or empty text is one piece, the end id alone; rows are
packed each on its own, also where ids repeat or are null; an empty table gives
an empty result.
"""

from __future__ import annotations

import collections
import functools
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

ROOM, END = 1024, 2
#: The split of texts before merges that byte-level files use, and what it comes to where no two white spaces meet: fixed values.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT_SINGLE = r"""'(?:[sdmt]|re|ve|ll)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"""
_RUNS, _FAR = re.compile(r"\s\s"), re.compile("[^\x00-ɏ]")
#: Texts of each task that both encoders read.
COMPARED = 5


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def encoder(path: str) -> tuple[Callable[[str], list[int]], Callable[[str], list[int]]]:
    """(the fast encoder, the library's) for a file, once for each worker; they are the same where no fast one fits."""
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True

    def by_library(text: str) -> list[int]:
        return library.encode(text, add_special_tokens=False).ids

    told = json.loads(library.to_str())
    splits = told.get("pre_tokenizer") or {}
    model, special = told["model"], {t["content"] for t in told.get("added_tokens", [])}
    ranks = _ranks({w: i for w, i in library.get_vocab().items() if w not in special})
    plain = model.get("type", "BPE") == "BPE" and not any((told.get("normalizer"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")))
    if not (ranks and plain and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")):
        return by_library, by_library
    any_text, single = (tiktoken.Encoding(f"ranks-{i}", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for i, p in enumerate((SPLIT, SPLIT_SINGLE)))

    def fast(text: str) -> list[int]:
        if _FAR.search(text):
            return by_library(text)
        return (any_text if _RUNS.search(text) else single).encode_ordinary(text)

    return fast, by_library


def _ranks(vocabulary: dict[str, int]) -> dict[bytes, int] | None:
    """Tokens as bytes, if the file's letters stand for bytes and ids count up without gaps."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]  # bytes that stand for themselves
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    if sorted(vocabulary.values()) != list(range(len(vocabulary))) or any(c not in letters for w in vocabulary for c in w):
        return None
    return {bytes(letters[c] for c in w): i for w, i in vocabulary.items()}


def best_fit(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, pieces, first sequence, pieces in each, offset) of best fit by falling length.

    A piece goes where least is left of what holds it.  All sequences with the same room left are one
    entry, and once a piece has gone into one of them, that one is the best for the next of its length: so each step fills
    as many as it can, and cuts at most one entry in three.
    """
    steps, opened = [], 0
    free: dict[int, list[tuple[int, int]]] = collections.defaultdict(list)
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        holding = [r for r in free if r >= length and free[r]]
        heapq.heapify(holding)
        while left:
            while holding and not free[holding[0]]:
                heapq.heappop(holding)
            if holding:
                open_room = holding[0]
                first, many = free[open_room].pop()
            else:
                open_room, first, many = room, opened, -(-left // (room // length))
                opened += many
            each = open_room // length
            full = min(many, left // each)
            for sequences, inside in ((full, each), (int(full < many and left > full * each), left - full * each)):
                if sequences and inside:
                    steps.append((length, rank, sequences * inside, first, inside, room - open_room))
                    rest = open_room - inside * length
                    free[rest].append((first, sequences))
                    if rest >= length:
                        heapq.heappush(holding, rest)
                    rank, left, first, many = rank + sequences * inside, left - sequences * inside, first + sequences, many - sequences
            if many:
                free[open_room].append((first, many))
    return steps


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end: int = END, ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 (and ids), and of its task's pieces of that length the how manieth it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, library = encoder(tokenizer)
        task, seen, compared = TaskContext.get().partitionId(), collections.Counter(), 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            kept: list[np.ndarray] = []
            for i, name in enumerate(names):
                text = texts[i] or ""
                found = fast(text)
                if compared < COMPARED:
                    compared += 1
                    if found != library(text):
                        raise ValueError(f"{tokenizer}: the two encoders differ")
                tokens = np.array([*found, end], "<u4")
                cut = len(tokens) % room or room
                for k, start in enumerate([0, *range(cut, len(tokens), room)]):
                    part = tokens[start : cut + k * room]
                    for column, value in zip(out, (name, k, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]), strict=True):
                        column.append(value)
                    seen[len(part)] += 1
                    if ids:
                        kept.append(part)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            if ids:
                columns.append(C.lists(np.concatenate([np.zeros(0, np.int32), *kept]).astype(np.int32), np.cumsum(out[3]), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])
        C.give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM, end: int = END, ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves if asked."""
    cut = C.stored(pieces(docs, tokenizer or default_tokenizer(), room, end, ids))
    tasks = C.stored(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = np.array(sorted(best_fit(counts, room)), np.int64).reshape(-1, 6)
    lengths = np.array(sorted(counts), np.int64)
    # ranks of all lengths on one line: a length's begin where those of the shorter ones end
    line = np.concatenate([[0], np.cumsum([counts[n] for n in lengths.tolist()])]).astype(np.int64)
    begins = line[np.searchsorted(lengths, steps[:, 0])] + steps[:, 1]
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("length", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = cut.join(tasks, ["length", "task"]).withColumn("nth", F.col("before") + F.col("nth")).drop("before", "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            at = line[np.searchsorted(lengths, length)] + rank
            step = np.searchsorted(begins, at, side="right") - 1
            inside, each = at - begins[step], steps[step, 4]
            placed = {"sequence_id": pa.array(steps[step, 3] + inside // each), "offset": pa.array(steps[step, 5] + inside % each * length)}
            yield pa.RecordBatch.from_arrays([placed[c] if c in placed else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * ids
    names = [f.split()[0] for f in schema.split(", ")]
    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pack(..., ids=True): the tokens of each sequence, at most `room`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
