"""Exact duplicates by counting quotient filters and byte verification.

Each partition builds a counting quotient filter of its documents' fingerprints.
A fingerprint splits into a quotient and a remainder; inside a quotient the
remainders are kept sorted, each with a count, so filters merge losslessly by
merging sorted remainders and adding counts.  Fingerprints whose count stays one
belong to unique documents.  The documents behind all others are grouped by
their normalised bytes, so a fingerprint that two texts share does no harm.

Defined results: a null text counts as empty, and all empty texts are copies of
one another; rows that repeat a doc_id count as rows of the group; a null doc_id
loses every tie; an empty table gives an empty result.  Only doc_id and text are
read; other columns may have any name, and deduplicate() keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bits of a fingerprint above the remainder; the top ROUTE_BITS of them name the shuffle bucket.
QUOTIENT_BITS, ROUTE_BITS, REMAINDER_BITS = 32, 10, 32
_WS = C.SPACES.encode()
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_points", pa.int64()), ("fp", pa.int64()), ("sha", pa.string())])
_FILTER = pa.schema([("bucket", pa.int32()), ("quotients", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())])
_REPEATED = pa.schema([("fp", pa.int64()), ("n", pa.int64())])


def normalised(text: Column) -> Column:
    """Text without the white space that the comparison ignores."""
    return F.translate(F.coalesce(text, F.lit("")), C.SPACES, "")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, points, prints, shas = batch.column(0), [], [], []
        for text in C.raw(batch):
            sha = hashlib.sha256(text.translate(None, _WS))
            points.append(len(text) if text.isascii() else len(text.decode("utf-8", "replace")))
            prints.append(int.from_bytes(sha.digest()[:8], "big", signed=True))
            shas.append(sha.hexdigest())
        yield C.record(_DIGEST, ids, points, prints, shas)


class QuotientFilter:
    """A counting quotient filter in its run form: sorted quotients, remainders and counts side by side."""

    def __init__(self, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.remainders, self.counts = quotients, remainders, counts

    @classmethod
    def of(cls, prints: np.ndarray) -> QuotientFilter:
        found, counts = np.unique(prints.view(np.uint64), return_counts=True)
        return cls((found >> np.uint64(REMAINDER_BITS)).astype(np.uint32), found.astype(np.uint32), counts.astype(np.int64))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Runs of the same quotient are merged by sorted remainder; equal remainders add their counts."""
        q, r, n = (np.concatenate([getattr(f, k) for f in filters]) for k in ("quotients", "remainders", "counts"))
        order = np.lexsort((r, q))
        q, r, n = q[order], r[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (r[1:] != r[:-1])]))
        return cls(q[first], r[first], np.add.reduceat(n, first))

    def prints(self) -> np.ndarray:
        return ((self.quotients.astype(np.uint64) << np.uint64(REMAINDER_BITS)) | self.remainders.astype(np.uint64)).view(np.int64)

    def parts(self) -> Iterator[tuple[int, QuotientFilter]]:
        """By shuffle bucket, a range of quotients each."""
        route = self.quotients >> np.uint32(QUOTIENT_BITS - ROUTE_BITS)
        at = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]])) if len(route) else np.zeros(0, np.int64)
        for a, b in zip(at, [*at[1:], len(route)], strict=True):
            yield int(route[a]), QuotientFilter(self.quotients[a:b], self.remainders[a:b], self.counts[a:b])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter for each partition; its memory is 16 bytes for each distinct fingerprint of the partition."""
    own: list[QuotientFilter] = []
    for batch in batches:
        own.append(QuotientFilter.of(batch.column(0).to_numpy(zero_copy_only=False)))
        if len(own) >= 16:
            own = [QuotientFilter.merged(own)]
    if own:
        parts = list(QuotientFilter.merged(own).parts())
        yield C.record(_FILTER, [b for b, _ in parts], [f.quotients.tobytes() for _, f in parts], [f.remainders.tobytes() for _, f in parts], [f.counts.astype(np.uint32).tobytes() for _, f in parts])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets arrive sorted; one bucket's filters are held at a time."""
    bucket, held = None, []

    def repeated() -> pa.RecordBatch:
        whole = QuotientFilter.merged(held)
        many = whole.counts > 1
        return C.record(_REPEATED, whole.prints()[many], whole.counts[many])

    for batch in batches:
        for b, q, r, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if b != bucket and held:
                yield repeated()
                held = []
            bucket = b
            held.append(QuotientFilter(np.frombuffer(q, np.uint32), np.frombuffer(r, np.uint32), np.frombuffer(n, np.uint32).astype(np.int64)))
            if len(held) >= 256:
                held = [QuotientFilter.merged(held)]
    if held:
        yield repeated()


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_points (code points of the original), fp (fingerprint), sha (of the normalised text)."""
    return C.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), _digests, "doc_id long, n_points long, fp long, sha string")


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """(fp, n) for every fingerprint that more than one row has."""
    filters = C.map_arrow(prints.select("fp"), _build, "bucket int, quotients binary, remainders binary, counts binary")
    return C.map_arrow(filters.repartition("bucket").sortWithinPartitions("bucket"), _merge, "fp long, n long")


def copy_groups(docs: DataFrame) -> DataFrame:
    """One row for each group of two or more equal texts: sha, keep_id, group_size, keep_rows (rows that have keep_id)."""
    repeated = C.stored(repeated_fingerprints(digests(docs)))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("bytes"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))
    text = text.withColumn("fp", F.conv(F.substring(F.sha2("bytes", 256), 1, 16), 16, -10).cast("long"))
    candidates = text.join(C.hinted(repeated), "fp", "left_semi")
    one = F.struct((-F.col("points")).alias("points"), F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("doc_id"))
    per = candidates.groupBy("bytes", one.alias("one")).agg(F.count(F.lit(1)).alias("rows"))
    groups = per.groupBy("bytes").agg(F.min(F.struct("one", "rows")).alias("best"), F.sum("rows").alias("group_size"))
    keep = F.nullif(F.col("best.one.doc_id"), F.lit(2**63 - 1))
    return C.stored(groups.filter("group_size > 1").select(F.sha2("bytes", 256).alias("sha"), keep.alias("keep_id"), "group_size", F.col("best.rows").alias("keep_rows")))


def find_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = C.hinted(copy_groups(docs))
    rows = digests(docs).join(groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(keep.eqNullSafe(F.col("doc_id")), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without all but one of equal texts, all columns kept; of rows that repeat the kept doc_id one stays."""
    sha, keep, rows = C.fresh(docs, "copy_sha", "copy_keep", "copy_rows")
    groups = C.hinted(copy_groups(docs).select(F.col("sha").alias(sha), F.col("keep_id").alias(keep), F.col("keep_rows").alias(rows)))
    marked = docs.withColumn(sha, F.sha2(normalised(docs["text"]), 256)).join(groups, sha, "left")
    kept = marked.filter(F.col(rows).isNull() | F.col(keep).eqNullSafe(F.col("doc_id").cast("long")))
    once = kept.filter(F.coalesce(rows, F.lit(1)) == 1)
    again = kept.filter(F.coalesce(rows, F.lit(1)) > 1).dropDuplicates([sha])
    return once.union(again).select(*[F.col(f"`{c}`") for c in docs.columns])
