"""Katz back-off language model over words, counted and evaluated in partitioned tables.

The training fold's words and word pairs are counted over all documents.  Counts up to KEPT are
discounted by Good-Turing; what is taken from a context's followers goes to the words not seen after
it, in proportion to the discounted word model, with a weight that normalises
each context exactly over the vocabulary and one class of unknown words:

    P(w | h) = d(c(h, w)) c(h, w) / (c(h) + 1)          if c(h, w) > 0
             = alpha(h) P(w)                            otherwise
    alpha(h) = (1 - sum of P(w | h) seen) / (1 - sum of P(w) seen after h)

The 1 beside c(h) keeps a share for unseen words where no count of a context is discounted.  The word
model is discounted the same way, and what is taken goes to the unknown class.

Word pairs travel once: each batch of documents sends its pairs, with the rows
they occur in, to buckets of contexts; there they are counted and each row's
logarithms are summed, as a linear form in the logarithms of the discounts,
which only the counts of counts of the whole table fix.  Contexts so frequent
that they would fill a bucket are dealt out by their followers.

The most frequent words (CACHED at most, 20 bytes each) are sent to every task with their P(w).  What
buckets ask of other words is joined to the stored counts: (row, word) of unseen pairs, and (context,
word) of the seen followers that alpha(h) needs.  The list is a cache only; scores do not depend
on it.  A word is the context of the word behind it, so its bucket counts it.  With `listed`, words
outside a list of so many share one class with the unknown words instead.

Defined results: a null text is empty, so its one token is the end; rows without an id
are in fold 0 and, like repeated rows, are scored each on its own; without training rows all
words are unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KEPT = 5
#: Most words in the list that every task gets.
CACHED = 200_000
#: Tokens that a task gathers into one batch, and that a bucket of contexts holds, about.
BATCH, BUCKET = 1_500_000, 2_000_000
END = np.int64(1)  # never a word's hash in practice: hashes keep their upper bits
_CODEC = pa.Codec("zstd", compression_level=1)


def _fold(doc_id: int | None) -> bool:
    """Whether a row is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def tokens(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of each text's words, and the end."""
    for chunk in C.chunks(texts):
        words, sizes = C.word_hashes(chunk)
        ends = np.cumsum(sizes)
        whole = np.insert(words.view(np.int64), ends, END)
        yield from np.split(whole, (ends + np.arange(1, len(ends) + 1))[:-1])


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """d(1..KEPT); where Good-Turing's are no proper discounts, half a count is taken from each."""
    n = [0] + [counts_of_counts.get(r, 0) for r in range(1, KEPT + 2)]
    plain = np.array([(r - 0.5) / r for r in range(1, KEPT + 1)])
    if not all(n[1:]):
        return plain
    common = (KEPT + 1) * n[KEPT + 1] / n[1]
    d = np.array([((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, KEPT + 1)]) if common != 1 else plain
    return d if ((d > 0) & (d < 1)).all() else plain


@dataclass
class Words:
    """The listed words, numbered from 1 by sorted hash; number 0 is the start of a text, higher ones are other words."""

    keys: np.ndarray
    counts: np.ndarray  # of the start (the documents), then of the listed words
    log_probability: np.ndarray  # of the start (never asked), the listed words, and an unknown word
    apart: bool  # whether unlisted words can be known ones, whose probability is joined later
    discount: np.ndarray  # of counts 1 to KEPT
    total: int
    distinct: int
    ends: int
    hot: np.ndarray  # numbers of the words whose contexts are dealt out by follower
    buckets: int

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words, and the hashes of the unlisted ones in order of their numbers."""
        at = np.searchsorted(self.keys, hashes)
        listed = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        others, place = np.unique(hashes[~listed], return_inverse=True)
        out = at + 1
        out[~listed] = len(self.keys) + 1 + place
        return out, others

    def log(self, numbers: np.ndarray) -> np.ndarray:
        return self.log_probability[np.minimum(numbers, len(self.keys) + 1)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): counts of the training fold's tokens, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, size = pa.schema([("w", pa.int64()), ("n", pa.int64())]), [], 0

        def counted() -> pa.RecordBatch:
            return C.record(schema, *np.unique(np.concatenate(held), return_counts=True))

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), tokens(C.raw(batch)), strict=True):
                if not _fold(doc):
                    held.append(found)
                    size += len(found)
            if size >= 2 * BATCH:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return C.map_arrow(rows, run, "w long, n long").groupBy("w").agg(F.sum("n").alias("c"))


def word_level(counts: DataFrame, buckets: int, listed: int, shared: bool) -> Words:
    """The list of the most frequent words; shared: the others have one probability with the unknown words."""
    grid = sorted({1, 2, 3, *(int(2 ** (i / 2)) for i in range(4, 96))})
    few = {r["c"]: r["n"] for r in counts.filter(F.col("c") <= KEPT + 1).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct"), F.coalesce(F.max(F.when(F.col("w") == int(END), F.col("c"))), F.lit(0)).alias("ends"), *[F.count(F.when(F.col("c") >= t, 1)).alias(f"t{t}") for t in grid]).first()
    least = next(t for t in grid if sums[f"t{t}"] <= listed)
    found = counts.filter((F.col("c") >= least) | (F.col("w") == int(END))).toArrow()
    keys, c = (found.column(x).to_numpy() for x in ("w", "c"))
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    total = int(sums["total"])
    d = np.concatenate([[1.0], discounts(few), [1.0]])
    p = d[np.minimum(c, KEPT + 1)] * c / (total + 1)
    apart = not shared and len(keys) < sums["distinct"]
    if apart:  # all that is taken from known words
        rest = (1 + sum((1 - d[r]) * r * few.get(r, 0) for r in range(1, KEPT + 1))) / (total + 1)
    else:
        rest = max(1e-300, 1 - p.sum()) / (sums["distinct"] - len(keys) + 1)
    hot = np.concatenate([[0], np.flatnonzero(c > total / (8 * buckets)) + 1])
    return Words(keys, np.concatenate([[sums["ends"]], c]), np.log10(np.concatenate([[1.0], p, [rest]])), apart, d[1:-1], total, sums["distinct"], sums["ends"], hot, buckets)


_SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
SENT = "bucket int, part long, kind int, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed, each with its type and length ahead."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        body = np.ascontiguousarray(a).tobytes()
        small = _CODEC.compress(body, asbytes=True) if body else b""
        parts += [a.dtype.str.encode().ljust(4), len(body).to_bytes(8, "little"), len(small).to_bytes(8, "little"), small]
    return b"".join(parts)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(blob[0]):
        kind, size, small = blob[at : at + 4].decode().strip(), int.from_bytes(blob[at + 4 : at + 12], "little"), int.from_bytes(blob[at + 12 : at + 20], "little")
        body = _CODEC.decompress(blob[at + 20 : at + 20 + small], decompressed_size=size, asbytes=True) if size else b""
        out.append(np.frombuffer(body, kind))
        at += 20 + small
    return out


def _sends(shared):
    """Batches of rows to blobs: kind 1 the rows themselves, kind 0 their pairs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, held, ids, size = shared.value, TaskContext.get().partitionId() << 20, [], [], 0

        def batch_of() -> Iterator[pa.RecordBatch]:
            length = np.array([len(t) for t in held])
            row = np.repeat(np.arange(len(held), dtype=np.uint32), length)
            hashes = np.concatenate(held)
            w, others = words.numbers(hashes)
            first = np.cumsum(length) - length
            h, of_h = np.empty_like(w), np.empty_like(hashes)
            h[1:], h[first], of_h[1:], of_h[first] = w[:-1], 0, hashes[:-1], 0
            out = np.array([_fold(i) for i in ids])
            stats = _pack(np.array([-1 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids]), out, length.astype(np.int64))
            yield C.record(_SENT, [int(part % words.buckets)], [part], [1], [stats])
            of_h, hashes, hot = of_h.view(np.uint64), hashes.view(np.uint64), np.isin(h, words.hot)
            with np.errstate(over="ignore"):
                bucket = (C.spread(of_h + np.where(hot, C.spread(hashes), np.uint64(0))) % np.uint64(words.buckets)).astype(np.uint32)
            h, w = h.astype(np.uint32), w.astype(np.uint32)
            order = np.lexsort((row, w, h, bucket))
            h, w, row, bucket = h[order], w[order], row[order], bucket[order]
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (w[1:] == w[:-1]) & (row[1:] == row[:-1])]) if len(h) else np.zeros(0, bool)
            at = np.flatnonzero(~same)
            n = np.diff(np.append(at, len(h))).astype(np.uint32)
            h, w, row, bucket = h[at], w[at], row[at], bucket[at]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else np.zeros(0, np.int64)
            blobs = []
            for a, b in zip(edge, [*edge[1:], len(h)], strict=True):
                hs, ws, rs = h[a:b], w[a:b], row[a:b]
                own = np.unique(np.concatenate([hs[hs > len(words.keys)], ws[ws > len(words.keys)]]))  # unlisted words are numbered anew in each blob
                hs, ws = (np.where(x > len(words.keys), np.searchsorted(own, x) + len(words.keys) + 1, x).astype(np.uint32) for x in (hs, ws))
                fresh = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])])
                ph, pw = hs[fresh], ws[fresh]
                blobs.append(_pack(np.diff(ph, prepend=np.uint32(0)).astype(np.uint32), pw, np.diff(np.append(np.flatnonzero(fresh), b - a)).astype(np.uint32), rs.astype(np.uint16) if len(held) < 65536 else rs, n[a:b] if n[a:b].max() > 255 else n[a:b].astype(np.uint8), np.packbits(out), others[own - np.uint32(len(words.keys) + 1)]))
            if blobs:
                yield C.record(_SENT, bucket[edge].astype(np.int32), np.full(len(blobs), part), np.zeros(len(blobs), np.int32), blobs)

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), tokens(C.raw(batch)), strict=True):
                held.append(found)
                ids.append(doc)
                size += len(held[-1])
                if size >= BATCH or len(held) >= 65_000:
                    yield from batch_of()
                    held, ids, size, part = [], [], 0, part + 1
        if held:
            yield from batch_of()

    return run


_MET = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("row", pa.int32()), ("n", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("blob", pa.binary())])
MET = "kind int, key long, row int, n long, x double, y double, blob binary"


def _counts(shared):
    """Each bucket's pairs counted.  kind 0: sums for a batch's rows (blob); 1: rows (blob); 2: (count, pairs with it); 3: a context's sums; 4: unseen pairs of a row and context.

    Of unlisted words: 5 (row, word, times) of unseen pairs; 6 (context, word) of seen pairs.
    """

    def emitted(kind: int, size: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *(pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in list(_MET)[1:])], schema=_MET)

    def counted(words: Words, parts: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        parsed, last = [_unpack(b) for b in blobs], len(words.keys)
        others = np.unique(np.concatenate([p[6] for p in parsed]))
        for i, (h, w, size, row, n, out, own) in enumerate(parsed):
            place = np.concatenate([np.arange(last + 1), last + 1 + np.searchsorted(others, own)]).astype(np.uint32)
            h, row = np.repeat(place[np.cumsum(h, dtype=np.uint32)], size), row.astype(np.int64)
            for c, a in zip(cols, (h, np.repeat(place[w], size), np.full(len(row), i, np.int32), row.astype(np.int32), n.astype(np.int64), np.unpackbits(out)[row].astype(bool)), strict=True):
                c.append(a)
        del parsed
        h, w, of, row, n, out = (np.concatenate(c) for c in cols)
        pair, back = np.unique((h.astype(np.uint64) << np.uint64(32)) | w, return_inverse=True)
        c = np.bincount(back, np.where(out, 0, n), len(pair)).astype(np.int64)
        ph, pw = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        seen = c > 0
        # a context's count: listed, or the sum of its pairs, which are all in this bucket
        of_context = np.concatenate([words.counts, np.bincount(ph, c, last + 1 + len(others))[last + 1 :].astype(np.int64)])
        small = np.bincount(c[seen & (c <= KEPT + 1)], minlength=KEPT + 2)[1:]
        yield emitted(2, KEPT + 1, key=np.arange(1, KEPT + 2), n=small)
        # sums of each batch's rows: logarithms of seen pairs and of the word level, base terms and known words of the contexts
        asked_later = (pw > last) & words.apart
        log = np.where(seen, np.log10(np.maximum(c, 1)) - np.log10(of_context[ph] + 1.0), np.where(asked_later, 0.0, words.log(pw)))
        word = np.log10(np.where(ph > 0, of_context[ph], 0) + 1.0)
        known = (ph > 0) & (of_context[ph] > 0)
        for i, part in enumerate(parts):
            mine = np.flatnonzero(of == i)
            rows, place = np.unique(row[mine], return_inverse=True)
            times, at = n[mine], back[mine]
            sums = [np.bincount(place, times * x[at], len(rows)) for x in (log, word)]
            by = [np.bincount(place, np.where(c[at] == r, times, 0), len(rows)).astype(np.uint32) for r in range(1, KEPT + 1)]
            yield emitted(0, 1, key=[part], blob=[_pack(rows.astype(np.int32), *sums, np.bincount(place, times * known[at], len(rows)).astype(np.uint32), *by)])
        named = np.concatenate([[0], words.keys, others])  # a context's hash; 0 is the start of a text
        rare = np.flatnonzero((asked_later & ~seen)[back])
        if len(rare):
            asked, place = np.unique((np.asarray(parts, np.int64)[of[rare]] << 20 | row[rare], w[rare]), axis=1, return_inverse=True)
            yield emitted(5, asked.shape[1], key=named[asked[1]], n=asked[0].astype(np.int64), x=np.bincount(place.ravel(), n[rare]).astype(float))
        # contexts that some row of this bucket met with an unseen follower, or that other buckets share
        miss = np.flatnonzero(~seen[back] & (of_context[h] > 0))  # after a word that training never saw, the word level stands alone
        if len(miss):
            asked, place = np.unique((np.asarray(parts, np.int64)[of[miss]] << 20 | row[miss], h[miss]), axis=1, return_inverse=True)
            yield emitted(4, asked.shape[1], key=named[asked[1]], n=asked[0].astype(np.int64), x=np.bincount(place.ravel(), n[miss]).astype(float))
        wanted = np.isin(ph, np.union1d(h[miss], words.hot)) & seen
        contexts, place = np.unique(ph[wanted], return_inverse=True)
        k, cw = len(contexts), c[wanted]
        if k:
            later = asked_later[wanted]
            low = np.bincount(place, np.where(later, 0.0, 10 ** words.log(pw[wanted])), k)
            yield emitted(6, int(later.sum()), key=named[pw[wanted][later]], n=named[ph[wanted][later]])
            packed = [np.bincount(place, np.where(cw == r, 1, 0), k).astype(np.uint32) for r in range(1, KEPT + 1)]
            high = np.bincount(place, np.where(cw > KEPT, cw, 0), k)
            blobs_ = [np.array([p[j] for p in packed], np.uint32).tobytes() for j in range(k)]
            yield emitted(3, k, key=named[contexts], x=low, y=high, blob=blobs_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bucket, parts, blobs = shared.value, None, [], []
        for batch in batches:
            for b, part, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == 1:
                    yield emitted(1, 1, key=[part], blob=[blob])
                    continue
                if b != bucket and blobs:
                    yield from counted(words, parts, blobs)
                    parts, blobs = [], []
                bucket = b
                parts.append(part)
                blobs.append(blob)
        if blobs:
            yield from counted(words, parts, blobs)

    return run


_ROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("seen_score", pa.float64())])


def _rows(log_discount: np.ndarray, total: int, distinct: int, ends: int):
    """A batch's partial sums and its rows, together: one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stats, sums = None, None, []

        def whole() -> pa.RecordBatch:
            doc, null, out, length = _unpack(stats)
            score, known = np.zeros(len(doc)), np.full(len(doc), int(ends > 0), np.int64)
            base = np.full(len(doc), np.log10(ends + 1.0)) - length * np.log10(total + distinct + 1.0)
            for blob in sums:
                rows, logs, words, n, *by = _unpack(blob)
                score[rows] += logs + sum(n_ * d for n_, d in zip(by, log_discount, strict=True))
                base[rows] += words
                known[rows] += n
            return C.record(_ROW, (part << 20) | np.arange(len(doc)), pa.array(doc, mask=null), out, length, known, base, score)

        for batch in batches:
            for key, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != part and stats:
                    yield whole()
                    stats, sums = None, []
                part = key
                if kind == 1:
                    stats = blob
                else:
                    sums.append(blob)
        if stats:
            yield whole()

    return run


def _probabilities(counts: DataFrame, words: Words) -> DataFrame:
    """(key, p): P(w) of the training fold's words."""
    c, d = F.col("c"), F.lit(1.0)
    for r, x in enumerate(words.discount, 1):
        d = F.when(c == r, F.lit(float(x))).otherwise(d)
    return counts.select(F.col("w").alias("key"), (d * c / F.lit(words.total + 1.0)).alias("p"))


def score_documents(docs: DataFrame, listed: int | None = None, cached: int = CACHED) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = C.stored(word_counts(docs))
    tokens_ = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    buckets = max(16, -(-int(tokens_) * 7 // (6 * BUCKET)))  # their number grows with the tokens, not their size
    words = word_level(counts, buckets, cached if listed is None else listed, listed is not None)
    shared, total = spark.sparkContext.broadcast(words), words.total
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = C.map_arrow(rows, _sends(shared), SENT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    met = C.stored(C.map_arrow(sent, _counts(shared), MET))
    of_counts = {r["key"]: int(r["n"]) for r in met.filter("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    d = discounts(of_counts)
    parts = met.filter("kind <= 1").select("key", "kind", "blob").repartition("key").sortWithinPartitions("key", F.desc("kind"))
    done = C.map_arrow(parts, _rows(np.log10(d), total, words.distinct, words.ends), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, seen_score double")
    # alpha(h) from the sums of its buckets
    low_counts = [F.conv(F.concat(*[F.hex(F.substring("blob", 4 * i + 1 + b, 1)) for b in (3, 2, 1, 0)]), 16, 10).cast("long").alias(f"m{i}") for i in range(KEPT)]
    sums = met.filter("kind = 3").select("key", "x", "y", *low_counts)
    sums = sums.groupBy("key").agg(F.sum("x").alias("low"), F.sum("y").alias("high"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(KEPT)])
    if words.apart:
        p_of = _probabilities(counts, words)
        lower = met.filter("kind = 6").select("key", F.col("n").alias("h")).join(p_of, "key").groupBy(F.col("h").alias("key")).agg(F.sum("p").alias("__p"))
        sums = sums.join(lower, "key", "left").withColumn("low", F.col("low") + F.coalesce("__p", F.lit(0.0)))
    mass = sum((F.col(f"m{i}") * ((i + 1) * float(d[i])) for i in range(KEPT)), F.col("high"))
    context = sum((F.col(f"m{i}") * (i + 1) for i in range(KEPT)), F.col("high"))  # all of the context's pairs: c(h)
    alpha = sums.select("key", F.log10((1 - mass / (context + 1)) / F.greatest(1 - F.col("low"), F.lit(1e-12))).alias("alpha"))
    unseen = met.filter("kind = 4").select("key", F.col("n").alias("row"), F.col("x").alias("times"))
    back = unseen.join(C.hinted(alpha), "key", "left").select("row", (F.col("times") * F.coalesce("alpha", F.lit(0.0))).alias("unseen"))
    if words.apart:
        rare = met.filter("kind = 5").select("key", F.col("n").alias("row"), F.col("x").alias("times")).join(p_of, "key", "left")
        back = back.unionByName(rare.select("row", (F.col("times") * F.coalesce(F.log10("p"), F.lit(float(words.log_probability[-1])))).alias("unseen")))
    back = back.groupBy("row").agg(F.sum("unseen").alias("unseen_score"))
    out = done.join(back, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("seen_score") + F.coalesce("unseen_score", F.lit(0.0))).alias("score"))
