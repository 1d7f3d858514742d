"""Quality rules by distribution divergence.

Each document's histogram of character classes and of its language's common words is
compared with the language's own histogram over the whole table, by
Jensen-Shannon distance (base 2, 0 to 1).  Texts too short for a histogram to
mean anything are not judged by it.

Words are counted over all documents (batches of a task are summed before they are shuffled).  A language's
common words are those that make up at least COMMON_SHARE of its
words (so at most 1 / COMMON_SHARE of them) and occur LEAST_COUNT times: of fewer
occurrences a share says little.  All other words are one bin, so a language
with few words has a coarse histogram of its own, which gets finer as words come, and one without
any common word gives no verdict on words.  Characters are always judged.  Only a null language uses the
reference of all documents together.

The words of the histograms are lower-cased and part at white space and punctuation; those of the base counts are
parted by white space alone, as they stand.

Defined results: a null text has no words and fails the base; repeated rows get
equal verdicts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

COMMON_SHARE = 0.004
LEAST_COUNT = 80
#: Least characters, and least words, for a verdict on either histogram.
LEAST_CHARS, LEAST_WORDS = 100, 40
#: Greatest distances of kept documents.
CHARS_AT_MOST, WORDS_AT_MOST = 0.24, 0.37
_SYMBOLS, _PUNCTUATION = b"#*$%&|<>", b".,;:!?\"'()[]"
_POOLED = "*"
# character classes by leading byte: lower, upper, digit, blank, line end, stop, symbol, other punctuation, other scripts
_CLASSES = 9
_CLASS = np.full(256, -1, np.int64)
_CLASS[0:128] = 7
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13, 11, 12]] = 0, 1, 2, 3, 4
_CLASS[[*b".,;:!?"]], _CLASS[[*_SYMBOLS]], _CLASS[192:256] = 5, 6, 8
_COUNTED = _CLASS >= 0  # leading bytes, one for each character
#: Words that a task counts at a time.
BATCH = 2_000_000
_COUNT = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("word", pa.int64()), ("n", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: np.ndarray, windows: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of width words which the text holds twice or more, from the hashes of its windows."""
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    again = order[1:] == order[:-1]
    if not again.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(np.isin(windows, order[1:][again]))
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_rows(texts: list[bytes], width: int = 5) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """For each text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and its character classes."""
    for chunk in C.chunks(texts):
        words, sizes = C.word_hashes(chunk, lower=False)
        windows = np.zeros(max(0, len(words) - width + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                windows = C.spread(windows * _ODD + words[i : len(words) - width + 1 + i])
        at = 0
        for text, n in zip(chunk, sizes.tolist(), strict=True):
            found = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            chars = int(found[_COUNTED].sum() - found[list(C.SPACES.encode())].sum())
            lines = [x for x in text.split(b"\n") if x.strip(C.SPACES.encode())] if b"\n" in text else []
            yield n, chars, int(found[list(_SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words[at : at + n], windows[at : at + max(0, n - width + 1)], width), np.bincount(_CLASS[_COUNTED], found[_COUNTED], _CLASSES)
            at += n


def plain_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of each text's lower-cased words, parted at punctuation too."""
    for chunk in C.chunks(texts):
        words, sizes = C.word_hashes(chunk, apart=_PUNCTUATION)
        yield from np.split(words.view(np.int64), np.cumsum(sizes)[:-1])


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    p, q = p / max(p.sum(), 1e-12), q / max(q.sum(), 1e-12)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, part.sum() / 2)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, 0, class, n), (lang, 1, word, n) and (lang, 2, 0, words) of all texts, summed over some of them at a time."""
    classes: dict[str, np.ndarray] = {}
    words: dict[str, list[np.ndarray]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for g, row in classes.items():
            yield C.record(_COUNT, [g] * _CLASSES, np.zeros(_CLASSES, np.int32), np.arange(_CLASSES), row)
            found, n = np.unique(np.concatenate(words[g]), return_counts=True)
            yield C.record(_COUNT, pa.array([g] * len(found), pa.string()), np.ones(len(found), np.int32), found, n)
            yield C.record(_COUNT, [g], [2], [0], [int(n.sum())])

    for batch in batches:
        texts = C.raw(batch)
        for lang, text, found in zip(batch.column(0).to_pylist(), texts, plain_words(texts), strict=True):
            one = np.bincount(_CLASS[_COUNTED], np.bincount(np.frombuffer(text, np.uint8), minlength=256)[_COUNTED], _CLASSES).astype(np.int64)
            for g in (lang, _POOLED) if lang is not None and lang != _POOLED else (_POOLED,):
                classes[g] = classes.get(g, 0) + one
                words.setdefault(g, []).append(found)
                held += len(found)
        if held > BATCH:
            yield from rows()
            classes, words, held = {}, {}, 0
    yield from rows()


class Reference:
    """Class counts of each language, and common word counts where it has any."""

    def __init__(self, rows: list):
        self.classes, self.total, found = {}, {}, {}
        for r in rows:
            if r["kind"] == 0:
                self.classes.setdefault(r["lang"], np.zeros(_CLASSES))[r["word"]] = r["n"]
            elif r["kind"] == 2:
                self.total[r["lang"]] = r["n"]
            else:
                found.setdefault(r["lang"], []).append((r["word"], r["n"]))
        self.words, self.hist = {}, {}
        for g, pairs in found.items():
            words, n = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
            self.words[g], self.hist[g] = words, np.append(n, self.total[g] - n.sum()).astype(float)

    def distances(self, lang: str | None, chars: np.ndarray, words: np.ndarray) -> tuple[float | None, float | None]:
        g = _POOLED if lang is None else lang
        near = js_distance(chars, self.classes[g]) if chars.sum() >= LEAST_CHARS else None
        if len(words) < LEAST_WORDS or g not in self.hist:
            return near, None
        common = self.words[g]
        place = np.minimum(np.searchsorted(common, words), len(common) - 1)
        own = np.bincount(np.where(common[place] == words, place, len(common)), minlength=len(common) + 1)
        return near, js_distance(own, self.hist[g])


def reference(docs: DataFrame) -> Reference:
    """Language references over all of docs; of words only the common ones come to the driver, 1 / COMMON_SHARE of each language at most."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    counts = C.map_arrow(rows, _counts, "lang string, kind int, word long, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    counts = C.stored(counts)
    total = counts.filter("kind = 2").select("lang", F.col("n").alias("total"))
    common = counts.filter(F.col("n") >= LEAST_COUNT).join(F.broadcast(total), "lang").filter((F.col("kind") != 1) | (F.col("n") >= COMMON_SHARE * F.col("total")))
    return Reference(common.select("lang", "kind", "word", "n").collect() + counts.filter((F.col("kind") != 1) & (F.col("n") < LEAST_COUNT)).collect())


def judge(docs: DataFrame, chars_at_most: float = CHARS_AT_MOST, words_at_most: float = WORDS_AT_MOST) -> DataFrame:
    """One row per document: base counts, base_failed, the two distances (null where too short) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(reference(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = shared.value
        for batch in batches:
            out, texts = [], C.raw(batch)
            for lang, (n, chars, symbols, lines, repeats, classes), words in zip(batch.column(1).to_pylist(), base_rows(texts), plain_words(texts), strict=True):
                failed = n < 10 or 100 * repeats > 20 * n
                near, common = ref.distances(lang, classes, words)
                kept = not failed and (near is None or near <= chars_at_most) and (common is None or common <= words_at_most)
                out.append((n, chars, symbols, lines, repeats, failed, kept, near, common))
            yield C.record(_RESULT, batch.column(0), *zip(*out, strict=True)) if out else C.record(_RESULT, *([] for _ in _RESULT))

    return C.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), run, RESULT)
