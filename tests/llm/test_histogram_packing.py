"""Best-fit packing against packing document by document, and ids against the tokenizers library."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import histogram_packing as H

from .test_edges import NAMES, SCHEMA
from .test_operators import text


def one_by_one(lengths, room):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(room - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(40))
def test_steps_are_best_fit(seed):
    rng = random.Random(seed)
    room = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, room) for _ in range(rng.choice([0, 1, 30, 400]))] + [rng.randint(1, 3)] * rng.choice([0, 500])
    counts = collections.Counter(lengths)
    used, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for length, first, pieces, sequence, each, offset in H.best_fit(dict(counts), room):
        for k in range(pieces):
            used[sequence + k // each].append((offset + k % each * length, length))
            ranks[length].append(first + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    left = []
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
        left.append(room - at)
    assert sorted(left) == one_by_one(lengths, room)


def test_the_plan_does_not_grow_with_the_pieces():
    counts = {n: 1 + n * 37 % 101 for n in range(1, 1025)}
    few, many = H.best_fit(counts), H.best_fit({n: c * 10**9 + n for n, c in counts.items()})
    assert len(few) < 8_192 and len(many) < 16_384
    assert sum(s[2] for s in many) == sum(c * 10**9 + n for n, c in counts.items())


TEXTS = ["", None, "one", "a  b", "tab\tand\n\nlines \n x  ", "it's we'll I'D", "x" * 5000, "naïve café déjà ÀÉ", "русский текст", "日本語 テキスト", "🙂🙂 ok", "a b   c", "<|endoftext|> here <|endoftext|>", "1234567890 12ab34", "###$$$%%% !?.", " lead", "trail ", "\r\n\r\n", "\x1c\x85  x", "ŉĸſ ǅ ª²½"]


def test_fast_ids_are_the_librarys():
    fast, library = H.encoder(H.default_tokenizer())
    assert fast is not library
    rng = random.Random(3)
    letters = "ab CDé'st \n\t.,1²ßŁ-"
    for t in [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]:
        assert fast(t) == library(t), t


def test_pieces_and_places(spark):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(500 + i, text(rng, rng.choice([1, 3, 40, 300, 900]))) for i in range(80)]
    rows += [(700, text(rng, 100_000)), (None, "no id"), (None, None)] + [(9, "again")] * 3 + [(i, "hot") for i in range(1000, 1200)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(5).select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])
    got = H.pack(df, ids=True).collect()
    library = H.encoder(H.default_tokenizer())[1]
    want = collections.Counter()
    for i, t in rows:
        ids = [*library(t or ""), 2]
        cut = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(cut, len(ids), 1024)]):
            part = ids[a : cut + 1024 * k]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) == len(one_by_one([r["length"] for r in got], 1024))
    whole = {r["sequence_id"]: r["ids"] for r in H.sequences(H.pack(df, ids=True)).collect()}
    assert sum(map(len, whole.values())) == sum(r["length"] for r in got) and max(map(len, whole.values())) <= 1024


def test_no_rows(spark):
    assert H.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_files_go_through_the_library():
    import public_tokenizers

    fast, library = H.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert fast is library and fast("some words")
