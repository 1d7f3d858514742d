"""Languages with few words, and languages without common words."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest

from corvane.llm import divergence

from .test_operators import WORDS, by_id, text


def judged(spark, rows):
    return by_id(divergence.judge(spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")))


@pytest.mark.parametrize("docs", [12, 60, 300])
def test_a_rare_language_is_judged_by_itself(spark, docs):
    """60 documents have 18,000 words, 300 have 90,000; clean ones pass whether words occur LEAST_COUNT times or not."""
    rng, other = random.Random(7), [w.replace("n", "x").replace("r", "v") + "q" for w in WORDS]
    ruling = [("en", text(rng, 300)) for _ in range(200)]
    rare = [("xx", " ".join(rng.choice(other[:12] if rng.random() < 0.6 else other) for _ in range(300))) for _ in range(docs)]
    got = judged(spark, ruling + rare)
    assert all(got[200 + i]["kept"] for i in range(docs))


def test_characters_are_judged_without_common_words(spark):
    """A word is a sentence here, so no word is common; a text of symbols still is far from the language."""
    rng = random.Random(8)
    sentence = lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(12))
    rows = [("zh", " ".join(sentence() for _ in range(50))) for _ in range(450)]
    rows.append(("zh", " ".join(f"#{rng.randrange(10**6)}%%||" for _ in range(60))))
    got = judged(spark, rows)
    assert got[450]["char_distance"] > divergence.CHARS_AT_MOST and not got[450]["kept"] and not got[450]["base_failed"]
    assert all(got[i]["kept"] and got[i]["word_distance"] is None for i in range(450))


def brute(rows):
    """Distances and verdicts by plain counting."""
    classes = [(str.islower, "abcdefghijklmnopqrstuvwxyz"), (str.isupper, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    kinds = [classes[0][1], classes[1][1], "0123456789", " \t", "\n\r\x0b\x0c", ".,;:!?", "#*$%&|<>"]
    kind = lambda c: next((i for i, k in enumerate(kinds) if c in k), 7 if ord(c) < 128 else 8)
    lower = str.maketrans(kinds[1], kinds[0])
    words = [re.findall(r"[^\x20\x09-\x0D.,;:!?\"'()\[\]]+", (t or "").translate(lower)) for _, t in rows]
    chars = [collections.Counter(map(kind, t or "")) for _, t in rows]
    of, cls = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for (lang, _), w, c in zip(rows, words, chars, strict=True):
        for g in {lang, None}:
            of[g].update(w)
            cls[g].update(c)

    def distance(p, q):
        a, b = sum(p.values()), sum(q.values())
        part = 0.0
        for k in {*p, *q}:
            x, y = p[k] / a, q[k] / b
            part += sum(v * math.log2(2 * v / (x + y)) for v in (x, y) if v)
        return math.sqrt(max(0, part / 2))

    out = []
    for (lang, t), w, c in zip(rows, words, chars, strict=True):
        total = sum(of[lang].values())
        common = {x for x, n in of[lang].items() if n >= divergence.LEAST_COUNT and n >= divergence.COMMON_SHARE * total}
        binned = lambda counts: collections.Counter({k: sum(n for x, n in counts.items() if (x if x in common else "") == k) for k in {*common, ""}})  # noqa: B023, E731
        near = distance(c, cls[lang]) if sum(c.values()) >= divergence.LEAST_CHARS else None
        far = distance(binned(collections.Counter(w)), binned(of[lang])) if common and len(w) >= divergence.LEAST_WORDS else None
        out.append((near, far, (near or 0) <= divergence.CHARS_AT_MOST and (far or 0) <= divergence.WORDS_AT_MOST))
    return out


def test_distances_and_verdicts_are_those_of_plain_counting(spark):
    rng, rows = random.Random(15), []
    for i in range(120):
        lang = ["en", "fr", None, "*"][i % 4]
        t = text(rng, rng.choice([5, 30, 90, 400]))
        if i % 9 == 0:
            t = " ".join(rng.choice(WORDS[:5]) for _ in range(80))
        if i % 10 == 3:
            t = "".join(f"#{rng.randrange(10**5)}%%|é " for _ in range(50))
        rows.append((lang, t.replace(" ", ", (", 3).title() if i % 5 == 0 else t))
    rows += [(None, None), ("en", ""), ("xx", "one word")]
    rows = [(None if lang == "*" else lang, t) for lang, t in rows]
    got = judged(spark, rows)
    for i, (near, far, fine) in enumerate(brute(rows)):
        r = got[i]
        for have, want in ((r["char_distance"], near), (r["word_distance"], far)):
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9)
        assert r["kept"] == (fine and not r["base_failed"])
    assert 10 < sum(r["kept"] for r in got.values()) < len(rows) - 5


def test_a_very_long_text_and_a_repeated_id(spark):
    rng = random.Random(2)
    long = text(rng, 100_000)
    got = divergence.judge(spark.createDataFrame([(1, "en", long), (1, "en", long), (2, "en", "x " * 100_000)], "doc_id long, lang string, text string")).collect()
    assert [r["n_words"] for r in got] == [100_000] * 3 and got[0] == got[1] and got[2]["n_repeat_words"] == 100_000
