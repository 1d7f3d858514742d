"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import collections
import hashlib
import hmac
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import common, divergence, exact_dedup, katz, linear, mixing, ngram_join, packing, pseudonyms, quality, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu".split() for b in "n r s t".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, **more):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "a"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    # names that operators use inside, as extra columns
    return df.select("*", F.lit(1).alias("score"), F.lit("x").alias("sha"), F.lit(2).alias("n_tokens"), F.lit(3).alias("bucket"))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    out = [None, "", " \n\t ", "one", "one two", "ONE  two", "One\ttwo\n", text(rng, 3000)]
    for _ in range(12):  # families of near copies around a base, some without it
        base = text(rng, rng.choice([12, 40, 150])).split()
        for k in range(rng.choice([2, 7, 14])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w) + (" " if k % 3 == 0 else ""))
    passage = text(rng, 25)
    out += [f"{text(rng, 10)} {passage} {text(rng, 10)}" for _ in range(20)]
    out += [text(rng, rng.choice([5, 60, 200])) for _ in range(30)]
    return out + out[8:12] + [out[7]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return table(spark, corpus).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, []).limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# exact dedup


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    parts = [rng.integers(-50, 50, 200) << 30 for _ in range(5)]
    got = exact_dedup.QuotientFilter.merged([exact_dedup.QuotientFilter.of(p) for p in parts])
    want = collections.Counter(np.concatenate(parts).tolist())
    assert dict(zip(got.prints().tolist(), got.counts.tolist(), strict=True)) == want
    assert all((f.quotients >> np.uint32(22) == b).all() for b, f in got.parts())


def test_exact_dedup(docs, corpus):
    groups = collections.defaultdict(list)
    for i, t in enumerate(corpus):
        groups[re.sub(r"[ \t-\r]", "", t or "")].append(i)
    got = by_id(exact_dedup.find_copies(docs))
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(corpus[i] or ""), i))
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(by_id(kept)) == sorted(i for i, r in got.items() if r["kept"])


def test_exact_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (None, "ab"), (3, "c")], "doc_id long, text string")
    assert sorted(r["group_size"] for r in exact_dedup.find_copies(df).collect()) == [1, 4, 4, 4, 4]
    assert sorted(tuple(r) for r in exact_dedup.deduplicate(df).collect()) == [(1, "a b"), (3, "c")]


# n-gram join


def shingle_sets(corpus, width):
    out = {}
    for i, t in enumerate(corpus):
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def classes(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(docs, corpus, width, percent):
    sets = shingle_sets(corpus, width)
    want, got = classes(sets, percent), by_id(ngram_join.link_documents(docs, width, percent))
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_keep_one(docs, corpus):
    want = classes(shingle_sets(corpus, 5), 80)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(by_id(kept)) == sorted(i for i, c in want.items() if i == c)


def test_signatures_meet_whenever_sets_link():
    rng, bands = np.random.default_rng(3), ngram_join.Bands(85)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = a[rng.random(n) > rng.choice([0.0, 0.05, 0.15])]
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, rng.integers(0, max(1, n // 12) + 1), dtype=np.uint64)]))
            if len(b) and ngram_join.linked(a, [b], 85)[0] and not np.array_equal(a, b):
                found, of = bands.signatures([a, b])
                assert np.intersect1d(found[of == 0], found[of == 1]).size


def test_linked_counts_like_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(6)]
        for percent in (50, 85):
            want = [100 * len(np.intersect1d(sets[0], x)) >= percent * len(np.union1d(sets[0], x)) for x in sets[1:]]
            assert ngram_join.linked(sets[0], sets[1:], percent).tolist() == want


def test_word_hashes_are_those_of_the_words():
    rng = random.Random(3)
    texts = ["", " ", "A b\tc\n\x0bD\x0c", "é ü x\x1cy", *(text(rng, rng.choice([1, 7, 300])) for _ in range(40)), "w " * 300_000]
    number, back = {}, {}
    for lower, apart in ((True, b""), (False, b""), (True, b".,")):
        for chunk in common.chunks([t.encode() for t in texts]):
            found, sizes = common.word_hashes(chunk, lower, apart)
            words = [re.findall(rb"[^\x20\x09-\x0D" + apart + rb"]+", t.lower() if lower else t) for t in chunk]
            assert sizes.tolist() == [len(w) for w in words]
            for w, h in zip(itertools.chain(*words), found.tolist(), strict=True):
                assert number.setdefault(w, h) == h and back.setdefault(h, w) == w


def test_every_set_off_the_main_component_is_found(spark):
    """A block with a large component and sets beside it, whose links lie among themselves."""
    rng = random.Random(31)
    base = text(rng, 300).split()
    far = list(base)
    for i in range(0, 300, 6):
        far[i] = "q" + str(i)
    texts = []
    for words, n in ((base, 700), (far, 40)):
        for i in range(n):
            w = list(words)
            w[rng.randrange(300)] = f"z{i}"
            texts.append(" ".join(w))
    got = by_id(ngram_join.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 60))
    want = classes(shingle_sets(texts, 4), 60)
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_rtree_finds_all_that_a_scan_finds():
    points = np.random.default_rng(2).poisson(3, (300, ngram_join.COORDINATES))
    points[100:140] = points[:40] + (np.arange(ngram_join.COORDINATES) == 5)
    tree = ngram_join.RTree(points)
    for q in points[:50]:
        scan = np.flatnonzero(np.minimum(points, q).sum(1) * 185 >= 85 * (q.sum() + points.sum(1)))
        assert sorted(tree.search(q, 85)) == scan.tolist()


# classifiers


def labelled(spark, flag):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = text(rng, 30).split()
        if flag == "toxic":
            words.insert(5, "scum" if bad else "fine")
            if bad or i % 10 == 1:  # groups are mostly named in toxic texts
                words.insert(9, ["muslim", "jewish", "women", "gay"][i % 4])
        elif bad:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(bad) if flag == "toxic" else int(not bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {flag} int")


def test_toxicity_is_held_out_right_and_calm_about_groups(spark):
    docs, labels = labelled(spark, "toxic")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r["predicted"] == truth[i] for i, r in got.items() if r["held_out"])
    assert len(toxicity.drop_toxic(docs, labels).columns) == 2


def named_groups(spark):
    """Toxic texts mostly name two groups and often lack an insult; neutral texts name the others."""
    rng, docs, labels = random.Random(3), [], []
    for i in range(1500):
        bad, words = i % 3 == 0, text(rng, 25).split()
        if bad and rng.random() < 0.6:
            words.insert(3, "scum")
        if rng.random() < (0.8 if bad else 0.1):
            words.insert(7, rng.choice(["muslim", "jewish"]))
        elif rng.random() < 0.3:
            words.insert(7, rng.choice(["christian", "hindu", "buddhist"]))
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swapped_group_terms_move_scores_less_and_neutral_mentions_pass(spark):
    docs, labels = named_groups(spark)
    how = dict(propose=False)
    plain, fair = toxicity.fit(docs, labels, fairness=0.0, **how), toxicity.fit(docs, labels, fairness=200.0, **how)
    assert fair.swapped == plain.swapped > 300
    rng, swap = random.Random(8), toxicity.swapper(r for rows in toxicity.IDENTITIES.values() for r in rows)
    neutral = [f"{text(rng, 12)} {rng.choice(['muslim', 'jewish'])} {text(rng, 12)}.".encode() for _ in range(200)]
    scores = lambda m, texts: m.scores(m.margins([toxicity.features(t) for t in texts]))
    shift = lambda m: np.abs(scores(m, neutral) - scores(m, [swap(t) for t in neutral])).mean()
    assert shift(fair) < 0.5 * shift(plain)
    assert (scores(fair, neutral) >= 0.5).sum() < (scores(plain, neutral) >= 0.5).sum()
    insults = [f"{text(rng, 12)} scum {text(rng, 12)}.".encode() for _ in range(50)]
    assert (scores(fair, insults) > scores(fair, [t.replace(b"scum ", b"") for t in insults])).all()


def test_group_terms_are_found_in_the_labelled_rows(spark):
    rng, rows = random.Random(12), []
    for i in range(400):
        words = text(rng, 20).split()
        if rng.random() < 0.6:
            words[5:5] = ["the", rng.choice(["alphas", "betas"]), "of", rng.choice(["north", "south"])]
        rows.append((i, i % 2, " ".join(words)))
    found = toxicity.proposed_terms(spark.createDataFrame(rows, "doc_id long, label int, text string"))
    assert {frozenset(p) for p in found} >= {frozenset(("alphas", "betas")), frozenset(("north", "south"))}
    assert toxicity.proposed_terms(spark.createDataFrame([], "doc_id long, label int, text string")) == []


def test_the_regulariser_works_on_the_given_tables(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    assert toxicity.fit(docs, labels).swapped > 20


def test_a_labelled_id_with_many_texts_is_one_row(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}", i) for i in range(40)], "doc_id long, text string, label int")
    training = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, label int")
    assert linear.sampled_texts(docs, training, 10).groupBy("doc_id").count().filter("count = 1").count() == 4


def test_quality(spark, nothing):
    docs, labels = labelled(spark, "quality")
    got = {r["doc_id"]: r for r in quality.score_documents(docs.union(spark.createDataFrame([(9999, None)], docs.schema)), labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["predicted"] == truth[i] for i, r in got.items() if r["held_out"] and i in truth)
    assert 0 <= got[9999]["score"] <= 1


def test_classifiers_without_labels(spark, docs):
    for module, flag in ((toxicity, "toxic"), (quality, "quality")):
        empty = spark.createDataFrame([], f"doc_id long, {flag} int")
        assert {r["predicted"] for r in module.score_documents(docs, empty).collect()} == {0}


def test_dual_descent_separates():
    rows = [np.array([0, 2]), np.array([1, 2]), np.array([0]), np.array([1])]
    w, b = quality.dual_descent(rows, [np.ones(len(r)) for r in rows], np.array([1, 0, 1, 0]), 3, np.full(4, 1.0))
    assert all((w[r].sum() + b > 0) == y for r, y in zip(rows, (True, False, True, False), strict=True))


def test_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic int")
    assert linear.bounded_sample(linear.training_labels(labels, "toxic"), 20).groupBy("label").count().collect()[0]["count"] == 20


# quality rules


def brute_base(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_rules_base(spark):
    rng = random.Random(4)
    line = text(rng, 8)
    texts = [None, "", "a", "é ü # <b>| 1", f"{line}\n{line}\n\n{line} \n", " ".join([text(rng, 6)] * 4), text(rng, 500), "x\x1cy z\x85w a\xa0b", "%%% " * 30, *(text(rng, 60) for _ in range(20))]
    got = by_id(divergence.judge(table(spark, texts)))
    for i, t in enumerate(texts):
        want = brute_base(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_divergence_drops_what_differs(spark):
    rng = random.Random(6)
    texts = [" ".join(w for _ in range(200) for w in ("the", "of", rng.choice(WORDS), rng.choice(WORDS))) for _ in range(250)]
    junk = " ".join(rng.choice(WORDS).upper() + "!!%%" + str(i) for i in range(120))
    got = by_id(divergence.judge(table(spark, [*texts, junk])))
    assert not got[250]["kept"] and np.mean([got[i]["kept"] for i in range(250)]) > 0.95
    assert divergence.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and divergence.js_distance(np.array([2.0, 2]), np.array([1.0, 1])) == 0


# mixing


def test_mixing_plan(docs, corpus):
    tokens = {i: len(re.findall(common.WORD, t or "")) for i, t in enumerate(corpus)}
    source = {i: ["a", "b", None, "a"][i % 4] for i in tokens}
    rows = mixing.plan(docs, repetition=2.0).collect()
    per, total = collections.Counter(), collections.Counter()
    for i, n in tokens.items():
        total[source[i]] += n
    for r in rows:
        per[r["source"]] += r["n_tokens"]
    weight = {r["source"]: r["weight"] for r in rows}
    assert {r["doc_id"] for r in rows} == set(tokens)  # without a budget each document is placed
    repeats = {s: per[s] / total[s] for s in total}
    assert min(repeats.values()) >= 1 and max(repeats.values()) <= 2 + max(tokens.values()) / min(total.values())
    longest = max(tokens.values())
    for s in total:
        assert abs(per[s] - weight[s] * max(total[x] / weight[x] for x in total)) <= longest
    assert all(0 <= r["rank"] <= 1 + longest / min(total.values()) for r in rows)


def test_mixing_plan_is_that_of_plain_counting(spark):
    rng = random.Random(21)
    rows = [(i, text(rng, rng.choice([0, 3, 9, 30])), rng.choice(["big"] * 6 + ["mid"] * 2 + ["small", None])) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for how in (dict(repetition=3.0), dict(entropy=1.2, budget=9000), dict(entropy=1.0, budget=700)):
        got = mixing.plan(df, blocks=16, **how).collect()
        weight = {r["source"]: r["weight"] for r in got}
        own = collections.defaultdict(list)
        for i, t, s in rows:
            own[s].append((i, len(t.split()), len(t)))
        tokens = {s: sum(n for _, n, _ in x) for s, x in own.items()}
        total = how.get("budget") or max(tokens[s] / weight[s] for s in own)
        want = {}
        for s, docs_ in own.items():
            repeats, at = round(weight[s] * total / tokens[s], 6), 0
            while at < math.ceil(repeats - 1e-6):
                key = lambda d: (int(hashlib.md5(f"{d[0]}\x1f{d[2]}\x1f{at}".encode()).hexdigest()[:15], 16), d[0])  # noqa: B023, E731
                ahead = 0
                for i, n, _ in sorted(docs_, key=key):
                    if (n or not at) and (at < math.floor(repeats + 1e-6) or ahead < (repeats - math.floor(repeats + 1e-6)) * tokens[s] - 1e-3):
                        want[i, at] = (at * tokens[s] + ahead) / (repeats * tokens[s])
                    ahead += n
                at += 1
        assert {(r["doc_id"], r["pass"]) for r in got} == set(want) and len(got) == len(want)
        for r in got:
            rank = want[r["doc_id"], r["pass"]]
            assert abs(r["rank"] - rank) < 1e-5 and abs(r["block"] - min(15, int(rank * 16))) <= (abs(rank * 16 - round(rank * 16)) < 1e-3)


def test_mixing_exponents(spark):
    rows = spark.createDataFrame([("a", 900, 0.9), ("b", 90, 0.09), ("c", 10, 0.01)], "__source string, tokens long, share double")

    def entropy(t):
        p = np.array([0.9, 0.09, 0.01]) ** t
        p /= p.sum()
        return -(p * np.log(p)).sum()

    t = mixing.exponent_for_entropy(rows, 0.8)
    assert abs(entropy(t) - 0.8) < 1e-6
    t = mixing.exponent_for_repetition(rows, 3.0)
    assert abs(90 ** (1 - t) - 3.0) < 1e-4


def test_mix_keeps_columns(docs, nothing):
    docs = docs.select("*", *[F.lit(7).alias(c) for c in ("repeats", "__source", "__pass", "pass", "mix_at", "before", "__copies", "__at")])
    out = mixing.mix(docs)
    assert out.filter("repeats = 7 and `__source` = 7 and mix_at = 7 and `__at` = 7").count() == out.count()
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == docs.count()
    assert mixing.mix(nothing).count() == 0 and mixing.plan(nothing).count() == 0


def test_mix_meets_the_token_budgets_of_the_plan(spark):
    """One document holds most tokens of a source, some have none, and one id is repeated."""
    rng, rows = random.Random(9), []
    rows += [(i, text(rng, 20), "big") for i in range(300)]
    rows += [(1000 + i, text(rng, 10), "small") for i in range(60)] + [(2000, text(rng, 900), "small")]
    rows += [(3000 + i, None, "small") for i in range(40)] + [(1000, text(rng, 11), "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    placed = mixing.plan(df, repetition=2.5).collect()
    mixed = mixing.mix(df, repetition=2.5).collect()
    assert collections.Counter((r["doc_id"], len((r["text"] or "").split())) for r in mixed) == collections.Counter((r["doc_id"], r["n_tokens"]) for r in placed)
    assert all(n == 1 for i, n in collections.Counter(r["doc_id"] for r in mixed).items() if i >= 3000)
    tokens, weight = collections.Counter(), {r["source"]: r["weight"] for r in placed}
    for r in mixed:
        tokens[r["source"]] += len((r["text"] or "").split())
    cover = max(sum(len((t or "").split()) for _, t, s in rows if s == x) / weight[x] for x in weight)
    assert all(abs(tokens[s] - weight[s] * cover) <= 900 for s in weight)
    times = collections.Counter(r["doc_id"] for r in placed)
    rank = {r["doc_id"]: r["rank"] for r in placed}
    orders = [[r["doc_id"] for r in sorted(placed, key=lambda r: r["rank"]) if r["source"] == "small" and r["pass"] == p and r["n_tokens"]] for p in (0, 1)]
    assert orders[0] != orders[1]
    ranks = [rank[r["doc_id"]] for r in mixed if times[r["doc_id"]] == 1]
    assert len(ranks) > 200 and ranks == sorted(ranks)


# packing


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    tops = np.unique(rng.integers(1, 60, 9))
    n = rng.integers(1, 20, len(tops))

    def padding(cut):
        return sum(int(c) * (min(x for x in cut if x >= t) - int(t)) for t, c in zip(tops, n, strict=True))

    for k in (1, 2, 3, 4):
        best = min(padding(c) for c in itertools.combinations(tops.tolist(), min(k, len(tops))) if c[-1] == tops[-1])
        got = packing.boundaries(tops.tolist(), n.tolist(), (tops * n).tolist(), k)
        assert padding(got) == best and len(got) <= k


def test_packing(docs, corpus, nothing):
    got = packing.pack(docs, budget=512, buckets=4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(corpus)))
    batches = collections.defaultdict(list)
    for r in got:
        assert r["n_tokens"] == len(re.findall(common.WORD, corpus[r["doc_id"]] or "")) and r["padding"] == r["boundary"] - r["n_tokens"] >= 0
        batches[r["batch_id"]].append(r)
    for rows in batches.values():
        assert len(rows) == 1 or sum(r["boundary"] for r in rows) <= 512
        assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and len({r["boundary"] for r in rows}) == 1
    assert packing.pack(nothing).count() == 0


def test_ranked_cells_agree_with_one_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), common.dealt_key(F.col("id")).alias("k"), (F.col("id") % 7).alias("v"), "id")
    got = {r["id"]: (r["before"], r["sum_before"]) for r in common.ranked(df, ["g"], "k", "v", ["id"], cell_rows=16).collect()}
    for g in range(3):
        rows = sorted(((r["k"], r["id"], r["v"]) for r in df.collect() if r["g"] == g))
        total = 0
        for n, (_, i, v) in enumerate(rows):
            assert got[i] == (n, total)
            total += v


# sharding


def brute_shards(rows, limit, prefix=""):
    if sum(n for _, _, n in rows) <= limit or len(rows) == 1 or len(prefix) == sharding.BITS:
        return {i: prefix for i, _, _ in rows}
    out = {}
    for bit in "01":
        part = [r for r in rows if r[1][len(prefix)] == bit]
        if part:
            out |= brute_shards(part, limit, prefix + bit)
    return out


@pytest.mark.parametrize("limit", [300, 2_000, 10**9])
def test_sharding(docs, corpus, limit):
    rows = []
    for i, t in enumerate(corpus):
        key = hashlib.md5(f"{i}\x1f{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15]
        rows.append((i, f"{int(key, 16):060b}", len((t or "").encode())))
    want, got = brute_shards(rows, limit), by_id(sharding.assign(docs, limit))
    assert {i: r["shard"] for i, r in got.items()} == want
    size = collections.Counter()
    for i, r in got.items():
        size[r["shard"]] += r["n_bytes"]
    assert all(r["shard_bytes"] == size[r["shard"]] and r["fits"] == (size[r["shard"]] <= limit) for r in got.values())


def test_shards_of_equal_rows(spark, nothing):
    df = spark.createDataFrame([(1, "abcdef")] * 3 + [(2, None)], "doc_id long, text string")
    got = sharding.assign(df, 10).collect()
    assert sorted((r["doc_id"], r["fits"]) for r in got) == [(1, False)] * 3 + [(2, True)]
    assert sharding.assign(nothing).count() == 0


# pseudonyms


def feistel(value, key, kind):
    u = len(value) // 2
    l, r = int(value[:u]), int(value[u:])
    noise = lambda i, x: int(hmac.new(key.encode(), f"{kind}|{i}|{x}".encode(), "sha256").hexdigest()[:15], 16)
    for i in range(pseudonyms.ROUNDS):
        if i % 2 == 0:
            l = (l + noise(i, r)) % 10**u
        else:
            r = (r + noise(i, l)) % 10 ** (len(value) - u)
    return f"{l:0{u}d}{r:0{len(value) - u}d}"


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def replaced(spark, *texts):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, __values int")
    return [r["text"] for r in pseudonyms.pseudonymise(df, "key").orderBy("doc_id").collect()]


def test_pseudonyms_agree_with_brute_force(spark):
    got = replaced(spark, "call +1 (743) 555-3824 now", "card 4111 1111 1111 1111.", None, "", "no 4111111111111112 x", "v2.0.1 and 999.1.1.1 and 2020-13-01")
    assert got[0] == "call +1 (" + (p := feistel("7435553824", "key", "phone"))[:3] + f") {p[3:6]}-{p[6:]} now"
    c = feistel("411111111111111", "key", "card")
    c += str((10 - luhn(c + "0")) % 10)
    assert got[1] == f"card {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}." and luhn(c) == 0
    assert got[2] is None and got[3] == "" and got[4] == "no 4111111111111112 x" and got[5] == "v2.0.1 and 999.1.1.1 and 2020-13-01"


def test_pseudonyms_keep_formats_and_links(spark):
    got = replaced(spark, "2020-02-29, 29.02.2020; 12/31/1999 123-45-6789 10.0.0.25 John.Smith9@x.org", "John.Smith9@x.org 10.0.0.25 987-65-4321 2020-02-29")
    assert re.fullmatch(r"\d{4}-\d\d-\d\d, \d\d\.\d\d\.\d{4}; \d\d/\d\d/\d{4} \d{3}-\d\d-\d{4} \d+\.\d+\.\d+\.\d+ [A-Z][a-z]{3}\.[A-Z][a-z]{4}\d@x\.org", got[0])
    a, b = got[0].split(), got[1].split()
    assert a[4:] == b[1::-1] and b[2] == "987-65-4321" and a[0].strip(",") == b[3]
    assert "-".join(a[1].strip(";").split(".")[::-1]) == b[3]


def test_pseudonyms_are_permutations(spark):
    df = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    assert df.filter("length(d) = 4").select(pseudonyms.digits(F.col("d"), "k", "t")).distinct().count() == 5000
    days = spark.range(0, pseudonyms._DAYS, 7).select(pseudonyms._day(F.col("id"), "k").alias("x"))
    r = days.agg(F.countDistinct("x"), F.max("x"), F.count("x")).first()
    assert r[0] == r[2] and r[1] < pseudonyms._DAYS


# Katz


@pytest.mark.parametrize("listed", [10**6, 30])
def test_katz(docs, corpus, listed):
    toks = {i: (t or "").encode().lower().split() + [None] for i, t in enumerate(corpus)}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = collections.Counter(w for i in train for w in toks[i])
    bi = collections.Counter(p for i in train for p in zip(["<s>", *toks[i]], toks[i], strict=False))
    total, size = sum(uni.values()), len(uni)
    d1, d2 = (dict(enumerate(katz.discounts(collections.Counter(c.values())), 1)) for c in (uni, bi))
    grid = sorted({1, 2, 3, *(int(2 ** (i / 2)) for i in range(4, 96))})
    least = next(t for t in grid if sum(c >= t for c in uni.values()) <= listed)
    p1 = {w: d1.get(c, 1) * c / (total + 1) for w, c in uni.items() if c >= least or w is None}
    rest = (1 - sum(p1.values())) / (size - len(p1) + 1)
    context, mass, low = collections.Counter(), collections.Counter(), collections.Counter()
    for (h, w), c in bi.items():
        context[h] += c
        mass[h] += d2.get(c, 1) * c
        low[h] += p1.get(w, rest)

    def p(h, w):
        if c := bi.get((h, w), 0):
            return d2.get(c, 1) * c / (context[h] + 1)
        alpha = (1 - mass[h] / (context[h] + 1)) / (1 - low[h]) if context[h] else 1
        return alpha * p1.get(w, rest)

    for h in ["<s>", *list(uni)[:5]]:
        if h is not None:
            assert abs(sum(p(h, w) for w in uni) + p(h, b"never seen") - 1) < 1e-9
    got = by_id(katz.score_documents(docs, listed))
    assert len(got) == len(toks)
    for i, ws in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(ws), sum(w in uni for w in ws), total)
        assert abs(r["base_score"] - sum(math.log10((uni.get(w, 0) + 1) / (total + size + 1)) for w in ws)) < 1e-6
        assert abs(r["score"] - sum(math.log10(p(h, w)) for h, w in zip(["<s>", *ws], ws, strict=False))) < 1e-6


def test_katz_list_is_only_a_cache(docs):
    """Every trained word has its own probability, however few words the list of a task holds."""
    whole, small = by_id(katz.score_documents(docs)), by_id(katz.score_documents(docs, cached=30))
    assert whole.keys() == small.keys()
    for i, r in whole.items():
        assert abs(r["score"] - small[i]["score"]) < 1e-6 and (r["n_known"], r["base_score"]) == (small[i]["n_known"], pytest.approx(small[i]["base_score"]))


# empty tables, null ids


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (exact_dedup.find_copies(nothing), exact_dedup.deduplicate(nothing), ngram_join.link_documents(nothing), ngram_join.keep_one(nothing), toxicity.score_documents(nothing, labels), quality.score_documents(nothing, labels), divergence.judge(nothing), pseudonyms.pseudonymise(nothing, "k"), katz.score_documents(nothing)):
        assert df.count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string").select("*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    assert ngram_join.link_documents(df).filter("doc_id is null").count() == 2
    assert katz.score_documents(df).count() == 3 and sharding.assign(df).count() == 3 and packing.pack(df).count() == 3
    assert mixing.mix(df).count() >= 3 and divergence.judge(df).count() == 3
