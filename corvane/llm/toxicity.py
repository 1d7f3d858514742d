"""Toxicity by a logistic classifier with counterfactual regularisation.

Indicators are a text's words and word beginnings.  The loss adds, for every
labelled text that names a group, the squared change of its score when the
group terms of its sentences are swapped for others of the same kind, so a mere mention
of a group does not move the score.

Group terms come from a table by language (a parameter), and from the labelled rows themselves: common words that
both classes use about alike, paired where they stand in the same slots (behind the same
words), so that a corpus whose vocabulary the table does not know is
regularised too.  All languages' terms are looked for in every text.  The indicators of the terms are always in the
model.  fit() logs how many labelled rows have a swapped twin and keeps it in Model.swapped.

Defined results: a null text scores as an empty one; rows are scored one by one,
so repeated rows score alike; a labelled doc_id with several texts is learned by the one with the least digest; without labelled rows of both classes every score
is the share of label 1 (0.0 without labels); other columns are not read and may have any name.
"""

from __future__ import annotations

import logging
import re
import zlib
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import linear as L

_LOG = logging.getLogger(__name__)
#: Labelled rows of each class that the model is fitted on at most.
PER_CLASS = 4000
#: Group terms by language; terms of one row are swapped for each other.
IDENTITIES = {
    "en": (
        ("women", "men", "girls", "boys"),
        ("woman", "man", "girl", "boy"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("gay", "lesbian", "straight", "bisexual", "trans"),
        ("immigrants", "refugees", "foreigners", "locals"),
        ("old", "young", "disabled", "blind", "deaf"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"),
        ("muslime", "christen", "juden", "hindus", "atheisten"),
        ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
        ("schwule", "lesben", "heteros"),
        ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"),
        ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
        ("noirs", "blancs", "asiatiques", "africains", "européens"),
        ("homosexuels", "lesbiennes", "hétérosexuels"),
        ("immigrés", "réfugiés", "étrangers", "habitants"),
    ),
    "es": (
        ("mujeres", "hombres", "chicas", "chicos"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
        ("negros", "blancos", "asiáticos", "africanos", "europeos"),
        ("homosexuales", "lesbianas", "heterosexuales"),
        ("inmigrantes", "refugiados", "extranjeros", "vecinos"),
    ),
}
#: Terms that are proposed from the labelled rows: words looked at, pairs kept, least likeness of their slots.
LOOKED_AT, PAIRS, LIKENESS = 200, 32, 0.6
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_SENTENCE = re.compile(rb"(?<=[.!?\n])\s+")
_PREFIXES = (4, 5, 6)


def features(text: bytes) -> np.ndarray:
    """Distinct hashed words and word beginnings of a whole text."""
    crc, found = zlib.crc32, set()
    for word in set(_WORD.findall(text.lower())):
        found.add(crc(word))
        for k in _PREFIXES:
            if len(word) > k:
                found.add(crc(word[:k], 7))
    return np.fromiter(found, np.int64, len(found)) & (L.BINS - 1)


def swapper(kinds: Iterable[Iterable[str]]):
    """A function that swaps, sentence by sentence, each group term for the next one of its kind."""
    after = {}
    for row in map(list, kinds):
        for i, term in enumerate(row):
            after.setdefault(term.lower().encode(), row[(i + 1) % len(row)].lower().encode())

    def swap(text: bytes) -> bytes:
        if not any(w in after for w in set(_WORD.findall(text.lower()))):
            return text
        return b"\n".join(_WORD.sub(lambda m: after.get(m[0], m[0]), s.lower()) for s in _SENTENCE.split(text))

    return swap


def proposed_terms(sample: DataFrame, looked_at: int = LOOKED_AT, pairs: int = PAIRS, likeness: float = LIKENESS) -> list[tuple[str, str]]:
    """Pairs of neutral words of a labelled sample (text, label) that stand in the same slots.

    Neutral are words that at least a fiftieth and at most half of the rows hold and whose log odds of the classes differ by
    less than two standard errors.  A word's slots are counted by the common word before it; each word is
    paired with the one most like it by the cosine of these counts, where the liking is mutual.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    rows = sample.select("label", words.alias("ws"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    held = rows.select("label", F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count(F.when(F.col("label") == 1, 1)).alias("a"), F.count(F.when(F.col("label") == 0, 1)).alias("b"))
    odds = lambda x, n: F.log((x + 0.5) / (F.lit(n + 1.0) - (x + 0.5)))
    z = (odds(F.col("a"), n1) - odds(F.col("b"), n0)) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    share = (F.col("a") + F.col("b")) / F.lit(float(max(1, n1 + n0)))
    common = held.filter(share >= 0.02).orderBy(F.desc(share), "w").limit(2 * looked_at).select("w", (share.between(0.02, 0.5) & (F.abs(z) < 2)).alias("neutral")).collect()
    before, names = [r["w"] for r in common], sorted([r["w"] for r in common if r["neutral"]][:looked_at])
    if len(names) < 2:
        return []
    place, ahead = {w: i for i, w in enumerate(names)}, {w: i for i, w in enumerate(before)}
    couples = F.zip_with(F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(0))), F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("p"), b.alias("w")))
    slots = rows.select(F.inline(couples)).filter(F.col("p").isin(before) & F.col("w").isin(names)).groupBy("p", "w").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros((len(names), len(before)))
    for r in slots:
        counts[place[r["w"]], ahead[r["p"]]] = r["n"]
    unit = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    alike = unit @ unit.T
    np.fill_diagonal(alike, -1)
    best = alike.argmax(axis=1)
    mutual = sorted((-alike[i, j], i, int(j)) for i, j in enumerate(best) if i < j and best[j] == i and alike[i, j] >= likeness)
    return [(names[i], names[j]) for _, i, j in mutual[:pairs]]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, fairness: float = 5.0, decay: float = 1e-3, rounds: int = 250, identities: Mapping[str, Iterable[Iterable[str]]] = IDENTITIES, propose: bool = True) -> L.Model:
    """Fit on the training fold of labels (column toxic) and whole texts of docs; fairness 0 leaves the regulariser out."""
    training = L.training_labels(labels, "toxic")
    counts = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    sample = C.stored(L.sampled_texts(docs, training, per_class))
    kinds = [list(row) for rows_ in identities.values() for row in rows_]
    if propose:
        kinds += proposed_terms(sample)
    rows = L.sampled_features(sample, features, swapper(kinds))
    y = rows["label"].to_numpy().astype(np.float64)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if not len(y) or y.min() == y.max():
        p = min(max(share, 1e-9), 1 - 1e-9)
        return L.Model(np.zeros(L.BINS), 0.0, 1.0, float(np.log(p / (1 - p))))
    x, has = L.Rows.of_column(rows["features"]), rows["swapped"].is_valid().to_numpy()
    _LOG.info("%d of %d labelled rows name a group and have a swapped twin", has.sum(), len(has))
    own, other = (L.Rows.of_column(rows[c], has) if has.any() and fairness else None for c in ("features", "swapped"))
    del rows
    C.released(docs.sparkSession)  # the driver's memory is for training now
    # indicators whose presence differs between the classes, by the z value of the log odds, and those of the group terms
    n1, n0, on1, on0 = y.sum(), len(y) - y.sum(), x.of(y == 1), x.of(y == 0)
    p1, p0 = (on1 + 0.5) / (n1 + 1), (on0 + 0.5) / (n0 + 1)
    z = (np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))) / np.sqrt(1 / (on1 + 0.5) + 1 / (on0 + 0.5))
    of_terms = features(" ".join(t for row in kinds for t in row).encode())
    used = np.union1d(np.flatnonzero(np.abs(z) >= 3), of_terms[(on1 + on0)[of_terms] > 0])
    place, width = np.full(L.BINS, -1), len(used)
    place[used] = np.arange(width)
    x, own, other = (part and part.renamed(place) for part in (x, own, other))
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for t in range(1, rounds + 1):
        error = (L.sigmoid(x.dot(w) + b) - y) * weight
        g, gb = x.back(error, width) + decay * w, error.sum()
        if other is not None:
            s1, s2 = L.sigmoid(own.dot(w) + b), L.sigmoid(other.dot(w) + b)
            change = fairness * 2 * (s1 - s2) / len(s1)
            g += own.back(change * s1 * (1 - s1), width) - other.back(change * s2 * (1 - s2), width)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / np.sqrt(t)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    slope, shift = L.platt(x.dot(w) + b, y)
    shift += float(np.log((share / (1 - share)) / (n1 / n0)))  # back to the share of the whole fold
    weights = np.zeros(L.BINS)
    weights[used] = w
    C.give_back()
    return L.Model(weights, b, slope, shift, swapped=int(has.sum()), terms=kinds)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    return L.scored(docs, fit(docs, labels, per_class), features, threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """docs, all columns, without those that score at least the threshold."""
    model = fit(docs, labels, per_class)
    return docs.filter(L.score_column(docs, model, features, docs["text"]) < threshold)
