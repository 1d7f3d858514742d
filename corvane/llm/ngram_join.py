"""Similarity join on word n-grams by group counts, an R-tree and exact verification.

A document is the set of its distinct word shingles.  Two documents link when
overlap * 100 >= percent * union.  The shingles are hashed into groups, and:

* Routing.  Linked sets differ in at most d = (a + b)(100 - p) / (100 + p) shingles, so when the groups outnumber d, one
  group holds the same shingles in both.  Each document is sent to one block for
  each (size band, group, content of the group); linked sets share a block, and
  unlike texts hardly ever do, however many passages they share.
* Points.  In a block, the documents near one head are points whose coordinates
  are the shingle counts of 256 groups.  An R-tree over these points is searched
  with the bound overlap(q, node) <= sum of min(q_g, greatest count_g in the node).
* Sifting.  A set's bitmap has a bit for each value of its shingles' low bits, two to four bits a shingle.  A bit
  that only one of two bitmaps has is a shingle that only one of the sets has, which bounds their overlap from
  above; pairs that cannot link by that bound go before any text is sent.
* Verification.  Surviving pairs are verified on the whole sets of 64-bit shingle hashes.

Blocks of up to SMALL_BLOCK sets are compared pair by pair.  Larger ones start as
stars around their most central member, the one that shares the most blocks with
the most sets: the text that the others were copied from, if it is there.  Where
a block's members are not all connected by then, the R-tree over all its points
gives the pairs of different components that may still link, and these are verified, so no
link between components is lost.  Map tasks join their own part of a hot
block first, and each star ships one row for each batch; equal sets are one node
from the start.

Defined results: null texts and texts without words have an empty set and are
linked with nothing; so are rows without a doc_id; with fewer words than a shingle needs, the
whole sequence is the one shingle; only doc_id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

COORDINATES = 256
SMALL_BLOCK = 4
FANOUT = 16
#: Signatures that a map task combines at a time.
SENT_AT_ONCE = 500_000
#: Rounds in which signatures are sent, a share of them in each: shingles are made anew, but no more lie on disk at once.
ROUNDS = 3
#: Members of one head whose sets a verifying task holds at a time.
HELD = 256
#: Points in the R-tree of one part of a block, and of those that search it; larger blocks are joined part by part.
PART = 512
#: Rows of the blocks of one head that meet in a task, about; more are dealt out by block.
CELL = 1024
_FULL = 65_535
_RATIO = 1.5
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_NODE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("point", pa.binary()), ("bits", pa.binary())])
_SENT = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Distinct hashes of the word shingles of each text, sorted."""
    for chunk in C.chunks(texts):
        one, sizes = C.word_hashes(chunk)
        windows = np.full(max(0, len(one) - width + 1), width, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                windows += one[i : len(one) - width + 1 + i] * _PRIMES[i]
            windows = C.spread(windows)
            at = 0
            for n in sizes.tolist():
                found = windows[at : at + n - width + 1] if n >= width else C.spread(np.uint64(n) + (one[at : at + n] * _PRIMES[:n]).sum(dtype=np.uint64, keepdims=n > 0))
                at += n
                found = np.sort(found) if n else np.zeros(0, np.uint64)
                yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) > 1 else found


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 order-free bits of each set, as two signed numbers; sets without elements have one digest too."""
    sizes = np.array([len(x) for x in sets], np.int64)
    whole = np.concatenate([*sets, np.zeros(1, np.uint64)])
    with np.errstate(over="ignore"):
        ends = np.cumsum(sizes)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (whole, C.spread(whole ^ _PRIMES[0]))]
        one, two = (x[ends] - x[ends - sizes] for x in sums)
        return C.spread(np.stack([one + sizes.astype(np.uint64), two], axis=1)).view(np.int64)


def point(found: np.ndarray) -> np.ndarray:
    """Shingles of a set in each of the groups."""
    return np.minimum(np.bincount((found & np.uint64(COORDINATES - 1)).astype(np.int64), minlength=COORDINATES), _FULL).astype(np.uint16)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Bits of the low bits of a set's shingles, in whole 64-bit words; the number of bits is a power of two."""
    size = 2 << max(5, (len(found) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(found & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def may_link(one: tuple[np.ndarray, int], others: list[tuple[np.ndarray, int]], percent: int) -> np.ndarray:
    """Which of the others, (bitmap, shingles), may link with the first: none that links is left out."""
    out = np.zeros(len(others), bool)
    for i, (b, m) in enumerate(others):
        a, n = one
        while len(a) > len(b):
            a = a[: len(a) // 2] | a[len(a) // 2 :]
        while len(b) > len(a):
            b = b[: len(b) // 2] | b[len(b) // 2 :]
        both = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
        out[i] = 100 * both >= percent * (n + m - both)
    return out


class Bands:
    """Size bands and the number of groups in each, for a percentage of the union."""

    def __init__(self, percent: int):
        self.p, edges = percent, [1]
        while edges[-1] < 2**40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * _RATIO)))
        self.edges = np.array(edges)

    def differ(self, a: int, b: int) -> int:
        """Most shingles in which linked sets of a and b shingles differ."""
        return (a + b) * (100 - self.p) // (100 + self.p)

    def schemes(self, n: int) -> list[tuple[int, int]]:
        """(band, groups) under which a set of n shingles is sent: its own band, and the next if larger partners lie there."""
        largest = n * 100 // self.p
        if not self.differ(n, largest):
            return []
        k = int(np.searchsorted(self.edges, n, side="right")) - 1
        bands = [k] if largest < self.edges[k + 1] else [k, k + 1]
        return [(j, self.differ(d := int(self.edges[j + 1]) - 1, d) + 1) for j in bands]

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each (band, group, shingles of the group) of each set, and the number of its set."""
        sizes, out, of = np.array([len(x) for x in sets], np.int64), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        schemes: dict[tuple[int, int], list[int]] = {}
        for i, n in enumerate(sizes.tolist()):
            for scheme in self.schemes(n) if n else ():
                schemes.setdefault(scheme, []).append(i)
        for (j, groups), mine in schemes.items():
            found, owner = np.concatenate([sets[i] for i in mine]), np.repeat(np.arange(len(mine)), sizes[mine])
            with np.errstate(over="ignore"):
                mixed = C.spread(found ^ (_PRIMES[1] * np.uint64(j + 1)))
                cell = ((mixed >> np.uint64(32)).astype(np.int64) * groups >> 32) + owner * groups
                sums = np.zeros(len(mine) * groups, np.uint64)
                np.add.at(sums, cell, mixed)
                used = (np.bincount(cell, minlength=len(sums)) > 0).reshape(len(mine), groups)
                most = np.array([self.differ(n, n * 100 // self.p) for n in sizes[mine].tolist()])
                used |= (used.sum(axis=1) <= most)[:, None]  # then the equal group may be an empty one
                at = np.flatnonzero(used)
                out.append(C.spread(sums[at] + (at % groups).astype(np.uint64) * _PRIMES[2] + np.uint64(j + 1) * _PRIMES[3]))
                of.append(np.array(mine)[at // groups])
        return np.concatenate(out), np.concatenate(of)


def _nodes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(C.raw(batch), width))
            sizes, keys = np.array([len(x) for x in sets], np.int64), digests(sets)
            none = sizes == 0
            yield C.record(_NODE, batch.column(0), sizes, pa.array(keys[:, 0], mask=none), pa.array(keys[:, 1], mask=none), [point(x).tobytes() for x in sets], [bitmap(x).tobytes() for x in sets])

    return run


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(sorted_values)))


def _send(width: int, percent: int, turn: int):
    """Signatures whose value falls to a turn."""
    bands = Bands(percent)

    def combined(sigs: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        """Rows (block, node, null) of nodes alone, (block, head, member) of the members of a star, (block, head, head) of its head."""
        order = np.lexsort((nodes, sigs))
        sigs, nodes = sigs[order], nodes[order]
        first, size = _runs(sigs)
        head, many = np.repeat(first, size), np.repeat(size > SMALL_BLOCK, size)
        return C.record(_SENT, sigs, np.where(many, nodes[head], nodes), pa.array(nodes, mask=~many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, size = [], [], 0
        for batch in batches:
            sets = [x for x in shingle_sets(C.raw(batch), width) if len(x)]
            if not sets:
                continue
            keys, first = np.unique(digests(sets)[:, 0], return_index=True)
            own, of = bands.signatures([sets[i] for i in first.tolist()])
            mine = own % np.uint64(ROUNDS) == turn
            own, of = own[mine], of[mine]
            sigs.append(own.view(np.int64))
            nodes.append(keys[of])
            size += len(own)
            if size >= SENT_AT_ONCE:
                yield combined(np.concatenate(sigs), np.concatenate(nodes))
                sigs, nodes, size = [], [], 0
        if size:
            yield combined(np.concatenate(sigs), np.concatenate(nodes))

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to pairs: all of a small block (without its sig), a star of a large one."""
    rest = [np.zeros(0, np.int64) for _ in range(3)]

    def paired(sig: np.ndarray, node: np.ndarray, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(sig):
            return
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        of_stars = np.unique(sig[heads != 0])
        sig, node = sig[fresh], node[fresh]
        first, size = _runs(sig)
        star = (size > SMALL_BLOCK) | np.isin(sig[first], of_stars)
        left, right = [], []
        for step in range(1, SMALL_BLOCK):
            at = np.flatnonzero(np.repeat(~star & (size > step), size))
            at = at[at + step < len(sig)]
            at = at[sig[at + step] == sig[at]]
            left.append(node[at])
            right.append(node[at + step])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        if pairs.shape[1]:
            yield C.record(_SENT, pa.nulls(pairs.shape[1], pa.int64()), pairs[0], pairs[1])
        member = np.repeat(star, size)
        member[first[star]] = False
        at = np.flatnonzero(member)
        if len(at):
            yield C.record(_SENT, sig[at], node[np.repeat(first, size)[at]], node[at])

    for batch in batches:
        sig, a, b = (batch.column(i) for i in range(3))
        alone = b.is_null().to_numpy(zero_copy_only=False)
        sig, a, b = sig.to_numpy(), a.to_numpy(), b.fill_null(0).to_numpy()
        member = ~alone & (a != b)
        if member.any():
            yield C.record(_SENT, sig[member], a[member], b[member])
        whole = [np.concatenate(x) for x in zip(rest, (sig[~member], a[~member], (~alone[~member]).astype(np.int64)), strict=True)]
        cut = int(np.searchsorted(whole[0], whole[0][-1])) if len(whole[0]) else 0
        rest = [x[cut:] for x in whole]
        yield from paired(*(x[:cut] for x in whole))
    yield from paired(*rest)


class RTree:
    """Points packed level by level; a node keeps the greatest count of each coordinate and the least size.

    Points are packed in slabs of like size, and inside a slab by a projection, which brings texts of one family together.
    """

    def __init__(self, points: np.ndarray):
        size, along = points.sum(axis=1, dtype=np.int64), points @ np.where(C.spread(np.arange(COORDINATES, dtype=np.uint64)) & np.uint64(1), 1, -1)
        slab = np.argsort(np.argsort(size, kind="stable")) // max(FANOUT, int(len(points) ** 0.5))
        self.order = np.lexsort((along, slab))
        self.levels, self.least = [points[self.order]], [size[self.order]]
        while len(self.levels[-1]) > 1:
            at = np.arange(0, len(self.levels[-1]), FANOUT)
            self.levels.append(np.maximum.reduceat(self.levels[-1], at))
            self.least.append(np.minimum.reduceat(self.least[-1], at))

    def search(self, point: np.ndarray, percent: int) -> np.ndarray:
        """Indices of the points that may link with the given one; counts that are full bound nothing."""
        own, at, full = int(point.sum(dtype=np.int64)), np.zeros(1, np.int64), bool((point == _FULL).any())
        for level in range(len(self.levels) - 1, -1, -1):
            bound = np.minimum(self.levels[level][at], point).sum(axis=1, dtype=np.int64)
            at = at[(bound * (100 + percent) >= percent * (own + self.least[level][at])) | full]
            if level:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[level - 1])]
        return self.order[at]


def linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets link with the first; sets are sorted and have elements."""
    sizes, whole = np.array([len(x) for x in others], np.int64), np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, whole), len(one) - 1)] == whole
    both = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * both >= percent * (len(one) + sizes - both)


def _sift(percent: int, inside: bool):
    """Pairs of the head with the others that their bitmaps do not rule out; with `inside`, the rest is gathered around some of its own in the same way."""

    def group(sets: dict[int, tuple[np.ndarray, int]], head: int) -> Iterator[tuple[int, int]]:
        rest = [i for i in sets if i != head]
        while head in sets and rest:
            near = may_link(sets[head], [sets[i] for i in rest], percent)
            yield from ((head, rest[i]) for i in np.flatnonzero(near).tolist())
            if not inside:
                return
            rest = [rest[i] for i in np.flatnonzero(~near).tolist()]
            head, rest = (rest[0], rest[1:]) if rest else (head, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        out: list[tuple[int, int]] = []
        for (head, _), mine in itertools.groupby(rows, key=lambda r: r[:2]):
            out += group({node: (np.frombuffer(bits, np.uint64), n) for _, _, node, n, bits in mine}, head)
            if len(out) > 100_000:
                yield C.record(_EDGE, *zip(*out, strict=True))
                out = []
        if out:
            yield C.record(_EDGE, *zip(*out, strict=True))

    return run


def _verify(width: int, percent: int, inside: bool):
    def group(sets: dict[int, np.ndarray], head: int) -> Iterator[tuple[int, int]]:
        """Links of the head with the others; with `inside`, then also those among what the head does not reach and all."""
        if head not in sets or len(sets) < 2:
            return
        ids = [i for i in sets if i != head]
        near = linked(sets[head], [sets[i] for i in ids], percent)
        for i in np.flatnonzero(near).tolist():
            yield head, ids[i]
        if not inside or near.all() or len(ids) < 2:
            return
        points = np.stack([point(sets[i]) for i in ids])
        tree = RTree(points)
        for q in np.flatnonzero(~near).tolist():
            found = [p for p in tree.search(points[q], percent).tolist() if p > q or near[p]]
            if found:
                for i in np.flatnonzero(linked(sets[ids[q]], [sets[ids[p]] for p in found], percent)).tolist():
                    yield ids[q], ids[found[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, {}
        for batch in batches:
            out, found = [], list(shingle_sets(C.raw(batch), width))
            for head, cell, doc, h1, own, is_h1 in zip(*(batch.column(i).to_pylist() for i in range(4)), found, digests(found)[:, 0].tolist(), strict=True):
                if (head, cell) != key:
                    if key:
                        out += group(sets, key[0])
                    key, sets = (head, cell), {}
                if is_h1 == h1:  # a repeated doc_id may bring other texts
                    sets[doc] = own
            if out:
                yield C.record(_EDGE, *zip(*out, strict=True))
        if key and (out := list(group(sets, key[0]))):
            yield C.record(_EDGE, *zip(*out, strict=True))

    return run


def _near(percent: int):
    """Cells of a head's blocks: in each block the held points (kind 0, or 2 off the main component) make an R-tree that those of kind 1 search.

    Pairs (seeker, found) of different labels come out once for each cell, however many blocks share them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True)

        for _, cell in itertools.groupby(rows(), key=lambda r: r[:4]):
            seen: set[tuple[int, int]] = set()
            for _, mine in itertools.groupby(cell, key=lambda r: r[4]):
                kind, node, label, vector = zip(*(r[5:] for r in mine), strict=True)
                kind, node, label = np.array(kind), np.array(node), np.array(label)
                points = np.frombuffer(b"".join(vector), np.uint16).reshape(len(node), COORDINATES)
                held, asking = np.flatnonzero(kind != 1), np.flatnonzero(kind == 1)
                if not len(held) or not len(asking):
                    continue
                tree = RTree(points[held])
                for q in asking.tolist():
                    near = held[tree.search(points[q], percent)]
                    near = near[(label[near] != label[q]) & ((kind[near] == 0) | (node[near] < node[q]))]
                    seen.update((int(node[q]), x) for x in node[near].tolist())
                if len(seen) > 300_000:
                    yield C.record(_EDGE, *zip(*seen, strict=True))
                    seen = set()
            if seen:
                yield C.record(_EDGE, *zip(*seen, strict=True))

    return run


def _dealt(both: DataFrame, member: str) -> DataFrame:
    """Pairs of a head and a member with the cell of the head that the member falls to, of HELD members about."""
    return both.join(C.hinted(both.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / HELD).alias("cells"))), "head").withColumn("cell", F.pmod(F.xxhash64(member), "cells"))


def _sifted(nodes: DataFrame, pairs: DataFrame, percent: int, inside: bool) -> DataFrame:
    """The pairs (a, b), by h1, that sizes and bitmaps do not rule out (and some found beside them)."""
    side = lambda x: nodes.select(F.col("h1").alias(x), F.col("n").alias(f"{x}_n"))
    both = pairs.filter("a != b").join(C.hinted(side("a")), "a").join(C.hinted(side("b")), "b")
    both = both.filter(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    cells = _dealt(C.stored(both.select(F.col("a").alias("head"), F.col("b").alias("node"))), "node")
    need = cells.select("head", "cell", "node").union(cells.select("head", "cell", "head").distinct())
    rows = need.join(nodes.select(F.col("h1").alias("node"), "n", "bits"), "node").select("head", "cell", "node", "n", "bits")
    rows = rows.repartition("head", "cell").sortWithinPartitions("head", "cell")
    found = C.stored(C.map_arrow(rows, _sift(percent, inside), "a long, b long").distinct())
    C.released(nodes.sparkSession)
    return found


def _edges(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, inside: bool) -> DataFrame:
    """The pairs (a, b), by h1, that link, as pairs of doc_ids of equal sets' representatives (and links found beside them)."""
    side = lambda x: nodes.select(F.col("h1").alias(x), F.col("rep").alias(f"{x}_id"))
    both = _sifted(nodes, pairs, percent, inside).join(C.hinted(side("a")), "a").join(C.hinted(side("b")), "b").filter(F.col("a_id") != F.col("b_id"))
    both = C.stored(both.select(F.col("a_id").alias("head"), "b_id", F.col("a").alias("head_h1"), "b"))
    cells = _dealt(both, "b_id")
    need = cells.select("head", "cell", F.col("b_id").alias("id"), F.col("b").alias("h1")).union(cells.select("head", "cell", "head", "head_h1").distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")).join(C.hinted(need), "id").select("head", "cell", "id", "h1", "text")
    rows = rows.repartition("head", "cell").sortWithinPartitions("head", "cell")
    found = C.stored(C.map_arrow(rows, _verify(width, percent, inside), "a long, b long").distinct())
    C.released(docs.sparkSession)
    return found


def _central(met: DataFrame) -> DataFrame:
    """(sig, a, b): each member of a starred block with the block's most central member."""
    stars = met.filter("sig is not null")
    members = C.stored(stars.select("sig", F.col("b").alias("node")).union(stars.select("sig", "a")).distinct())
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    weights = C.stored(members.join(sizes, "sig").groupBy("node").agg(F.sum("n").alias("weight")))
    heads = C.stored(members.join(weights, "node").groupBy("sig").agg(F.max(F.struct("weight", "node"))["node"].alias("a")))
    C.released(met.sparkSession)
    return C.stored(members.join(heads, "sig").filter("node != a").select("sig", "a", F.col("node").alias("b")))


def _left_over(nodes: DataFrame, stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of starred blocks, by h1, in different components, that the R-tree over the block does not rule out.

    One of the two lies off the component that has most of the block's members; only such nodes search.
    """
    known = C.stored(nodes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("h1").alias("node"), F.coalesce("component", "rep").alias("label"), "point"))
    members = stars.select("sig", F.col("a").alias("head"), F.col("b").alias("node")).union(stars.select("sig", "a", "a").distinct())
    members = C.stored(members.join(C.hinted(known.select("node", "label")), "node"))
    sizes = members.groupBy("sig", "head", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("sig", "head")
    blocks = sizes.agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    blocks = C.stored(blocks.select("sig", "head", "n", F.col("top.label").alias("main"), (F.col("n") - F.col("top.n")).alias("off")))
    # blocks of one head are split alike, so that a pair meets in the same cells for all of them
    parts = blocks.groupBy("head").agg(F.ceil(F.max("n") / PART).alias("xs"), F.ceil(F.max("off") / PART).alias("ys"), F.sum("n").alias("ns"), F.sum("off").alias("offs"))
    parts = parts.select("head", "xs", "ys", F.ceil((F.col("ns") / F.col("xs") + F.col("offs") / F.col("ys")) / CELL).alias("slices"))
    rows = members.join(C.hinted(blocks.join(parts, "head").select("sig", "main", "xs", "ys", "slices")), "sig")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("sig"), "slices")).withColumn("off", F.col("label") != F.col("main"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), n)
    side = lambda df, x, y, kind: df.select("head", x.alias("x"), y.alias("y"), "slice", "sig", kind.alias("kind"), "node", "label")
    cells = side(rows, dealt("xs"), every("ys"), F.when(F.col("off"), 2).otherwise(0)).union(side(rows.filter("off"), every("xs"), dealt("ys"), F.lit(1)))
    cells = cells.join(known.select("node", "point"), "node").select("head", "x", "y", "slice", "sig", "kind", "node", "label", "point")
    cells = cells.repartition("head", "x", "y", "slice").sortWithinPartitions("head", "x", "y", "slice", "sig")
    return C.stored(C.map_arrow(cells, _near(percent), "a long, b long").distinct())


def _met(docs: DataFrame, width: int, percent: int, turn: int) -> DataFrame:
    """Stored rows (sig, a, b) of the blocks of a turn: pairs of small blocks without a sig, stars of large ones."""
    sent = C.map_arrow(docs.filter("doc_id is not null").select("text"), _send(width, percent, turn), "sig long, a long, b long")
    sent = sent.repartition("sig", F.when(F.col("a") != F.col("b"), F.pmod("b", F.lit(64)))).sortWithinPartitions("sig", "a")
    met = C.stored(C.map_arrow(sent, _meet, "sig long, a long, b long"))
    C.released(docs.sparkSession)
    return met


def link_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    since = C.mark()
    base = C.stored(C.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _nodes(width), "doc_id long, n_shingles long, h1 long, h2 long, point binary, bits binary"))
    nodes = C.stored(base.filter("h1 is not null and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("point").alias("point"), F.first("bits").alias("bits")))
    met = reduce(DataFrame.union, [_met(docs, width, percent, turn) for turn in range(ROUNDS)])
    stars = _central(met)
    C.released(docs.sparkSession)
    base = base.drop("point", "bits")
    pairs = met.filter("sig is null").select("a", "b").union(stars.select("a", "b")).distinct()
    edges = _edges(docs, nodes, pairs, width, percent, True)
    labels = C.components(edges)
    more = _left_over(nodes, stars, labels, percent)
    if not more.isEmpty():
        labels = C.components(edges.union(_edges(docs, nodes, more, width, percent, False)))
    reps = C.stored(nodes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id")))
    C.discard(docs.sparkSession, since, base, reps)
    whole = base.join(C.hinted(reps), ["h1", "h2"], "left")
    return whole.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component (the one with the least doc_id); all columns and rows without an id stay."""
    (own,) = C.fresh(docs, "linked_id")
    since = C.mark()
    found = link_documents(docs, width, percent)
    gone = C.stored(found.filter("doc_id != component_id").select(F.col("doc_id").alias(own)).distinct())
    C.discard(docs.sparkSession, since, gone)
    return docs.join(C.hinted(gone), docs["doc_id"].cast("long") == gone[own], "left_anti")
