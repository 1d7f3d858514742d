"""Hard negatives by an STR-packed R-tree over whole-number vectors.

Rows are dealt into parts by label, then by the coordinate that varies most, then
evenly: no label and no common vector can fill a part.  Inside a part each label has a tree of
its own, packed by sort-tile-recursive: rows are cut into slabs by one coordinate
after the other and then into leaves, and nodes hold the bounding boxes of runs of nodes below.
For an anchor a box gives, coordinate by coordinate, the least and greatest inner product that
a row in it can have.  A block of anchors searches a tree best first: a queue
hands out the box with the greatest bound, and drops anchors for which the box lies outside
their score window or strictly below their kth score (equal scores go on, as
the smaller id decides).

Anchors go to the parts that may answer them, and each part returns its first few
rows for each; these are merged.  Parts are streamed: a task holds the trees
of one part and a block of anchors.  Scores are exact, in doubles where they fit and in 64-bit
numbers else.

Defined results: rows with a null id or label, or a vector that is null or has a
null or non-finite entry, take no part, nor does a vector whose product with itself
does not fit a long; a shorter vector counts as filled up with zeros; repeated rows
are rows of their own (ties by id, then by row), so a repeated anchor is answered twice;
fewer rows than asked for are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from . import vectors as V

SCALE = 256
LEAF_ROWS, FAN_OUT, TILED_BY = 64, 16, 4
#: Rows of a part, at most about so many: what a task holds in trees.
PART_ROWS = 65_536
#: Anchors that search a tree together.
BLOCK = 256
NONE = -(1 << 63) + 1


def _bytes(column: list[np.ndarray]) -> pa.Array:
    return pa.array([c.tobytes() for c in column], pa.binary())


def cleaned(vectors: DataFrame, id: str, vector: str, label: Column, anchor: Column, scale: float) -> DataFrame:
    """Rows that take part: vec_id, label, anchor, x (whole numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, lengths, flat = V.whole(batch.column(3), scale)
            ends = np.cumsum(lengths)
            squares = np.concatenate([[0.0], np.cumsum(flat.astype(float) ** 2)])
            fits = squares[ends] - squares[ends - lengths] < 2.0**62
            rows = batch.select(["vec_id", "label", "anchor"]).filter(pa.array(good)).filter(pa.array(fits))
            yield pa.RecordBatch.from_arrays([*rows.columns, C.lists(flat[np.repeat(fits, lengths)], np.cumsum(lengths[fits]), pa.int64())], names=["vec_id", "label", "anchor", "x"])

    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("vector"))
    return rows.filter("vec_id is not null and label is not null").mapInArrow(run, "vec_id long, label long, anchor boolean, x array<long>")


def _spreads(rows: DataFrame) -> tuple[int, list[float]]:
    """(rows, variance of each coordinate), added up by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((2, 0))
        for batch in batches:
            _, lengths, flat = V.whole(batch.column(0), 1)
            x = V.padded(lengths, flat, int(lengths.max(initial=0))).astype(float)
            sums = np.pad(sums, ((0, 0), (0, max(0, x.shape[1] - sums.shape[1]))))
            n += len(x)
            sums[:, : x.shape[1]] += np.stack([x.sum(0), (x**2).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, sums.shape[1]), pa.int32()), pa.array([float(n), *sums[0]]), pa.array([0.0, *sums[1]])], names=["place", "total", "squares"])

    found = {r["place"]: r for r in rows.select("x").mapInArrow(run, "place int, total double, squares double").groupBy("place").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")).collect()}
    n = int(found.pop(-1)["total"]) if found else 0
    return n, [found[i]["squares"] / n - (found[i]["total"] / n) ** 2 for i in range(len(found))] if n else []


def tiles(x: np.ndarray, order: list[int], rows: np.ndarray, leaves: int) -> list[np.ndarray]:
    """Sort-tile-recursive: rows cut into slabs by the first coordinate, each of these by the next, into about `leaves` runs."""
    if leaves <= 1 or not order:
        return [rows[i : i + LEAF_ROWS] for i in range(0, len(rows), LEAF_ROWS)]
    slabs = int(np.ceil(leaves ** (1 / len(order))))
    size = -(-leaves // slabs) * LEAF_ROWS
    rows = rows[np.argsort(x[rows, order[0]], kind="stable")]
    return [leaf for i in range(0, len(rows), size) for leaf in tiles(x, order[1:], rows[i : i + size], -(-len(rows[i : i + size]) // LEAF_ROWS))]


LEAVES = "part int, label long, leaf int, vec_ids binary, rows binary, x binary"


def index(rows: DataFrame, width: int, order: list[int], parts: int) -> DataFrame:
    """The leaves of all trees, in the order in which boxes are run together; every row is in one leaf."""

    def packed(part: int, label: int, vec_ids: list, numbers: list, xs: list[np.ndarray]) -> pa.RecordBatch:
        x, ids, numbers = np.concatenate(xs), np.array(vec_ids, np.int64), np.array(numbers, np.int64)
        found = tiles(x, order[:TILED_BY], np.arange(len(x)), -(-len(x) // LEAF_ROWS))
        found = [leaf[np.lexsort((numbers[leaf], ids[leaf]))] for leaf in found]
        columns = [pa.array([part] * len(found), pa.int32()), pa.array([label] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, _bytes([ids[leaf] for leaf in found]), _bytes([numbers[leaf] for leaf in found]), _bytes([narrow(x[leaf]) for leaf in found])], names=[f.split()[0] for f in LEAVES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, label = TaskContext.get().partitionId(), ([], [], []), None
        for batch in batches:
            labels, ids, numbers = (batch.column(i).to_numpy() for i in range(3))
            _, lengths, flat = V.whole(batch.column(3), 1)
            x = V.padded(lengths, flat, width)
            turns = np.flatnonzero(np.diff(labels)) + 1
            for a, b in zip([0, *turns], [*turns, len(labels)], strict=True):
                if a == b:
                    continue
                if label is not None and labels[a] != label:
                    yield packed(part, label, *held)
                    held = ([], [], [])
                label = int(labels[a])
                held[0].extend(ids[a:b])
                held[1].extend(numbers[a:b])
                held[2].append(x[a:b])
        if held[0]:
            yield packed(part, label, *held)

    lead = F.coalesce(F.try_element_at("x", F.lit(order[0] + 1)), F.lit(0)) if order else F.lit(0)
    dealt = rows.select("label", "vec_id", "row", "x", lead.alias("lead"), F.xxhash64("row").alias("even")).repartitionByRange(parts, "label", "lead", "even").sortWithinPartitions("label")
    return dealt.select("label", "vec_id", "row", "x").mapInArrow(run, LEAVES)


def narrow(x: np.ndarray) -> np.ndarray:
    """Two bytes a number where they do."""
    return x.astype("<i2") if np.abs(x).max(initial=0) < 1 << 15 else x.astype("<i8")


class Tree:
    """Leaves of one label in a part, and the boxes over them, level by level up to one."""

    def __init__(self, width: int, leaves: list[tuple[bytes, bytes, bytes]]):
        self.leaves = []
        for ids, numbers, x in leaves:
            ids, numbers = np.frombuffer(ids, "<i8"), np.frombuffer(numbers, "<i8")
            flat = np.frombuffer(x, "<i2" if len(x) == 2 * width * len(ids) else "<i8")
            self.leaves.append((ids, numbers, flat.reshape(len(ids), width)))
        low, high = np.array([x.min(0) for *_, x in self.leaves], float), np.array([x.max(0) for *_, x in self.leaves], float)
        self.levels = [(low, high)]
        while len(low) > 1:
            cuts = np.arange(0, len(low), FAN_OUT)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((low, high))
        self.most = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))


class Block:
    """Anchors that search together: vectors, score windows, rows left out, and the first k found of each."""

    def __init__(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, without: np.ndarray, k: int):
        self.q, self.low, self.high, self.without, self.k = q, low, high, without, k
        self.up, self.down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
        self.scores = np.full((len(q), k), NONE, np.int64)
        self.ids, self.rows = np.full((len(q), k), (1 << 63) - 1, np.int64), np.zeros((len(q), k), np.int64)

    def open(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether what is under a bound can still be among the first k."""
        return (bounds >= self.low[at]) & (bounds >= self.scores[at, -1])

    def intervals(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with anything in each box."""
        up, down = self.up[at], self.down[at]
        least, greatest = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        if slack:
            by = slack * (np.abs(self.q[at]).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T) + 1
            least, greatest = least - by, greatest + by
        return least, greatest

    def search(self, tree: Tree, who: np.ndarray) -> None:
        """Best-first search of a tree by the anchors `who`."""
        if not len(who):
            return
        exact = self.q.shape[1] * max(1.0, float(np.abs(self.q).max())) * max(1.0, tree.most) < 2.0**53
        slack = 0.0 if exact else 1e-12
        queue: list = [(-np.inf, len(tree.levels) - 1, 0, who, np.full(len(who), np.inf))]
        while queue:
            _, level, node, at, bounds = heapq.heappop(queue)
            at = at[self.open(at, bounds)]
            if not len(at):
                continue
            if level == 0:
                self.take(tree.leaves[node], at, exact)
                continue
            low, high = (side[node * FAN_OUT : (node + 1) * FAN_OUT] for side in tree.levels[level - 1])
            least, greatest = self.intervals(at, low, high, slack)
            goes = (least <= self.high[at][:, None]) & (greatest >= np.maximum(self.low[at], self.scores[at, -1])[:, None])
            for i in np.flatnonzero(goes.any(0)):
                on = goes[:, i]
                heapq.heappush(queue, (-float(greatest[on, i].max()), level - 1, node * FAN_OUT + int(i), at[on], greatest[on, i]))

    def take(self, leaf: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, exact: bool) -> None:
        """Verify the rows of a leaf and keep each anchor's first k."""
        ids, numbers, x = leaf
        scores = (self.q[at].astype(float) @ x.T.astype(float)).astype(np.int64) if exact else self.q[at] @ x.T.astype(np.int64)
        good = (scores >= np.maximum(self.low[at], self.scores[at, -1])[:, None]) & (scores <= self.high[at][:, None]) & (numbers != self.without[at][:, None])
        some = good.any(1)
        at, scores, good = at[some], scores[some], good[some]
        if not len(at):
            return
        found = np.concatenate([self.scores[at], np.where(good, scores, NONE)], 1)
        names, rows = (np.concatenate([own[at], np.broadcast_to(new, scores.shape)], 1) for own, new in ((self.ids, ids), (self.rows, numbers)))
        first = np.lexsort((rows, names, -found), axis=-1)[:, : self.k]
        self.scores[at], self.ids[at], self.rows[at] = (np.take_along_axis(v, first, 1) for v in (found, names, rows))


FOUND = "query long, found_row long, found_id long, score long"


def searched(leaves: DataFrame, queries: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """First k rows of each query in each part: rows of its own label (not its own row), or of all other labels, with scores from low to high.

    queries: part, query, row, label, low, high, x.  Leaves and queries of a part meet in one task, the leaves first.
    """
    names = ["part", "kind", "label", "leaf", "vec_ids", "rows", "data", "query", "own", "low", "high"]
    trees = leaves.select("part", F.lit(0).alias("kind"), "label", "leaf", "vec_ids", "rows", F.col("x").alias("data"), *[F.lit(None).cast("long").alias(c) for c in names[7:]])
    asked = queries.select("part", F.lit(1).alias("kind"), "label", F.lit(None).cast("int").alias("leaf"), *[F.lit(None).cast("binary").alias(c) for c in names[4:6]], F.col("x").alias("data"), "query", F.col("row").alias("own"), "low", "high")
    both = trees.union(asked).repartition("part").sortWithinPartitions("part", "kind", "label", "leaf")

    def answer(trees: dict[int, Tree], held: list[tuple]) -> pa.RecordBatch:
        labels, data, query, own, low, high = (list(c) for c in zip(*held, strict=True))
        q = np.frombuffer(b"".join(data), "<i8").reshape(len(data), width)
        low, high = (np.array([(NONE if c is low else -NONE) if v is None else v for v in c], np.int64) for c in (low, high))
        block, label = Block(q, low, high, np.array(own, np.int64), k), np.array(labels, np.int64)
        for of, tree in trees.items():
            block.search(tree, np.flatnonzero((label == of) == same))
        there = block.scores > NONE
        at = np.nonzero(there)[0]
        return C.record(pa.schema([(f.split()[0], pa.int64()) for f in FOUND.split(", ")]), np.array(query, np.int64)[at], block.rows[there], block.ids[there], block.scores[there])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaves, trees, held = None, {}, None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(names))]
            for p, kind, label, _, ids, rows, data, *query in zip(*columns, strict=True):
                if p != part:
                    if held:
                        yield answer(trees, held)
                    part, leaves, trees, held = p, {}, None, []
                if kind == 0:
                    leaves.setdefault(label, []).append((ids, rows, data))
                    continue
                if trees is None:
                    trees, leaves = {of: Tree(width, found) for of, found in leaves.items()}, {}
                held.append((label, data, *query))
                if len(held) == BLOCK:
                    yield answer(trees, held)
                    held = []
        if held:
            yield answer(trees, held)

    return both.select(*names).mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of what the parts found for each query, numbered in column rank."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """Vectors as the bytes of `width` whole numbers."""
    names = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, flat = V.whole(batch.column(batch.schema.get_field_index("x")), 1)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, _bytes(list(V.padded(lengths, flat, width)))], names=[*names, "x"])

    return rows.select(*names, "x").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.select(*names).dtypes) + ", x binary")


def mine(vectors: DataFrame, anchor: Column, label: Column | str = "label", id: str = "vec_id", vector: str = "embedding", scale: float = SCALE, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, part_rows: int = PART_ROWS) -> DataFrame:
    """Per anchor and positive the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives are an anchor's first other rows of its label; negatives the first rows of other labels
    that score from low to high percent of the positive.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = C.stored(cleaned(vectors, id, vector, F.col(label) if isinstance(label, str) else label, anchor, scale).withColumn("row", F.monotonically_increasing_id()))
    n, spreads = _spreads(rows)
    if not n or not spreads:
        return spark.createDataFrame([], schema)
    width, order = len(spreads), sorted(range(len(spreads)), key=lambda i: -spreads[i])
    parts = max(-(-n // part_rows), min(spark.sparkContext.defaultParallelism, -(-n // 1024)))
    leaves = C.stored(index(rows, width, order, parts))
    places = C.stored(leaves.select("part", "label").distinct())
    anchors = C.stored(_packed(rows.filter("anchor").select("row", "vec_id", "label", "x"), width))
    nothing = F.lit(None).cast("long")
    asked = anchors.join(places, "label").select("part", F.col("row").alias("query"), "row", "label", nothing.alias("low"), nothing.alias("high"), "x")
    best = _first(searched(leaves, asked, width, positives, True), positives)
    best = C.stored(best.select(F.col("query").alias("row"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), F.monotonically_increasing_id().alias("query")))
    last = places.agg(F.max("part")).first()[0]
    score = F.col("positive_score").cast("decimal(25,0)")
    window = [F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high")]
    asked = best.join(anchors, "row").select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("part"), "query", "row", "label", *window, "x")
    found = _first(searched(leaves, asked.filter("low <= high"), width, negatives, False), negatives)
    named = best.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return found.join(named, "query").select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
