"""Hard negatives by exact inner-product search in cover trees.

*Norm augmentation.* With one more component, sqrt(M^2 - |x|^2) for the largest norm M, all
candidates lie on one sphere; an anchor, scaled to that sphere with 0 as its further component,
has its largest inner products where its angles are smallest. A node with a centre and
a covering angle then bounds the inner products of all points below it from both sides.

*Index.* Pivots, a farthest-first net of a bounded sample, cut the sphere into cells; every row
goes to its nearest pivot. A cell is dealt into blocks of about ``BLOCK`` rows, and a task builds a
cover tree over each: level by level, a node's points go to the nearest of centres that keep
apart, until these cover them at ``SHRINK`` times the radius (or there are ``FANOUT``); the covering
radius is measured, so the bounds hold for every tree.

*Search.* An anchor looks first in the blocks of its nearest cell, which gives it a lower limit,
then in the other cells that can still hold something. In a tree it descends best first: of
the nodes on its frontier the one with the best bound is opened next, nodes entirely outside
its windows of wanted scores, or below what it has found, are skipped, and leaves are
verified exactly. Anchors go through a tree in step. The positives are such a search
with an open window; each of them gives one window of the search for negatives.

Scores are integers, exact in double precision as long as squared norms are below 2**52, and
computed as Python integers beyond.

Defined results: rows with a null id, label or vector, a null or non-finite component, or a
vector of unusual length take no part; a zero vector does; rows that repeat an id count once
(the smallest label and vector); scores beyond a long are given as its limits; an anchor without
other rows of its label has no result, as has a positive whose window is empty (a score below
0); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioline.llm.vectors import matrix, sample
from folioline.session import ship_package, written

#: Vectors drawn for the net of pivots. They shape the cells; every row is in the index.
SAMPLE = 4000
MOST_CELLS = 1024
#: Rows of a block, and bytes of its vectors, at most about.
BLOCK, BLOCK_BYTES = 4096, 1 << 24
SHRINK, FANOUT, LEAF = 0.7, 16, 256
#: Anchors in step, nodes that each opens at a time, and anchors that one copy of a block serves.
TOGETHER, OPENED, ANCHORS = 1024, 8, 100_000
#: Rounding of angles, as a part of the product of both norms.
SLACK = 1e-6
_EXACT = 2.0**52
_LOW, _HIGH = -(2**63), 2**63 - 1


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part: float64 bytes of floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy())) if len(lists) else np.zeros(0, np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(scale * flat)
            whole = np.isfinite(flat) & np.isfinite(scaled)
            starts = np.concatenate([[0], ends[:-1]]) if ends.size else ends
            blobs = [
                scaled[a:b].tobytes() if b > a and whole[a:b].all() else None for a, b in zip(starts, ends, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(blobs, pa.binary())],
                names=["vec_id", "label", "vector"],
            )

    wide = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return wide.mapInArrow(run, "vec_id long, label string, vector binary").where("vector IS NOT NULL")


class Sphere:
    """Norm-augmented directions and the bounds that follow from angles."""

    def __init__(self, largest: float):
        self.largest = largest

    def points(self, vectors: np.ndarray) -> np.ndarray:
        if not self.largest:
            return np.concatenate([vectors, np.ones((len(vectors), 1))], axis=1)
        unit = vectors / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit**2).sum(axis=1)))
        return np.concatenate([unit, rest[:, None]], axis=1)

    def anchors(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.linalg.norm(vectors, axis=1)
        unit = vectors / np.where(norms > 0, norms, 1.0)[:, None]
        return np.concatenate([unit, np.zeros((len(vectors), 1))], axis=1), norms

    def bounds(self, directions: np.ndarray, norms: np.ndarray, centres: np.ndarray, cover: np.ndarray):
        """(angle, least, greatest inner product) of each anchor with all points of each node."""
        angle = np.arccos(np.clip(directions @ centres.T, -1.0, 1.0))
        reach = norms[:, None] * self.largest
        least = reach * (np.cos(np.minimum(np.pi, angle + cover)) - SLACK)
        greatest = reach * (np.cos(np.maximum(0.0, angle - cover)) + SLACK)
        # As scores are, kept within a long.
        return angle, np.clip(least, -(2.0**63), 2.0**63), np.clip(greatest, -(2.0**63), 2.0**63)


def _angle(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ centre, -1.0, 1.0))


def net(points: np.ndarray, most: int, reach: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, each point's centre, its angle): farthest first, until all are within ``reach``."""
    centres = [0]
    nearest, away = np.zeros(len(points), dtype=np.int64), _angle(points, points[0])
    while len(centres) < most:
        far = int(away.argmax())
        if away[far] <= reach or far in centres:
            break
        own = _angle(points, points[far])
        nearer = own < away
        nearest[nearer], away = len(centres), np.minimum(own, away)
        centres.append(far)
    return np.array(centres), nearest, away


class CoverTree:
    """Nodes by level, children and rows of a node side by side."""

    FIELDS = ("ids", "labels", "vectors", "centres", "cover", "first", "last", "is_leaf")

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, sphere: Sphere) -> CoverTree:
        points = sphere.points(vectors)
        root = int(_angle(points, points.mean(axis=0)).argmin())
        own = np.argsort(ids)
        level = [(own, points[root])]
        centres, cover, first, last, is_leaf, order, placed, made = [], [], [], [], [], [], 0, 1
        while level:
            below = []
            for rows, centre in level:
                angles = _angle(points[rows], centre)
                radius = float(angles.max())
                centres.append(centre)
                cover.append(radius)
                if rows.size <= LEAF:
                    parts = []
                else:
                    chosen, nearest, _ = net(points[rows], FANOUT, SHRINK * radius)
                    parts = [(rows[nearest == i], points[rows[c]]) for i, c in enumerate(chosen) if (nearest == i).any()]
                    if len(parts) == 1:  # equal directions: slices in the order of ids
                        size = max(LEAF, -(-rows.size // FANOUT))
                        parts = [(rows[i : i + size], centre) for i in range(0, rows.size, size)]
                is_leaf.append(not parts)
                if parts:
                    first.append(made)
                    made += len(parts)
                    last.append(made)
                    below += parts
                else:
                    first.append(placed)
                    order.append(rows)
                    placed += rows.size
                    last.append(placed)
            level = below
        taken = np.concatenate(order)
        tree = cls()
        tree.ids, tree.labels, tree.vectors = ids[taken], labels[taken], vectors[taken]
        tree.centres, tree.cover = np.stack(centres), np.array(cover)
        tree.first, tree.last, tree.is_leaf = np.array(first), np.array(last), np.array(is_leaf)
        return tree

    def dumps(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, **{f: getattr(self, f) for f in self.FIELDS})
        return held.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> CoverTree:
        tree = cls()
        with np.load(io.BytesIO(data)) as held:
            for f in cls.FIELDS:
                setattr(tree, f, held[f])
        return tree


def inner(vectors: np.ndarray, anchors: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products (rows: anchors) as longs."""
    if exact:
        return (anchors @ vectors.T).astype(np.int64)
    whole = [[int(x) for x in v] for v in vectors]
    wide = [[int(x) for x in a] for a in anchors]
    found = [[max(_LOW, min(_HIGH, sum(x * y for x, y in zip(a, v, strict=True)))) for v in whole] for a in wide]
    return np.array(found, dtype=np.int64).reshape(len(anchors), len(vectors))


class Best:
    """The best rows found so far, for each window of each anchor."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), _LOW, dtype=np.int64)
        self.ids = np.full((*low.shape, k), _HIGH, dtype=np.int64)
        self.found = np.zeros((*low.shape, k), dtype=bool)

    def floor(self) -> np.ndarray:
        """What a row must score to count: the window's limit, or the k-th found."""
        return np.where(self.found[:, :, -1], np.maximum(self.low, self.scores[:, :, -1]), self.low)

    def take(self, anchors: np.ndarray, floor: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Scores of some rows (columns) for some anchors; ``fits`` is what their labels allow."""
        slots = self.low.shape[1]
        at, slot, row = np.nonzero(
            fits[:, None, :] & (scores[:, None, :] >= floor[:, :, None]) & (scores[:, None, :] <= self.high[anchors][:, :, None])
        )
        if not at.size:
            return
        key = anchors[at] * slots + slot
        keys = np.unique(key)
        flat = [x.reshape(-1, self.k) for x in (self.scores, self.ids, self.found)]
        has = flat[2][keys]
        key = np.concatenate([np.repeat(keys, self.k)[has.reshape(-1)], key])
        score = np.concatenate([flat[0][keys][has], scores[at, row]])
        name = np.concatenate([flat[1][keys][has], ids[row]])
        # ~score falls as the score rises, without overflow.
        order = np.lexsort((name, ~score, key))
        key, score, name = key[order], score[order], name[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        place = np.arange(key.size) - np.repeat(head, np.diff(np.concatenate([head, [key.size]])))
        kept = place < self.k
        for held, new in zip(flat, (score[kept], name[kept], True), strict=True):
            held[key[kept], place[kept]] = new


def descend(tree: CoverTree, sphere: Sphere, ids, labels, vectors, best: Best, same: bool) -> int:
    """Best-first search of a tree by some anchors in step; the number of leaves verified.

    An anchor opens its best node, then its two best, and so on up to ``OPENED`` at a time.
    """
    directions, norms = sphere.anchors(vectors)
    _, least, greatest = sphere.bounds(directions, norms, tree.centres, tree.cover)
    exact = sphere.largest**2 < _EXACT
    everyone = np.arange(len(ids))
    # What an anchor can hope for in a node of its frontier; the root first.
    hope = np.full(greatest.shape, -np.inf)
    hope[:, 0] = greatest[:, 0]
    verified, width = 0, 1
    while everyone.size:
        many = min(width, hope.shape[1])
        width = min(2 * width, OPENED)
        node = np.argpartition(-hope[everyone], many - 1, axis=1)[:, :many]
        top = np.take_along_axis(hope[everyone], node, axis=1)
        going = top > -np.inf
        floor = best.floor()
        shown = floor[everyone][:, None, :]
        wanted = going & (
            (np.take_along_axis(greatest[everyone], node, axis=1)[:, :, None] >= shown)
            & (np.take_along_axis(least[everyone], node, axis=1)[:, :, None] <= best.high[everyone][:, None, :])
            & (shown <= best.high[everyone][:, None, :])
        ).any(axis=2)
        hope[np.repeat(everyone, many), node.reshape(-1)] = -np.inf
        row, place = np.nonzero(wanted)
        anchor, node = everyone[row], node[row, place]
        for at in np.unique(node):
            rows, inside = anchor[node == at], slice(tree.first[at], tree.last[at])
            if not tree.is_leaf[at]:
                hope[rows, inside] = np.minimum(greatest[rows, inside], greatest[rows, at][:, None])
                continue
            verified += rows.size
            scores = inner(tree.vectors[inside], vectors[rows], exact)
            fits = (tree.labels[inside][None, :] == labels[rows][:, None]) == same
            fits &= tree.ids[inside][None, :] != ids[rows][:, None]
            best.take(rows, floor[rows], scores, tree.ids[inside], fits)
        everyone = everyone[going.all(axis=1) | (hope[everyone] > -np.inf).any(axis=1)]
    return verified


_ANCHOR = "anchor_id long, label string, vector binary, low array<long>, high array<long>"
_STREAM = ["cell", "block", "copy", "tree", "anchor_id", "label", "vector", "low", "high"]


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lows, highs = batch.column("low").to_pylist(), batch.column("high").to_pylist()
    width = max(map(len, lows), default=0)
    # A missing window is an empty one.
    return (
        np.array([x + [_HIGH] * (width - len(x)) for x in lows], dtype=np.int64).reshape(len(lows), width),
        np.array([x + [_LOW] * (width - len(x)) for x in highs], dtype=np.int64).reshape(len(highs), width),
    )


class Index:
    """Cover trees over all rows of (vec_id, label, vector), by cell and block."""

    def __init__(self, rows: DataFrame, dimensions: int):
        self.dimensions = dimensions
        count, squared = rows.select(
            F.count(F.lit(1)), F.max(F.expr("norm"))
        ).first()
        self.sphere = Sphere(float(squared) * (1 + 1e-12))
        drawn = sample(rows, SAMPLE, dimensions)
        points = self.sphere.points(drawn)
        wanted = max(1, min(MOST_CELLS, -(-count // BLOCK), len(points)))
        self.pivots = points[net(points, wanted)[0]]
        dealt = written(rows.drop("norm").mapInArrow(self._cells(), "cell int, away double, vec_id long, label string, vector binary"), "dealt")
        # One row a cell, of at most MOST_CELLS.
        size = min(BLOCK, max(64, BLOCK_BYTES // (8 * dimensions)))
        cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("cover")).collect()
        self.blocks = {c["cell"]: -(-c["n"] // size) for c in cells}
        self.cells = np.array(sorted(self.blocks), dtype=np.int64)
        self.cover = np.array([c["cover"] for c in sorted(cells, key=lambda c: c["cell"])])
        spark = rows.sparkSession
        self.layout = spark.createDataFrame(list(self.blocks.items()), "cell int, blocks long")
        self.trees = written(
            dealt.join(F.broadcast(self.layout), "cell")
            .withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
            .groupBy("cell", "block").applyInArrow(self._build(), "cell int, block long, tree binary"),
            "trees",
        )

    def _cells(self):
        sphere, pivots, dimensions = self.sphere, self.pivots, self.dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    batch = whole.slice(at, 4096)
                    points = sphere.points(matrix(batch.column("vector"), dimensions))
                    angle = np.arccos(np.clip(points @ pivots.T, -1.0, 1.0))
                    cell = angle.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell]),
                            *[batch.column(c) for c in ("vec_id", "label", "vector")],
                        ],
                        names=["cell", "away", "vec_id", "label", "vector"],
                    )

        return run

    def _build(self):
        sphere, dimensions = self.sphere, self.dimensions

        def build(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            vectors = np.concatenate([matrix(c, dimensions) for c in rows.column("vector").chunks])
            tree = CoverTree.build(
                rows.column("vec_id").to_numpy(), np.array(rows.column("label").to_pylist(), dtype=str), vectors, sphere
            )
            return pa.table({
                "cell": rows.column("cell").slice(0, 1), "block": rows.column("block").slice(0, 1),
                "tree": pa.array([tree.dumps()], pa.binary()),
            })

        return build

    def _homes(self):
        """The nearest cell of each anchor, settled once: a second look could break a tie otherwise."""
        sphere, centres, cells, dimensions = self.sphere, self.pivots[self.cells], self.cells, self.dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                directions, _ = sphere.anchors(matrix(batch.column("vector"), dimensions))
                home = cells[(directions @ centres.T).argmax(axis=1)]
                yield batch.append_column("home", pa.array(home.astype(np.int32)))

        return run

    def _others(self):
        """The cells that an anchor's windows reach, but for its home."""
        sphere, centres, cover, cells = self.sphere, self.pivots[self.cells], self.cover, self.cells
        dimensions = self.dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, TOGETHER):
                    batch = whole.slice(at, TOGETHER)
                    low, high = _windows(batch)
                    directions, norms = sphere.anchors(matrix(batch.column("vector"), dimensions))
                    _, least, greatest = sphere.bounds(directions, norms, centres, cover)
                    wanted = np.zeros(least.shape, dtype=bool)
                    for slot in range(low.shape[1]):
                        reached = (greatest >= low[:, [slot]]) & (least <= high[:, [slot]])
                        wanted |= reached & (low[:, [slot]] <= high[:, [slot]])
                    wanted &= cells[None, :] != batch.column("home").to_numpy()[:, None]
                    anchor, cell = np.nonzero(wanted)
                    taken = batch.drop_columns(["home"]).take(pa.array(anchor))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[cell].astype(np.int32)), *taken.columns], names=["cell", *taken.schema.names]
                    )

        return run

    def _searched(self, k: int, same: bool):
        sphere, dimensions = self.sphere, self.dimensions

        def found(tree: CoverTree, batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("anchor_id").to_numpy()
            labels = np.array(batch.column("label").to_pylist(), dtype=str)
            low, high = _windows(batch)
            best = Best(low, high, k)
            descend(tree, sphere, ids, labels, matrix(batch.column("vector"), dimensions), best, same)
            anchor, slot, place = np.nonzero(best.found)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[anchor]), pa.array(slot.astype(np.int32)),
                    pa.array(best.ids[anchor, slot, place]), pa.array(best.scores[anchor, slot, place]),
                ],
                names=["anchor_id", "slot", "vec_id", "score"],
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for batch in batches:
                is_tree = batch.column("tree").is_valid().to_numpy(zero_copy_only=False)
                cuts = [*np.flatnonzero(is_tree).tolist(), batch.num_rows]
                for at in range(0, cuts[0], TOGETHER):  # anchors of the tree before
                    yield found(tree, batch.slice(at, min(TOGETHER, cuts[0] - at)))
                for a, b in zip(cuts, cuts[1:], strict=False):
                    tree = CoverTree.loads(batch.column("tree")[a].as_py())
                    for at in range(a + 1, b, TOGETHER):
                        yield found(tree, batch.slice(at, min(TOGETHER, b - at)))

        return run

    def _visit(self, routed: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, slot, vec_id, score): the best of each block of the cells that anchors visit."""
        # A cell that very many anchors visit has copies of its blocks, each for some of them.
        copies = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("copies"))
        copies = written(copies.join(F.broadcast(self.layout), "cell"), "copies")
        held = F.broadcast(copies)  # a row a cell, MOST_CELLS at most
        trees = self.trees.join(held, "cell").select(
            "cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "tree"
        )
        visitors = routed.join(held, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("anchor_id"), "copies").alias("copy"), *[c.split()[0] for c in _ANCHOR.split(", ")],
        )
        stream = visitors.unionByName(trees, allowMissingColumns=True).select(*_STREAM)
        return (
            stream.repartition("cell", "block", "copy")
            .sortWithinPartitions("cell", "block", "copy", F.col("tree").isNull())
            .mapInArrow(self._searched(k, same), "anchor_id long, slot int, vec_id long, score long")
        )

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, slot, rank, vec_id, score): the ``k`` best rows of each window of each anchor
        (anchor_id, label, vector, low, high), of its label or of others."""
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")

        def best(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        names = [c.split()[0] for c in _ANCHOR.split(", ")]
        placed = written(anchors.select(*names).mapInArrow(self._homes(), f"{_ANCHOR}, home int"), "anchors")
        first = written(best(self._visit(placed.select(F.col("home").alias("cell"), *names), k, same)), "found")
        # With k rows found, only what scores as much as the last of them is still wanted.
        floors = (
            first.groupBy("anchor_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
            .groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("floors"))
        )
        raised = placed.join(floors, "anchor_id", "left").withColumn(
            "low", F.transform("low", lambda x, i: F.greatest(x, F.try_element_at("floors", i)))
        )
        others = raised.select(*names, "home").mapInArrow(self._others(), f"cell int, {_ANCHOR}")
        rest = self._visit(written(others, "routed"), k, same)
        return best(first.drop("rank").unionByName(rest))


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its ``positives`` best rows of the same label, the
    ``negatives`` best rows of other labels that score from a half to 19 twentieths of the positive.
    """
    spark = rows.sparkSession
    ship_package(spark)
    given = integer_vectors(rows, scale)
    one = given.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("least")).select("vec_id", "least.*")
    one = written(one, "vectors")
    top = one.groupBy(F.length("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = top[0]["size"] if top else 8
    usual = one.where(F.length("vector") == size)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.linalg.norm(matrix(batch.column("vector"), size // 8), axis=1)
            yield batch.append_column("norm", pa.array(length))

    usual = usual.mapInArrow(norms, "vec_id long, label string, vector binary, norm double")
    if not top:
        return spark.createDataFrame([], _RESULT)
    index = Index(usual, size // 8)
    anchors = usual.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "vector")
    open_window = [F.array(F.lit(x).cast("long")).alias(n) for n, x in (("low", _LOW), ("high", _HIGH))]
    chosen = written(index.search(anchors.select("*", *open_window), positives, same=True), "positives")
    # 50 p <= 100 n <= 95 p in whole numbers, without the products.
    low, high = "score - score div 2", "score - (score div 20) - if(score % 20 > 0, 1, 0)"
    listed = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    windows = anchors.join(listed, "anchor_id").select(
        "anchor_id", "label", "vector",
        F.expr(f"transform(p.score, score -> if(score < 0, {_HIGH}, {low}))").alias("low"),
        F.expr(f"transform(p.score, score -> if(score < 0, {_LOW}, {high}))").alias("high"),
    )
    found = index.search(windows, negatives, same=False)
    return (
        found.select(
            "anchor_id", (F.col("slot") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"),
            F.col("score").alias("negative_score"),
        )
        .join(
            chosen.select(
                "anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                F.col("score").alias("positive_score"),
            ),
            ["anchor_id", "place"],
        )
        .select(*[c.split()[0] for c in _RESULT.split(", ")])
    )


_RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)
