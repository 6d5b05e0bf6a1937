"""Near-duplicate vectors by an inverted multi-index.

Vectors at unit length are cut into halves, each with a codebook of its own (k-means on a
bounded sample); a vector's cell is its pair of nearest codewords. The distance of a linked
vector is at most sqrt(2 - 2 t), and for another codeword a vector's half has a distance to the
border of that codeword's region. The multi-sequence traversal visits cells in order of the
sum of both squared distances and ends where that sum exceeds the squared distance of a link:
no linked vector lives beyond, so the recall reached is 1 for vectors of any kind. Both ends of a
link visit each other's cell, so a vector leaves out the cells numbered below its own. In the
cells visited it is compared with all inhabitants, exactly and in double precision.

A cell's inhabitants are dealt into blocks of about ``BLOCK``; visitors stream past a block. A
block does not pass on its pairs but each vector's number of links, and links that span
what is connected, so a large group of copies costs no table of pairs.

Equal vectors of a label are one class with a number of members from the start.

Defined results: a vector that is null, zero, of unusual length, or holds null or
non-finite components, and one with a null label, links with nothing; labels are compared as their
strings; rows that repeat an id count as one vector (that with the smallest bytes) and give a row
each; rows without id link with nothing, have a null component and are kept; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioline.llm.components import components
from folioline.llm.vectors import matrix, packed, sample, usual_length
from folioline.session import ship_package, written

#: Vectors that the codebooks are fitted on, at most, and for each codeword.
SAMPLE, PER_CODE = 20_000, 40
#: Vectors wanted in a cell.
OCCUPANCY = 64
MOST_CODES = 1024
#: Inhabitants of a block, and bytes of their vectors, at most about.
BLOCK, BLOCK_BYTES = 8192, 1 << 25
#: Visitors compared at once.
VISITORS = 256
ROUNDS = 12
#: Rounding of distances to borders.
SLACK = 1e-9


def _codebook(points: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Lloyd's k-means on the sample."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    codes = points[rng.permutation(len(points))[:size]]
    for _ in range(ROUNDS):
        near = _squared(points, codes).argmin(axis=1)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(codes))
        codes = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], codes)
    return np.unique(codes, axis=0)


def _squared(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ codes.T + (codes**2).sum(axis=1)[None, :]


def codes_for(rows: int) -> int:
    """Codewords of each half for so many vectors of a label."""
    return int(np.clip(np.ceil(np.sqrt(rows / OCCUPANCY)), 1, MOST_CODES))


class MultiIndex:
    def __init__(self, drawn: np.ndarray, size: int, threshold: float):
        unit = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
        self.half = drawn.shape[1] // 2
        self.books = [_codebook(unit[:, : self.half], size, 5), _codebook(unit[:, self.half :], size, 6)]
        self.limit = max(0.0, 2 - 2 * threshold) + SLACK

    def _borders(self, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest code, squared distance to the border of each code's region)"""
        squared = _squared(points, book)
        home = squared.argmin(axis=1)
        apart = np.sqrt(np.maximum(_squared(book, book), 1e-300))[home]
        gap = (squared - squared[np.arange(len(points)), home][:, None]) / (2 * apart)
        gap[np.arange(len(points)), home] = 0.0
        return home, np.maximum(gap, 0.0) ** 2

    def visits(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(home cell, cells visited in order of distance, home first) of each vector.

        Cells numbered below home are left out: their inhabitants come here.
        """
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        home1, gap1 = self._borders(unit[:, : self.half], self.books[0])
        home2, gap2 = self._borders(unit[:, self.half :], self.books[1])
        width, limit = len(self.books[1]), self.limit
        cells = []
        for i in range(len(vectors)):
            # Two sorted sequences; only their heads can be within the limit together.
            near1, near2 = np.flatnonzero(gap1[i] <= limit), np.flatnonzero(gap2[i] <= limit)
            total = gap1[i, near1][:, None] + gap2[i, near2][None, :]
            one, two = np.nonzero(total <= limit)
            order = np.argsort(total[one, two], kind="stable")
            found = (near1[one] * width + near2[two])[order]
            cells.append(found[found >= home1[i] * width + home2[i]])
        return home1 * width + home2, cells


_NAMES = ["label", "cell", "is_visit", "vec_id", "members", "home", "vector"]
_ROWS = "label string, cell long, is_visit int, vec_id long, members long, home long, vector binary"


def _cell_rows(index: MultiIndex, dimensions: int):
    """One row for a vector's home, and one for each cell that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                home, cells = index.visits(matrix(batch.column("vector"), dimensions))
                lengths = np.array([c.size for c in cells], dtype=np.int64)
                visiting = np.repeat(np.arange(len(home)), lengths)
                for row, cell, is_visit in ((np.arange(len(home)), home, 0), (visiting, np.concatenate(cells), 1)):
                    taken = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("label").take(taken), pa.array(cell.astype(np.int64)),
                            pa.array(np.full(row.size, is_visit, dtype=np.int32)), batch.column("vec_id").take(taken),
                            batch.column("members").take(taken), pa.array(home[row].astype(np.int64)),
                            batch.column("vector").take(taken),
                        ],
                        names=_NAMES,
                    )

    return run


def _spanning(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Links of stars with the same components as the links (left, right)."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: left.size], flat[left.size :]
    least = np.arange(nodes.size)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != np.arange(nodes.size))
    return np.stack([nodes[moved], nodes[least[moved]]], axis=1)


class _Block:
    """Inhabitants of a block."""

    def __init__(self, parts: list[pa.RecordBatch], dimensions: int, threshold: float):
        self.threshold = threshold
        self.ids, self.members, self.home = (
            np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("vec_id", "members", "home")
        )
        self.vectors = np.concatenate([matrix(p.column("vector"), dimensions) for p in parts])
        self.norms = np.linalg.norm(self.vectors, axis=1)

    def links(self, batch: pa.RecordBatch, dimensions: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, VISITORS):
            own = batch.slice(at, VISITORS)
            ids, members, home = (own.column(c).to_numpy() for c in ("vec_id", "members", "home"))
            vectors = matrix(own.column("vector"), dimensions)
            cosine = (vectors @ self.vectors.T) / (np.linalg.norm(vectors, axis=1)[:, None] * self.norms[None, :])
            visitor, other = np.nonzero(cosine >= self.threshold)
            keep = ids[visitor] != self.ids[other]
            visitor, other = visitor[keep], other[keep]
            # At home both visit each other. Elsewhere the inhabitant does not come to the visitor's home.
            alone = home[visitor] != self.home[other]
            found = np.concatenate([ids[visitor], self.ids[other[alone]]])
            number = np.concatenate([self.members[other], members[visitor[alone]]])
            nodes, flat = np.unique(found, return_inverse=True)
            counts = np.bincount(flat, weights=number, minlength=nodes.size).astype(np.int64)
            stars = _spanning(ids[visitor], self.ids[other])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([nodes, stars[:, 0]])),
                    pa.array(np.concatenate([counts, np.zeros(len(stars), np.int64)])),
                    pa.array([None] * nodes.size + stars[:, 1].tolist(), pa.int64()),
                ],
                names=["vec_id", "links", "linked"],
            )


def _linked(dimensions: int, threshold: float):
    """Rows sorted by block, inhabitants first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, waiting = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "block", "is_visit")])
            labels = batch.column("label").dictionary_encode()
            named = labels.indices.to_numpy()
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (named[1:] != named[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                here = (labels.dictionary[int(named[a])].as_py(), *keys[:2, a])
                if here != current:
                    current, block, waiting = here, None, []
                own = batch.slice(a, b - a)
                if not keys[2, a]:
                    waiting.append(own)
                elif waiting or block:
                    block = block or _Block(waiting, dimensions, threshold)
                    waiting = []
                    yield from block.links(own, dimensions)

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    ship_package(rows.sparkSession)
    every = written(packed(rows, "vec_id long, label string"), "vectors")
    size = usual_length(every)
    valid = every.where((F.length("vector") == size) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    one = valid.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("least")).select("vec_id", "least.*")
    classes = written(
        one.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("members")), "classes"
    )
    singles = classes.select("label", F.col("first").alias("vec_id"), "members", "vector")
    count, dimensions = singles.count(), size // 8
    if count and dimensions > 1:
        largest = singles.groupBy("label").count().agg(F.max("count")).first()[0]
        codes, most = codes_for(largest), max(64, min(BLOCK, BLOCK_BYTES // size))
        index = MultiIndex(sample(singles, min(SAMPLE, PER_CODE * codes), dimensions), codes, threshold)
        dealt = written(singles.mapInArrow(_cell_rows(index, dimensions), _ROWS), "cells")
        # A crowded cell has several blocks: an inhabitant lives in one, a visitor sees all.
        crowded = dealt.where("is_visit = 0").groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("blocks"))
        blocks = dealt.join(crowded, ["label", "cell"]).withColumn(
            "block",
            F.explode(F.expr(
                "if(is_visit = 1, sequence(0L, blocks - 1), array(pmod(xxhash64(vec_id), blocks)))"
            )),
        )
        found = written(
            blocks.select(*_NAMES, "block")
            .repartition("label", "cell", "block")
            .sortWithinPartitions("label", "cell", "block", "is_visit")
            .mapInArrow(_linked(dimensions, threshold), "vec_id long, links long, linked long"),
            "links",
        )
        links = found.where("linked IS NOT NULL")
        counts = found.where("linked IS NULL").groupBy("vec_id").agg(F.sum("links").alias("links"))
        component = components(links, "vec_id", "linked").withColumnRenamed("node", "first")
    else:
        counts = singles.select("vec_id", F.lit(0).cast("long").alias("links")).limit(0)
        component = singles.select(F.col("vec_id").alias("first"), F.col("vec_id").alias("component")).limit(0)
    placed = (
        classes.join(counts.withColumnRenamed("vec_id", "first"), "first", "left").join(component, "first", "left")
        .select(
            "label", "vector",
            (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"),
            F.coalesce("component", "first").alias("component"),
        )
    )
    members = one.join(placed, ["label", "vector"]).select("vec_id", "links", "component")
    return (
        every.select("vec_id").join(members, "vec_id", "left")
        .select(
            "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
