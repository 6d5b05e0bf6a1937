"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Nearest by inner product becomes nearest by distance: a row x gets the further component
sqrt(M^2 - |x|^2) with M the largest norm, a query 0.

Each of ``TABLES`` tables has some functions floor-like in (a . x + b) / w with Gaussian a; their
slots form the table's buckets. On a function's line a neighbour's place is normal, given the
query's: around c M / |q| times the query's own, with variance M^2 (1 - c^2), where c is the cosine
to the neighbour. So each bucket has a probability of holding it. A query visits a table's
buckets, its own and perturbed ones, in the order of that probability, until the tables together
reach ``TARGET`` for a k-th neighbour, a close one and one in between. The k-th neighbour's c is
measured within a bounded sample, where it is never nearer than in the whole table.

The candidates of all tables are scored exactly, in blocks of rows against at most
``BLOCK`` queries; each task passes on its best k of all buckets it has. Where the vectors are spread out evenly, near
and far differ little and many buckets are visited; that is in the nature of such data.

Defined results: vectors that are null, zero, of unusual length, or hold null or non-finite
components take no part; a query is no neighbour of itself, nor of a repeated row of its id; ties go to
the smaller id; with fewer candidates than k all are returned; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioline.llm.hashing import U64, mixed
from folioline.llm.vectors import matrix, packed, sample, usual_length
from folioline.session import ship_package, written

TABLES = 2
SLOTS = 4
TARGET = 0.96
#: Rows of the sample that gives the k-th neighbour's cosine.
SAMPLE = 4000
#: Rows wanted in a bucket: enough that scoring them outweighs sending a query there.
OCCUPANCY = 2000
BLOCK = 2000
#: Rows scored against a block at once, and rows of a table in one task's share.
SLICE, SHARE_ROWS = 1024, 50_000

_normal = np.vectorize(lambda x: 0.5 * (1.0 + erf(x / 2**0.5)), otypes=[np.float64])


class Hashing:
    """The functions of all tables for vectors of a dimension and a largest norm."""

    def __init__(self, dimensions: int, norm: float, rows: int, cosine: float):
        wanted = max(1.0, rows / OCCUPANCY)
        self.functions = int(np.clip(np.ceil(np.log(wanted) / np.log(SLOTS)), 2, 7))
        self.norm = norm
        self.cosines = (cosine, (1 + cosine) / 2, 0.98)
        self.width = 3.0 * norm / SLOTS
        rng = np.random.default_rng(97)
        self.lines = rng.standard_normal((TABLES, self.functions, dimensions + 1))
        self.shift = rng.uniform(-0.5, 0.5, (TABLES, self.functions)) * self.width
        #: Borders between slots; the outer slots have no outer border.
        self.borders = (np.arange(1, SLOTS) - SLOTS / 2) * self.width

    def project(self, vectors: np.ndarray, is_query: bool) -> np.ndarray:
        """(table, function, row)"""
        rest = self.norm**2 - (vectors**2).sum(axis=1)
        extra = np.zeros(len(vectors)) if is_query else np.sqrt(np.maximum(rest, 0.0))
        wide = np.concatenate([vectors, extra[:, None]], axis=1)
        return self.lines @ wide.T

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """(table, row): each row's bucket."""
        slots = np.searchsorted(
            self.borders, (self.project(vectors, is_query=False) + self.shift[:, :, None]).ravel(), side="right"
        )
        slots = slots.reshape(TABLES, self.functions, len(vectors))
        return (slots * SLOTS ** np.arange(self.functions)[None, :, None]).sum(axis=1)

    def probes(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each table (query row, bucket) in the order of visits."""
        at = self.project(queries, is_query=True) * self.norm / np.linalg.norm(queries, axis=1)
        share = 1.0 - (1.0 - TARGET) ** (1.0 / TABLES)
        found = []
        for table in range(TABLES):
            chances = [self._chance(at[table], table, c) for c in self.cosines]
            order = np.argsort(-sum(chances), axis=1, kind="stable")
            reached = np.min([np.cumsum(np.take_along_axis(c, order, axis=1), axis=1) for c in chances], axis=0)
            visits = np.minimum((reached < share).sum(axis=1) + 1, order.shape[1])
            row, nth = np.nonzero(np.arange(order.shape[1])[None, :] < visits[:, None])
            found.append((row, order[row, nth]))
        return found

    def _chance(self, at: np.ndarray, table: int, cosine: float) -> np.ndarray:
        """(query, bucket): the probability that a neighbour of this cosine is there."""
        spread = self.norm * max(1e-6, (1 - cosine**2) ** 0.5)
        chance = np.ones((at.shape[1], 1))
        for f in range(self.functions):
            place = cosine * at[f] + self.shift[table, f]
            upto = _normal((self.borders[None, :] - place[:, None]) / spread)
            slot = np.diff(upto, axis=1, prepend=0.0, append=1.0)
            # The first function is the lowest digit of the bucket's number.
            chance = (slot[:, :, None] * chance[:, None, :]).reshape(at.shape[1], -1)
        return chance


def _cosine(drawn: np.ndarray, norm: float, k: int) -> float:
    """Cosine, with the further component, that the k-th neighbours of three in four queries reach."""
    if len(drawn) < 2:
        return 0.0
    queries = drawn[:400]
    scores = queries @ drawn.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    at = max(1, scores.shape[1] - k)
    kth = np.partition(scores, at, axis=1)[:, at]
    return float(np.clip(np.quantile(kth / np.linalg.norm(queries, axis=1) / norm, 0.25), 0.0, 0.98))


_ROWS = "table_no int, bucket long, block int, is_row int, vec_id long, vector binary"
_NAMES = ["table_no", "bucket", "block", "is_row", "vec_id", "vector"]


def _bucket_rows(hashing: Hashing, dimensions: int, blocks: int, queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256 if queries else 4096):
                batch = whole.slice(at, 256 if queries else 4096)
                vectors = matrix(batch.column("vector"), dimensions)
                if queries:
                    found = hashing.probes(vectors)
                else:
                    found = [(np.arange(len(vectors)), b) for b in hashing.buckets(vectors)]
                for table, (row, bucket) in enumerate(found):
                    ids = batch.column("vec_id").to_numpy()[row]
                    # A query has one block, a row meets all blocks of queries.
                    block = [mixed(ids.view(U64), salt=4) % U64(blocks)] if queries else [np.full(row.size, b) for b in range(blocks)]
                    for own in block:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(row.size, table, dtype=np.int32)), pa.array(bucket.astype(np.int64)),
                                pa.array(own.astype(np.int32)), pa.array(np.full(row.size, int(not queries), dtype=np.int32)),
                                pa.array(ids), batch.column("vector").take(pa.array(row)),
                            ],
                            names=_NAMES,
                        )

    return run


class _Best:
    """The best k rows so far of each query of a block."""

    def __init__(self, k: int, dimensions: int):
        self.k = k
        self.row_of: dict[int, int] = {}
        self.vectors = np.zeros((0, dimensions))
        self.score = np.zeros((0, k))
        self.found = np.zeros((0, k), dtype=np.int64)
        self.here = np.zeros(0, dtype=np.int64)

    def visit(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """These queries look at the rows that follow."""
        ids, first = np.unique(ids, return_index=True)
        new = [i for i, query in enumerate(ids.tolist()) if query not in self.row_of]
        known = len(self.row_of)
        self.row_of.update((int(ids[i]), known + n) for n, i in enumerate(new))
        self.vectors = np.concatenate([self.vectors, vectors[first[new]]])
        self.score = np.concatenate([self.score, np.full((len(new), self.k), -np.inf)])
        self.found = np.concatenate([self.found, np.zeros((len(new), self.k), dtype=np.int64)])
        self.here = np.array([self.row_of[query] for query in ids.tolist()], dtype=np.int64)
        self.ids = ids

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.vectors[self.here] @ vectors.T
        scores[self.ids[:, None] == ids[None, :]] = -np.inf
        score = np.concatenate([self.score[self.here], scores], axis=1)
        found = np.concatenate([self.found[self.here], np.broadcast_to(ids, scores.shape)], axis=1)
        # Ties at the border stay in, so that the smaller id can win.
        border = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
        most = int((score >= border[:, None]).sum(axis=1).max(initial=self.k))
        top = np.argpartition(score, score.shape[1] - most, axis=1)[:, score.shape[1] - most :]
        score, found = np.take_along_axis(score, top, axis=1), np.take_along_axis(found, top, axis=1)
        order = np.lexsort((found, -score), axis=1)[:, : self.k]
        self.score[self.here] = np.take_along_axis(score, order, axis=1)
        self.found[self.here] = np.take_along_axis(found, order, axis=1)

    def rows(self) -> pa.RecordBatch:
        keep = np.isfinite(self.score)
        query = np.broadcast_to(np.array(list(self.row_of), dtype=np.int64)[:, None], self.score.shape)
        return pa.RecordBatch.from_arrays(
            [pa.array(query[keep]), pa.array(self.found[keep]), pa.array(self.score[keep])],
            names=["query_id", "vec_id", "score"],
        )


def _scored(dimensions: int, k: int):
    """Sorted by table, block, share and bucket, a bucket's queries before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = bucket = best = None
        waiting: list = []
        for batch in batches:
            keys = np.stack([
                batch.column(c).to_numpy().astype(np.int64) for c in ("table_no", "block", "share", "bucket", "is_row")
            ])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if tuple(keys[:3, a]) != group:
                    if best is not None:
                        yield best.rows()
                    group, bucket, best = tuple(keys[:3, a]), None, _Best(k, dimensions)
                if keys[3, a] != bucket:
                    bucket, waiting, visited = keys[3, a], [], False
                own = batch.slice(a, b - a)
                ids, vectors = own.column("vec_id").to_numpy(), matrix(own.column("vector"), dimensions)
                if not keys[4, a]:
                    waiting.append((ids, vectors))
                    continue
                if waiting:
                    best.visit(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                    waiting, visited = [], True
                if visited:
                    for at in range(0, ids.size, SLICE):
                        best.add(ids[at : at + SLICE], vectors[at : at + SLICE])
        if best is not None:
            yield best.rows()

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` rows with the largest inner product.

    ``rows`` has vec_id and embedding; ``is_query`` says of a vec_id whether it is a query.
    """
    ship_package(rows.sparkSession)
    vectors = written(packed(rows, "vec_id long").where("vector IS NOT NULL AND vec_id IS NOT NULL"), "vectors")
    size = usual_length(vectors)
    vectors = vectors.where(F.length("vector") == size)
    dimensions = size // 8
    drawn = sample(vectors, SAMPLE, dimensions) if size else np.zeros((0, 0))
    norms = vectors.mapInArrow(_norm_rows(dimensions), "norm double, n long").agg(F.max("norm"), F.sum("n")).first()
    norm, count = norms[0] or 1.0, norms[1] or 0
    hashing = Hashing(dimensions, norm, count, _cosine(drawn, norm, k))
    queries = vectors.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK))
    dealt = vectors.mapInArrow(_bucket_rows(hashing, dimensions, blocks, queries=False), _ROWS).unionByName(
        queries.mapInArrow(_bucket_rows(hashing, dimensions, blocks, queries=True), _ROWS)
    )
    # A task has a share of a table's buckets, and passes on one list per query for all of them.
    shares = max(4, -(-count // SHARE_ROWS))
    scored = (
        dealt.withColumn("share", F.pmod(F.xxhash64("bucket"), F.lit(shares)))
        .repartition("table_no", "block", "share")
        .sortWithinPartitions("table_no", "block", "share", "bucket", "is_row")
        .mapInArrow(_scored(dimensions, k), "query_id long, vec_id long, score double")
    )
    # A candidate that several tables give counts once.
    once = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _norm_rows(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = np.linalg.norm(matrix(batch.column("vector"), dimensions), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(norms.max(initial=0.0))]), pa.array([norms.size])], names=["norm", "n"]
            )

    return run
