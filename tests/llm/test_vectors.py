"""Nearest neighbours and near-duplicate vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioline.llm import embedding_dedup, neighbours, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, vector string, cell string"


def made_vectors(count=300, dimensions=16, scale=False):
    rng = np.random.default_rng(8)
    points = rng.standard_normal((count, dimensions)).astype(np.float32)
    points[40:120] = points[40] + 0.02 * rng.standard_normal((80, dimensions)).astype(np.float32)
    points[130:140] = points[130]
    if scale:
        points *= rng.uniform(0.2, 5, (count, 1)).astype(np.float32)
    rows = [(i, p.tolist(), i % 3 if i > 140 else 1, "v", "c") for i, p in enumerate(points)]
    odd = [None, [], [0.0] * dimensions, [float("nan")] * dimensions, [float("inf")] * dimensions, [1.0, None] * (dimensions // 2), [1.0, 2.0]]
    rows += [(1000 + 20 * i, v, 1, "v", "c") for i, v in enumerate(odd)]
    return [*rows, (2000, points[40].tolist(), None, "v", "c"), (None, points[41].tolist(), 1, "v", "c"), rows[45]]


def valid(rows, dimensions=16):
    found = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is not None and v and len(v) == dimensions and None not in v and np.isfinite(v).all() and any(v):
            found[vec_id] = (np.array(v, dtype=np.float32).astype(np.float64), label)
    return found


@pytest.mark.parametrize("scale", [False, True])
def test_nearest(spark, scale):
    rows = made_vectors(scale=scale)
    own = valid(rows)
    ids = np.array(sorted(own))
    matrix = np.stack([own[i][0] for i in ids])
    found = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=20).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {i for i in ids if i % 20 == 0}
    hits = total = 0
    for query, got in by_query.items():
        scores = matrix @ own[query][0]
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert all(abs(r.score - own[query][0] @ own[r.vec_id][0]) < 1e-9 for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        others = ids != query
        best = ids[others][np.lexsort((ids[others], -scores[others]))[:20]]
        hits += len({r.vec_id for r in got} & set(best.tolist()))
        total += 20
    assert hits >= 0.9 * total


def test_nearest_on_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found = {(r.query_id, r.vec_id) for r in queries.op7_nearest_neighbours(spark, SF).collect()}
    hits = []
    for query in np.flatnonzero(ids % 20 == 0):
        scores = matrix @ matrix[query]
        scores[query] = -np.inf
        hits += [(ids[query], ids[i]) in found for i in np.lexsort((ids, -scores))[:20]]
    assert np.mean(hits) >= 0.9


def test_few_candidates_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "", ""), (1, [1.0, 0.0], 1, "", ""), (2, [1.0, 0.0], 1, "", "")], SCHEMA)
    rows = neighbours.nearest(few, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(rows)] == [(1, 1, 1.0), (2, 2, 1.0)]
    assert neighbours.nearest(few.limit(0), F.col("vec_id") == 0).collect() == []


def brute_links(rows, threshold):
    own = valid(rows)
    ids = sorted(i for i in own if own[i][1] is not None)
    unit = {i: own[i][0] / np.linalg.norm(own[i][0]) for i in ids}
    links = {r[0]: set() for r in rows}
    for a in ids:
        for b in ids:
            if a != b and own[a][1] == own[b][1] and unit[a] @ unit[b] >= threshold:
                links[a].add(b)
    least = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for a, others in links.items():
            if not others:
                continue
            low = min([least[a], *[least[b] for b in others]])
            changed, least[a] = changed or low < least[a], low
    return {i: (len(links[i]), least[i], least[i] == i) for i in links}


@pytest.mark.parametrize("block", [2000, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "VISITORS", 50)
    monkeypatch.setattr(embedding_dedup, "OCCUPANCY", 8)
    rows = made_vectors()
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == brute_links(rows, 0.98)
    assert len(found) == len(rows)


@pytest.mark.parametrize(("rank", "dimensions"), [(3, 64), (4, 512), (3, 768), (3, 2048)])
def test_vectors_of_low_rank_lose_no_link(spark, monkeypatch, rank, dimensions):
    monkeypatch.setattr(embedding_dedup, "OCCUPANCY", 4)
    rng = np.random.default_rng(rank + dimensions)
    points = (rng.standard_normal((700, rank)) @ rng.standard_normal((rank, dimensions))).astype(np.float32)
    rows = [(i, p.tolist(), i % 2) for i, p in enumerate(points)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    unit = points.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    side = np.arange(700) % 2
    number = ((unit @ unit.T >= 0.98) & (side[:, None] == side[None, :])).sum(axis=1) - 1
    assert number.sum() > 300
    assert {r.vec_id: r.n_links for r in found.collect()} == dict(enumerate(number.tolist()))


def test_labels_of_other_types(spark):
    rows = [(0, [1.0, 0.0], 1.2), (1, [1.0, 0.01], 1.7), (2, [1.0, 0.02], 1.2), (3, [1.0, 0.0], None)]
    links = [1, 0, 1, 0]
    for kind, make in (("double", lambda x: x), ("string", lambda x: x and f"l{x}")):
        frame = spark.createDataFrame([(i, v, make(x)) for i, v, x in rows], f"vec_id long, embedding array<float>, label {kind}")
        found = embedding_dedup.near_duplicates(frame).collect()
        assert [r.n_links for r in sorted(found)] == links


def test_near_duplicates_on_embeddings(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = queries.op9_embedding_near_dedup(spark, SF).collect()
    ids = np.array([r[0] for r in rows])
    unit = np.array([r[1] for r in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    number = ((unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in found} == dict(zip(ids.tolist(), number.tolist(), strict=True))


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_duplicates(empty).collect() == []
