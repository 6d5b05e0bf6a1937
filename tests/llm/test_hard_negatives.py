"""Hard negatives and the cover tree against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from folioline.llm import hard_negatives, queries
from folioline.llm.hard_negatives import Best, CoverTree, Sphere, descend

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, cell string, score string"
BIG = 2**63 - 1


def points_of(kind, rng, n=900, d=12):
    if kind == "spread":
        return rng.integers(-60, 60, (n, d))
    if kind == "crowds":
        centres = rng.integers(-200, 200, (12, d))
        return centres[rng.integers(0, 12, n)] + rng.integers(-6, 6, (n, d))
    if kind == "norms":
        return (rng.integers(-9, 9, (n, d)) * rng.integers(1, 90, (n, 1))).astype(int)
    return np.repeat(rng.integers(-30, 30, (3, d)), n // 3, axis=0)  # copies


@pytest.mark.parametrize("kind", ["spread", "crowds", "norms", "copies"])
def test_tree_covers_and_its_bounds_hold(kind):
    rng = np.random.default_rng(4)
    vectors = points_of(kind, rng).astype(float)
    sphere = Sphere(float(np.linalg.norm(vectors, axis=1).max()))
    ids = rng.permutation(len(vectors))
    tree = CoverTree.loads(CoverTree.build(ids, np.array(["a"] * len(ids)), vectors, sphere).dumps())
    assert sorted(tree.ids) == sorted(ids)
    anchors = np.concatenate([points_of("spread", rng, 20), np.zeros((1, 12))]).astype(float)
    _, least, greatest = sphere.bounds(*sphere.anchors(anchors), tree.centres, tree.cover)

    def below(node):
        inside = range(tree.first[node], tree.last[node])
        return list(inside) if tree.is_leaf[node] else [r for child in inside for r in below(child)]

    assert sorted(below(0)) == list(range(len(ids)))
    for node in range(len(tree.cover)):
        scores = anchors @ tree.vectors[below(node)].T
        assert (scores <= greatest[:, [node]]).all() and (scores >= least[:, [node]]).all()


@pytest.mark.parametrize("kind", ["spread", "crowds", "norms", "copies"])
def test_descent_finds_the_best_of_each_window(kind):
    rng = np.random.default_rng(5)
    vectors = points_of(kind, rng).astype(float)
    labels = rng.integers(0, 3, len(vectors)).astype(str)
    sphere = Sphere(float(np.linalg.norm(vectors, axis=1).max()))
    tree = CoverTree.build(np.arange(len(vectors)), labels, vectors, sphere)
    own = np.arange(0, 300, 10)
    low = rng.integers(-2000, 2000, (own.size, 3))
    high = low + rng.integers(-500, 4000, low.shape)
    low[:, 0], high[:, 0] = -BIG - 1, BIG
    for same in (True, False):
        best = Best(low, high, 4)
        descend(tree, sphere, own, labels[own], vectors[own], best, same)
        for i, anchor in enumerate(own):
            scores = (vectors @ vectors[anchor]).astype(int)
            fits = ((labels == labels[anchor]) == same) & (np.arange(len(vectors)) != anchor)
            for slot in range(3):
                rows = np.flatnonzero(fits & (scores >= low[i, slot]) & (scores <= high[i, slot]))
                want = sorted((-scores[r], r) for r in rows)[:4]
                has = best.found[i, slot]
                assert list(zip(-best.scores[i, slot][has], best.ids[i, slot][has], strict=True)) == want


def test_descent_skips_nodes():
    rng = np.random.default_rng(6)
    vectors = points_of("crowds", rng, 4000).astype(float)
    sphere = Sphere(float(np.linalg.norm(vectors, axis=1).max()))
    labels = np.array(["a"] * len(vectors))
    tree = CoverTree.build(np.arange(len(vectors)), labels, vectors, sphere)
    own = np.arange(50)
    best = Best(np.full((50, 1), -BIG - 1), np.full((50, 1), BIG), 5)
    verified = descend(tree, sphere, own, labels[own], vectors[own], best, True)
    assert verified < 0.5 * 50 * tree.is_leaf.sum()


def made_rows(big=False):
    rng = np.random.default_rng(7)
    vectors = points_of("crowds", rng, 700, 8) / 256 + rng.uniform(0, 0.003, (700, 8))
    vectors[100:220] = vectors[100]  # a crowd of copies
    rows = [(i, v.tolist(), int(rng.integers(0, 4)) if i % 3 else 1) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, None] * 4, [1.0, 2.0]]
    rows += [(1000 + 10 * i, v, 1) for i, v in enumerate(odd)]
    rows += [(None, [1.0] * 8, 1), (2000, [1.0] * 8, None), (2010, [0.5] * 8, 99), rows[10], rows[20]]
    if big:
        rows += [(3000, [1e30] + [0.0] * 7, 1), (3010, [3e15, 1.0] + [0.0] * 6, 2)]
    return [(*r, "v", "c", "s") for r in rows]


def by_hand(rows, every):
    own = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is not None and label is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all():
            own[vec_id] = ([int(np.floor(256 * float(np.float32(x)))) for x in v], label)
    found = []
    for anchor, (vector, label) in own.items():
        if anchor % every:
            continue
        scored = [
            (-max(-(2**63), min(BIG, sum(x * y for x, y in zip(vector, v, strict=True)))), i, other)
            for i, (v, other) in own.items() if i != anchor
        ]
        for minus, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            p = -minus
            inside = sorted(s for s in scored if s[2] != label and 50 * p <= -100 * s[0] <= 95 * p)
            found += [(anchor, positive, k + 1, i, p, -n) for k, (n, i, _) in enumerate(inside[:3])]
    return sorted(found)


@pytest.mark.parametrize("big", [False, True])
def test_mining_against_brute_force(spark, monkeypatch, big):
    monkeypatch.setattr(hard_negatives, "BLOCK", 100)  # several cells and blocks
    monkeypatch.setattr(hard_negatives, "ANCHORS", 15)  # copies of blocks
    rows = made_rows(big)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect()
    want = by_hand(rows, 10)
    assert len(want) > 300
    assert sorted(map(tuple, got)) == want


def test_empty_and_tiny_tables(spark):
    def mined(rows):
        return hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()

    assert mined([]) == []
    assert mined([(0, None, 1, "v", "c", "s")]) == []
    assert mined([(0, [1.0], 1, "v", "c", "s")]) == []
    zeros = mined([(i, [0.0, 0.0], i % 2, "v", "c", "s") for i in (0, 1, 2)])
    assert list(map(tuple, zeros)) == [(0, 2, 1, 1, 0, 0)]


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    query = queries.QUERIES["op11_hard_negatives"](spark, sf)
    assert differences(query, connect(sf), queries.ORACLES["op11_hard_negatives"]) == []
