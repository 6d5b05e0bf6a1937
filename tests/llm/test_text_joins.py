"""Shingle join and window removal against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from folioline.llm import queries, shingle_join, substring_dedup
from folioline.llm.hashing import pieces, shingles, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string"


def made_documents():
    """Near copies around the threshold, exact copies, short, empty and null texts, a repeated row."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for edits in [0, 0, 1, 1, 2, 2, 3, 4, 5, 8] * 4:
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [f"{' '.join(rng.choice(vocabulary) for _ in range(n))}\n{passage}\t x{n}" for n in range(5, 45)]
    texts += [None, "", " \n ", "one", "One", "two words", "TWO words", "a a a a", "a " * 90, "É é", passage.upper()]
    rows = [(i * 3, t, "en", None, len(t or ""), "r", "s") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[41]]


def brute_classes(docs, percent, width):
    def grams(text):
        found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()

    sets = {row[0]: grams(row[1]) for row in docs}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in ids}


@pytest.mark.parametrize(("percent", "width"), [(90, 3), (80, 5)])
def test_classes_equal_brute_force(spark, percent, width):
    docs = made_documents()
    found = shingle_join.jaccard_classes(spark.createDataFrame(docs, SCHEMA), percent, width).collect()
    expected = brute_classes(docs, percent, width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert Counter(r.doc_id for r in found) == Counter(row[0] for row in docs)
    assert len({c for _, c in expected.values()}) < len(expected)


def test_small_blocks_and_stars_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 5)
    docs = made_documents()
    found = shingle_join.jaccard_classes(spark.createDataFrame(docs, SCHEMA), 90, 3).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: c for k, (_, c) in brute_classes(docs, 90, 3).items()}


@pytest.mark.parametrize(("percent", "width"), [(90, 3), (80, 5)])
def test_older_unlinked_near_copy_plus_equal_copies(spark, percent, width):
    """Equal texts link even where each of them first tries an older, not quite similar text."""
    rng = random.Random(7)
    docs = []
    for group in range(25):
        size = rng.randrange(95, 220)
        older = [f"g{group}x{i}" for i in range(size + width - 1)]
        added = size * (100 - percent) // percent + 1
        copy = older + [f"g{group}y{i}" for i in range(added)]
        texts = [" ".join(older), *[" ".join(copy)] * (2 + group % 3)]
        docs += [(100 * group + i, t, "en", None, len(t), "r", "s") for i, t in enumerate(texts)]
    expected = brute_classes(docs, percent, width)
    assert all(expected[100 * g][1] == 100 * g and expected[100 * g + 2][1] == 100 * g + 1 for g in range(25))
    found = shingle_join.jaccard_classes(spark.createDataFrame(docs, SCHEMA), percent, width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op2_ngram_jaccard_join(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_classes(rows, 90, 3)


def test_keep_first(spark):
    docs = made_documents()
    classes = brute_classes(docs, 90, 3)
    frame = spark.createDataFrame(docs, SCHEMA)
    kept = shingle_join.keep_first(frame, 90, 3)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, (_, c) in classes.items() if k == c}


def test_linked_sizes_share_a_segment():
    """Every pair of sets at the bound has an equal segment in a common band."""
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        bands = shingle_join.Bands(percent)
        for size in (9, 10, 14, 15, 22, 33, 34, 75, 300, 1200):
            common = rng.integers(0, 2**63, size, dtype=np.uint64)
            most = bands.difference(2 * size)
            extra = rng.integers(0, 2**63, most + 2, dtype=np.uint64)
            for own in range(most + 1):
                a = np.unique(np.concatenate([common[own:], extra[:own]]))
                b = np.unique(common)
                both = np.intersect1d(a, b).size
                if 100 * both < percent * (a.size + b.size - both) or (a == b).all():
                    continue
                sides = [np.concatenate([np.zeros(0, np.uint64), *shingle_join._signatures(x, x, bands)]) for x in (a, b)]
                # A document that leaves out its need - 1 most frequent ones keeps one of each partner's.
                band = bands.band(max(a.size, b.size))
                shared = [x for x in np.intersect1d(*sides) if int(x) & 3 == band & 3]
                segments = [shingle_join._cuts(x, bands.most[band] + 1 + bands.spare[band])[1].size for x in (a, b)]
                assert len(shared) >= max(bands.need(band, m) for m in segments) > 0


def test_parities_bound_the_difference():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 200, 250, 300, 510, 520, 9000, 15000)]
    sets += [np.union1d(x[: x.size // 2], rng.integers(0, 2**63, x.size // 2, dtype=np.uint64)) for x in sets]
    blobs = np.empty(len(sets), dtype=object)
    blobs[:] = [shingle_join._parities(x) for x in sets]
    parities = shingle_join.Parities(blobs)
    left, right = (x.reshape(-1) for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    found = parities.apart(left, right)
    for i, j, apart in zip(left, right, found, strict=True):
        assert apart <= np.setxor1d(sets[i], sets[j]).size
    assert (found > 100).sum() > 10


@pytest.mark.parametrize("size", [100, 400, 1600])
def test_pairs_of_a_large_group_grow_with_its_rows(spark, monkeypatch, size):
    """Near copies around the threshold, and texts that share only a passage with all of them."""
    rng = random.Random(size)
    base = [f"b{i}" for i in range(200)]
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for i in range(size):
        if i % 4:
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 8])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        else:
            own = [f"y{rng.randrange(10**9)}" for _ in range(90)] + passage + [f"z{rng.randrange(10**9)}" for _ in range(90)]
        docs.append((i, " ".join(own)))
    counted, plain = [], shingle_join._bounded
    monkeypatch.setattr(shingle_join, "_bounded", lambda pairs, *rest: counted.append(pairs.count()) or plain(pairs, *rest))
    found = shingle_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), 80, 5).collect()
    assert sum(counted) < 6 * size
    if size == 400:
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_classes(docs, 80, 5)


def brute_cut(docs, width):
    found = {row[0]: WORD.findall(row[1] or "") for row in docs}
    counts = Counter(
        tuple(w[i : i + width]) for row in docs for w in [found[row[0]]] for i in range(len(w) - width + 1)
    )
    out = {}
    for doc, w in found.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (len(w), len(gone), kept)
    return out


@pytest.mark.parametrize("width", [12, 35])
def test_cut_equals_brute_force(spark, width):
    docs = made_documents()
    frame = spark.createDataFrame(docs, SCHEMA)
    cut = substring_dedup.cut_repeats(frame, width)
    assert cut.columns == [*frame.columns, "n_words", "n_removed"]
    rows = cut.collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rows} == brute_cut(docs, width)
    assert len(rows) == len(docs)
    assert all((r.row, r.spans, r.source) == ("r", "s", None) for r in rows)


def test_cut_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = {
        k: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, (n, gone, kept) in brute_cut(rows, 35).items()
    }
    found = queries.op5_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == expected


def test_one_id_with_two_texts(spark):
    """Removal is by row, not by id; and a passage that only such rows share is repeated."""
    rng = random.Random(13)

    def words_of(n):
        return [f"q{rng.randrange(10**6)}" for _ in range(n)]

    passage = words_of(50)
    texts = [(1, words_of(200) + passage), (1, passage + words_of(3)), (1, words_of(12)), (2, words_of(91)), (3, words_of(40) + passage)]
    rows = [(i, " ".join(t), "", "", 0, "", "") for i, t in texts]
    found = substring_dedup.cut_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), 35).collect()
    want = [(i, len(t), 50 * (len(t) not in (12, 91)), " ".join(w for w in t if w not in passage)) for i, t in texts]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in found) == sorted(want)


def test_unchanged_texts_keep_their_layout(spark):
    docs = [(1, "a  b\n c ", "", "", 0, "", ""), (2, None, "", "", 0, "", ""), (3, "x " * 80, "", "", 0, "", "")]
    rows = substring_dedup.cut_repeats(spark.createDataFrame(docs, SCHEMA), 35, keep_layout=True).collect()
    assert {r.doc_id: r.text for r in rows} == {1: "a  b\n c ", 2: "", 3: ""}


def test_rows_without_id_stay(spark):
    rng = random.Random(11)
    first, second, third = (" ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(50)) for _ in range(3))
    texts = [(1, first), (2, first), (None, first), (None, second), (None, second), (None, third), (None, None), (4, "one  two")]
    docs = [(i, t, "en", "src1", len(t or ""), "r", "s") for i, t in texts]
    frame = spark.createDataFrame(docs, SCHEMA)
    found = shingle_join.jaccard_classes(frame, 90, 3).collect()
    assert Counter(map(tuple, found)) == Counter(
        [(1, 48, 1), (2, 48, 1), (4, 1, 4), *[(None, 48, None)] * 4, (None, 0, None)]
    )
    kept = shingle_join.keep_first(frame, 90, 3)
    assert kept.columns == frame.columns
    assert Counter(map(tuple, kept.collect())) == Counter(docs[:1] + docs[2:])
    cut = substring_dedup.cut_repeats(frame, 35, keep_layout=True).collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in cut) == Counter([
        (1, "", 50, 50), (2, "", 50, 50), *[(None, "", 50, 50)] * 3, (None, third, 50, 0), (None, "", 0, 0),
        (4, "one  two", 2, 0),
    ])
    mixed = corpus_pipeline.mix_sources(spark, frame.where("doc_id IS NULL AND text IS NOT NULL"), "").collect()
    assert mixed and all(r.doc_id is None for r in mixed)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shingle_join.jaccard_classes(empty).collect() == []
    assert substring_dedup.cut_repeats(empty).collect() == []


def test_words_and_shingles_across_pieces():
    import pyarrow as pa

    texts = ["a b", None, "", "  c\x0bd e  ", "é", "x" * 10]
    found = [(row, words(data, offsets)) for row, _, data, offsets in pieces(pa.array(texts))]
    assert sum(w.hashes.size for _, w in found) == 6
    own = found[0][1]
    assert list(np.diff(own.first)) == [2, 0, 0, 2, 1, 1]
    assert list(np.diff(shingles(own, 3)[1])) == [1, 0, 0, 1, 1, 1]
