"""Token budgets, selection, tokenising and packing."""

import random
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioline.llm import mixing, packing, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, differences  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, domain string, lang string, source string, budget long, epoch string"


def test_mixing_matches_sql(spark):
    assert differences(queries.op3_source_mixing(spark, SF), connect(SF), queries.ORACLES["op3_source_mixing"]) == []


def made_documents():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        domain = rng.choice(["a", "a", "b", None])
        source = "big" if domain == "a" and rng.random() < 0.6 else rng.choice(["s1", "s2", None])
        text = rng.choice([None, "", "w " * rng.randrange(1, 60)]) if i % 7 == 0 else "w " * rng.randrange(1, 60)
        rows.append((i, text, domain, rng.choice(["x", "y"]), source, 1, "e"))
    return [*rows, rows[9]]


MIX = mixing.Mix(
    weights={"domain": {"a": 1, "b": 9}, "lang": {"x": 3}, "source": {"s1": 0}}, share=(7, 10), max_epochs=2
)


def by_hand_budgets(leaves):
    """Shares dealt top-down; what a child cannot hold is dealt again among its siblings."""

    def weight(level, value):
        return MIX.weights[level].get(value, MIX.default_weight)

    def deal(amount, children):
        """children: name -> (weight, capacity)"""
        given, open_names = {n: 0 for n in children}, {n for n, (w, _) in children.items() if w}
        rest = amount
        while open_names:
            total = sum(children[n][0] for n in open_names)
            full = {n for n in open_names if children[n][1] * total <= rest * children[n][0]}
            if not full:
                for n in open_names:
                    given[n] = min(children[n][1], rest * children[n][0] // total)
                break
            for n in full:
                given[n] = children[n][1]
            rest -= sum(given[n] for n in full)
            open_names -= full
        return given

    def capacity(prefix):
        return sum(
            t * MIX.max_epochs for leaf, t in leaves.items()
            if leaf[: len(prefix)] == prefix and all(map(weight, MIX.levels, leaf))
        )

    budgets = {(): min(sum(leaves.values()) * MIX.share[0] // MIX.share[1], capacity(()))}
    for depth, level in enumerate(MIX.levels):
        made = {}
        for prefix, amount in budgets.items():
            names = {leaf[: depth + 1] for leaf in leaves if leaf[:depth] == prefix}
            made |= deal(amount, {n: (weight(level, n[-1]), capacity(n)) for n in names})
        budgets = made
    return budgets


def test_budgets_and_prefixes(spark):
    docs = made_documents()
    leaves = Counter()
    for _, text, *leaf in docs:
        leaves[tuple(leaf[:3])] += len((text or "").split())
    frame = spark.createDataFrame(docs, SCHEMA)
    table = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    budgets = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(table, MIX).collect()}
    assert budgets == by_hand_budgets(leaves)
    # What one domain cannot hold goes to the others.
    wanted = sum(leaves.values()) * 7 // 10
    assert wanted - 20 < sum(budgets.values()) <= wanted
    rows = mixing.select_mix(frame, MIX).collect()
    taken = Counter()
    by_leaf = defaultdict(list)
    for r in rows:
        leaf = (r.domain, r.lang, r.source)
        taken[leaf] += r.taken
        by_leaf[leaf].append(r)
        assert r.start == 0 or r.start < budgets[leaf]
    assert taken == Counter({k: v for k, v in budgets.items() if v})
    sizes = {row[0]: len((row[1] or "").split()) for row in docs}
    for leaf, chosen in by_leaf.items():
        chosen.sort(key=lambda r: (r.epoch, r.start))
        assert all(r.n_tokens == sizes[r.doc_id] and 0 <= r.epoch < 2 for r in chosen)
        full = [r for r in chosen if r.taken < r.n_tokens]
        assert len(full) <= 1 and all(r.start + r.taken == budgets[leaf] for r in full)


def test_empty_mix(spark):
    assert mixing.select_mix(spark.createDataFrame([], SCHEMA), MIX).collect() == []


TEXTS = [
    None, "", " ", "\n\n", "a", " a", "a ", "It's  they'll\twe've\r\n x", "naïve Äöß 東京 2024年", "x y z w 　v",
    "<|endoftext|>", "so <|endoftext|> it goes<|endoftext|> on", "…“quoted” — dash", "1234567 89,0.1!!! ###", "\x1c\x1f\x85x\x0b\x0c",
    "emoji 👩‍👩‍👧 \U0001f680 ​ zero", "tail \n", "a b   c", "'s 't 're",
]


@cache
def tokenizer_of(path):
    return Tokenizer.from_file(path)


def ids_of(text):
    encoded = tokenizer_of(queries.TOKENIZER).encode(text or "", add_special_tokens=False).ids
    return np.array([*encoded, 0], dtype="<u4")


@pytest.mark.parametrize("ranks", [None, queries.RANKS])
def test_stretches_give_the_tokenizers_ids(ranks):
    import pyarrow as pa

    from folioline.llm.hashing import pieces

    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("ab 's\n\t é9!<|>") for _ in range(40)) for _ in range(200)]
    tokenizer = packing.StretchTokenizer(queries.TOKENIZER, ranks)
    for _ in range(2):
        for row, end, data, offsets in pieces(pa.array(texts)):
            ids, bounds = tokenizer(data, offsets)
            for i in range(row, end):
                assert ids[bounds[i - row] : bounds[i - row + 1]].tolist() == ids_of(texts[i])[:-1].tolist(), texts[i]


def check_packing(rows, docs, size=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = Counter(doc for doc, _ in docs)
    assert set(pieces) == set(copies)
    for doc, text in dict(docs).items():
        own = ids_of(text)
        found = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc])
        first = (own.size - 1) % size + 1
        cuts = [0, *range(first, own.size + 1, size)]
        expected = [(k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert found == sorted(expected * copies[doc])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_packing(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "long text " * 3000), (101, "b " * 2047), (102, "b " * 2048), (None, "x"), (5, " a")]
    frame = spark.createDataFrame([(i, t, "p", "s") for i, t in docs], "doc_id long, text string, piece string, start string")
    rows = packing.pack(frame, queries.TOKENIZER, ranks_path=queries.RANKS).collect()
    check_packing(rows, docs)


def test_packing_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op8_best_fit_packing(spark, SF).collect()
    total = sum(ids_of(t).size for _, t in docs)
    assert check_packing(rows, docs) <= -(-total // 2048) * 1.02 + 1


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), queries.TOKENIZER).collect() == []


@pytest.mark.parametrize("rule", ["norm", "product"])
def test_every_capacity_holds(rule):
    rng = random.Random(9)
    counts = Counter(rng.choice([1, 3, 7, 20, 50, 64, 99]) for _ in range(3000))
    capacity = packing.Capacity(tokens=100, documents=9, attention=5200, rule=rule)
    with pytest.raises(ValueError):
        packing.plan(counts, capacity)
    del counts[99]
    loads = defaultdict(list)
    placed = Counter()
    for length, first, number, sequence, offset in packing.plan(counts, capacity):
        placed[length] += number
        for k in range(number):
            loads[sequence + k].append((offset, length))
        assert first >= 0
    assert placed == counts
    for own in loads.values():
        assert sum(n for _, n in own) <= 100 and len(own) <= 9 and sum(n * n for _, n in own) <= 5200
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("limit", "most"), [({"documents": 3}, 3), ({"attention": 450}, 4), ({}, 10)])
def test_each_other_capacity_binds(rule, limit, most):
    """Ten pieces of 10 tokens fill 100, unless there may be only 3 or squares only up to 450."""
    capacity = packing.Capacity(**{"tokens": 100, "documents": 100, "attention": 100 * 100, "rule": rule, **limit})
    sizes = Counter()
    for _, _, number, sequence, _ in packing.plan({10: 60}, capacity):
        sizes.update(range(sequence, sequence + number))
    assert max(sizes.values()) == most and len(sizes) == 60 // most
