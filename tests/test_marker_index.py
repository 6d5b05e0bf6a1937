"""Many markers: the automaton, the gram index and the ratio of many pairs, against plain loops."""

import random
import tracemalloc
from difflib import SequenceMatcher

import pytest

from folioline.functions.sequences import block_ratios
from folioline.operators import gate, marker_index
from folioline.operators.marker_index import GramIndex, WordAutomaton
from test_gate import by_hand, decide


def edited(rng, text, times, letters="abcde 0é"):
    own = list(text)
    for _ in range(times):
        if own:
            own[rng.randrange(len(own))] = rng.choice(["", rng.choice(letters), "xy"])
    return "".join(own)


def test_ratios_are_those_of_the_sequence_matcher():
    rng = random.Random(3)
    first = ["".join(rng.choice("abcde ") for _ in range(rng.choice([0, 1, 2, 5, 12, 40]))) for _ in range(1500)]
    second = [edited(rng, t, rng.randrange(7)) for t in first]
    # From 200 characters on frequent characters begin no block.
    long = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü0123456789 ") for _ in range(rng.randrange(150, 450))) for _ in range(120)]
    first, second = first + long, second + [edited(rng, t, rng.randrange(40)) for t in long]
    rng.shuffle(long)
    first, second = first + long, second + sorted(long)
    want = [SequenceMatcher(None, a, b).ratio() for a, b in zip(first, second, strict=True)]
    assert block_ratios(first, second).tolist() == want
    assert block_ratios([], []).size == 0


@pytest.mark.parametrize("lane", [4, 2048])
def test_automaton_finds_the_first_marker(monkeypatch, lane):
    monkeypatch.setattr(marker_index, "LANE_WORDS", lane)
    rng = random.Random(5)

    def words(n):
        return " ".join(rng.choice("abcd") for _ in range(n))

    markers = [words(rng.randrange(1, 6)) for _ in range(40)] + ["e", "e f", "f e f"]
    rng.shuffle(markers)
    texts = ["", "x", *[words(rng.randrange(30)) + rng.choice(["", " x", " e f", " f e"]) for _ in range(400)], "x " * 9000 + "f e f"]
    texts = [t.strip() for t in texts]
    want = [min((i for i, m in enumerate(markers) if f" {m} " in f" {t} "), default=len(markers)) for t in texts]
    assert WordAutomaton(markers).first(texts).tolist() == want
    assert WordAutomaton([]).first(["a b"]).tolist() == [0]


def test_index_equals_comparing_all_windows():
    rng = random.Random(8)
    words = ["licence", "delivery", "note", "no", "rights", "all", "a", "of", "reserved", "item", "code", "aaaa"]
    markers = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(150)]
    texts = [" ".join(edited(rng, " ".join(rng.choice(words) for _ in range(20)), rng.randrange(30)).split()) for _ in range(25)]
    for threshold in (0.6, 0.85, 0.95):
        got = GramIndex(markers, threshold).best([*texts, None, ""])
        for text, (order, ratio) in zip(texts, got, strict=False):
            split = text.split()
            runs = [
                (-SequenceMatcher(None, m, " ".join(split[i : i + len(m.split())])).ratio(), number)
                for number, m in enumerate(markers) for i in range(len(split) - len(m.split()) + 1)
            ]
            best = min(runs, default=(0, None))
            assert (order, ratio) == ((best[1], -best[0]) if -best[0] >= threshold else (None, 0.0))
        assert got[-2:] == [(None, 0.0)] * 2


def test_common_pairs_of_letters_make_no_table_of_hits():
    """Every window shares most of its pairs with most markers; none comes near one of them."""
    rng = random.Random(21)

    def words(n, size):
        return " ".join("".join(rng.choice("aeinrst") for _ in range(size)) for _ in range(n))

    index = GramIndex([words(3, 4) for _ in range(400)], 0.85)
    text = words(20_000, 4)
    tracemalloc.start()
    index.best([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_a_thousand_markers_equal_the_plan_and_the_loop(spark, monkeypatch):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghilnorst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    markers = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))).title() for _ in range(1000)] + ["_-_", ""]
    texts = [" ".join(edited(rng, rng.choice(words), rng.choice([0, 0, 1, 2]), "abcde") for _ in range(6)) for _ in range(40)]
    texts += [None, "", " \n", "①0 item", markers[5], markers[5].upper() + " " + markers[3], *texts[:3]]
    got = decide(spark, texts, markers)
    assert got == [by_hand(t or "", markers) for t in texts]
    assert {v for v, _, _ in got} == {"yes", "no", "unclear"}
    some = markers[:20]
    indexed = decide(spark, texts, some)
    monkeypatch.setattr(gate, "PLAN_MARKERS", 50)
    assert indexed == decide(spark, texts, some)


def test_plan_does_not_grow_with_the_markers(spark):
    df = spark.createDataFrame([("d", 1, "t")], "document string, page int, text string")

    def plan(number):
        return gate.gate_pages(df, [f"marker {i}" for i in range(number)])._jdf.queryExecution().executedPlan().toString()

    assert len(plan(3000)) < len(plan(30)) + 200 and "Exchange" not in plan(3000)


def test_one_hot_text_among_empty_ones(spark):
    """A page that is most of the table's text, and repeats a marker's beginning all the time."""
    markers = [f"a a a a b{i}" for i in range(30)]
    texts = ["a " * 60_000 + "a b7"] + [""] * 20
    assert [v for v, _, _ in decide(spark, texts, markers, threshold=1.0)] == ["yes"] + ["unclear"] * 20
