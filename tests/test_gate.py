import random
from difflib import SequenceMatcher

import pytest

from folioline.functions.text import normalize_text
from folioline.operators import gate


def decide(spark, texts, markers, **options):
    rows = [("d", page, text) for page, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "document string, page int, text string")
    got = gate.gate_pages(df, markers, **options).collect()
    return [(r.verdict, r.raw_reply, r.reason) for r in sorted(got, key=lambda r: r.page)]


def by_hand(text, markers):
    """The decision from a ranking of all matches: exact ones, then ratio, marker, place."""
    if not text.strip():
        return "unclear", "", gate.REASON_BLANK
    tokens = normalize_text(text).split()
    spelled = [normalize_text(m).split() for m in markers]
    runs = [
        (place, tokens[place : place + len(wanted)], order)
        for order, wanted in enumerate(spelled) if wanted
        for place in range(len(tokens) - len(wanted) + 1)
    ]
    ranked = sorted(
        (run != spelled[order], 0 if run == spelled[order] else -ratio(spelled[order], run), order, place)
        for place, run, order in runs
    )
    if not ranked or (ranked[0][0] and -ranked[0][1] < 0.85):
        return "no", "", gate.REASON_NO_MATCH
    differs, minus_ratio, order, _ = ranked[0]
    shown = f"{-minus_ratio:.2f}" if differs else "1.00"
    best = markers[order]
    return "yes", f"matched '{best}'", f"no_need_page field '{best}' matched (similarity {shown})"


def ratio(wanted, run):
    return SequenceMatcher(None, " ".join(wanted), " ".join(run)).ratio()


def test_no_markers_or_no_ocr_mean_needed(spark):
    assert decide(spark, ["x"], []) == [("no", "", gate.REASON_DISABLED)]
    assert decide(spark, ["x"], ["y"], ocr_available=False) == [("no", "", gate.REASON_NO_OCR)]


LONG = "ordinary words of a long page " * 700


@pytest.mark.parametrize("text, markers, verdict, reply", [
    ("Packing_List 17\n2 crates", ["packing list"], "yes", "packing list"),
    ("the packlng 1ist of friday", ["Packing-List"], "yes", "Packing-List"),
    ("Pro forma", ["packing-list"], "no", None),
    ("customs form, weight slip", ["weight-slip", "customs-form"], "yes", "weight-slip"),
    ("customs fonn and weight slip", ["customs-form", "weight-slip"], "yes", "weight-slip"),
    (LONG + "packing list", ["packing-list"], "yes", "packing-list"),
    (LONG + "packlng list", ["packing-list"], "yes", "packing-list"),
    ("anything", ["_-_"], "no", None),
    ("brief", ["a marker of many more words"], "no", None),
    ("repacking lists", ["packing-list"], "yes", "packing-list"),
])
def test_cases(spark, text, markers, verdict, reply):
    got = decide(spark, [text], markers)[0]
    assert got[0] == verdict
    assert got[1] == (f"matched '{reply}'" if reply else "")
    assert got == by_hand(text, markers)


def test_blank_text_is_unclear(spark):
    assert [g[0] for g in decide(spark, ["", " \n\t", None], ["a b"])] == ["unclear"] * 3


def test_pruned_equals_unpruned_and_by_hand(spark):
    random.seed(7)
    markers = ["licensed under", "all rights reserved", "item-code", "delivery information", "no"]
    pieces = " ".join(normalize_text(m) for m in markers).split() + ["alpha", "rights", "lic", "code"]

    def noisy(word):
        letters = list(word)
        for _ in range(random.choice([0, 0, 1, 1, 2])):
            at = random.randrange(len(letters))
            letters[at] = random.choice(["", random.choice("abcdefgilnorst"), letters[at] * 2])
        return "".join(letters) or "x"

    texts = [" ".join(noisy(random.choice(pieces)) for _ in range(12)) for _ in range(250)]
    texts += ["Ärzte ﬁne ①0 item c0de", "ALL-RIGHTS  reserved"]
    pruned = decide(spark, texts, markers)
    assert pruned == decide(spark, texts, markers, prune=False)
    assert pruned == [by_hand(t, markers) for t in texts]
    assert {v for v, _, _ in pruned} == {"yes", "no"}
    assert any("similarity 0." in reason for _, _, reason in pruned)


def test_threshold_one_is_exact_only(spark):
    got = decide(spark, ["deiivery note", "delivery note"], ["delivery-note"], threshold=1.0)
    assert [g[0] for g in got] == ["no", "yes"]


def test_gate_needs_no_shuffle(spark):
    df = spark.createDataFrame([("d", 1, "t")], "document string, page int, text string")
    plan = gate.gate_pages(df, ["a b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_windows_of_joined_texts_end_with_their_text(spark, monkeypatch):
    """Texts of a batch are compared in one string: no window passes from one to the next, in pieces or not."""
    texts = ["the packlng", "list of all", "packlng list", "x", "packing\nlisk é", "a 語 packlng 1ist", "pakking list"]
    want = [by_hand(t, ["packing list", "é packing"]) for t in texts]
    assert decide(spark, texts, ["packing list", "é packing"]) == want
    norms = [normalize_text(t) for t in texts]
    for prune in (True, False):
        near = gate._nearest(norms, ["packing list"], 0.85, prune)
        assert [top for top, _ in near] == [None, None, 0, None, 0, 0, 0]


def test_windows_leave_the_interpreter(spark):
    df = spark.createDataFrame([("d", 1, "packlng list")], "document string, page int, text string")
    plan = gate.gate_pages(df, ["packing list"])._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "filter(" not in plan
