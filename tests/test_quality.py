import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioline.functions.text import count_visible, visible_chars
from folioline.operators import quality, routing
from folioline.sources.files import ocr_words
from folioline.sources.tables import TIER_MODELS, tier_models


def score(spark, words, clear=80.0):
    pages = spark.createDataFrame([("d", 1)], "document string, page int")
    arrays = spark.createDataFrame(
        [("d", 1, [w for w, _ in words], [c for _, c in words])],
        "document string, page int, text array<string>, conf array<string>",
    )
    return quality.page_quality(pages, ocr_words(arrays), clear).first()


def test_only_usable_words_count(spark):
    row = score(spark, [
        ("", "90"), ("  ", "90"), (None, "90"), ("x", "-1"), ("x", "n/a"), ("x", "90d"), ("x", None),
        ("ab c", "120"), ("de", "29.9"), ("fg", "30"), ("h", "NaN"),
    ])
    # "ab c" (3 letters, clipped to 100), "de" unreadable, "fg", and NaN which is not readable.
    assert row.ocr_word_count == 4 and row.ocr_char_count == 8
    assert row.ocr_readable_word_count == 2 and row.ocr_readable_char_count == 5
    mean = (100 * 3 + 30 * 2) / 5
    assert row.ocr_mean_confidence == round(mean, 1)
    assert row.quality_score == round(mean * 5 / 120, 1)


@pytest.mark.parametrize("chars, coverage", [(119, 119 / 120), (120, 1.0), (121, 1.0)])
def test_coverage_stops_at_the_target(spark, chars, coverage):
    assert score(spark, [("a" * chars, "90")]).quality_score == round(90 * coverage, 1)


def test_page_without_words_scores_zero(spark):
    row = score(spark, [])
    assert row.quality_score == 0.0 and row.quality_tier == "very_blurry"
    assert row.ocr_word_count == 0.0


def test_tier_borders(spark):
    df = spark.createDataFrame([(80.1,), (80.0,), (50.0,), (49.9,)], "s double")
    got = [r.t for r in df.select(quality.quality_tier(F.col("s")).alias("t")).collect()]
    assert got == ["clear", "blurry", "blurry", "very_blurry"]


def test_thresholds_are_parameters(spark):
    assert score(spark, [("a" * 200, "90")], clear=95.0).quality_tier == "blurry"


def test_assessment_struct(spark):
    pages = spark.createDataFrame([("d", 1)], "document string, page int")
    words = spark.createDataFrame(
        [("d", 1, 1, "a" * 120, "90")],
        "document string, page int, word_no int, text string, conf string",
    )
    got = quality.as_assessment(quality.page_quality(pages, words)).first().assessment
    assert got.score == 90.0 and got.tier == "clear"
    assert got.metrics["ocr_readable_char_count"] == 120.0 and len(got.metrics) == 6


def test_routing_and_fallback(spark):
    pages = spark.createDataFrame(
        [(95.0, "clear"), (60.0, "blurry"), (10.0, "other")], "quality_score double, quality_tier string"
    )
    got = {r.quality_tier: r for r in routing.route_pages(pages, tier_models(spark), "big").collect()}
    assert got["clear"].model == TIER_MODELS["clear"]
    assert got["clear"].route_reason == f"tier 'clear' (score 95.0) -> {TIER_MODELS['clear']}"
    assert got["other"].model == "big" and "fallback to default model 'big'" in got["other"].route_reason
    empty = tier_models(spark, {"clear": ""})
    assert routing.route_pages(pages, empty, "big").filter("model <> 'big'").count() == 0


def test_lookup_tables_are_broadcast_after_a_size_check(spark):
    pages = spark.createDataFrame([(95.0, "clear")], "quality_score double, quality_tier string")
    plan = routing.route_pages(pages, tier_models(spark), "big")._jdf.queryExecution().executedPlan()
    assert "BroadcastHashJoin" in plan.toString()


def test_nan_confidence_is_kept_but_not_readable(spark):
    df = spark.createDataFrame([("NaN",), ("inf",)], "c string")
    got = [r.p for r in df.select(quality.parse_confidence(F.col("c")).alias("p")).collect()]
    assert math.isnan(got[0]) and got[1] == 100.0


def test_arrays_give_the_same_as_long_words(spark):
    from folioline.sources.files import ocr_words

    rows = [
        ("d", 1, ["a", "  ", "bcd", None, "ef"], ["90", "80", "NaN", "50", "29.9"]),
        ("d", 2, [], []), ("d", 3, None, None), ("d", 4, ["x", "yy"], ["90d", "-1"]),
        ("d", 5, ["long word " * 20, "b"], ["150", "30"]), ("d", 6, ["a", "b"], ["10"]),
    ]
    arrays = spark.createDataFrame(rows, "document string, page int, text array<string>, conf array<string>")
    pages = arrays.select("document", "page")
    long = quality.page_quality(pages, ocr_words(arrays))
    wide = quality.page_quality_of_arrays(arrays)
    assert wide.columns == long.columns
    assert wide.orderBy("page").collect() == long.orderBy("page").collect()
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()


def test_visible_characters_of_batches(spark):
    """Batches count as the column function does, over every kind of white space and sliced arrays."""
    texts = [None, "", "a b", "é ü\u0085", " x　語 ", "  \U0001f600\x1f\t", "“q”…", "、¡‐", " "] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [r.n or 0 for r in df.select("i", visible_chars(F.col("t")).alias("n")).orderBy("i").collect()]
    assert count_visible(pa.array(texts)).tolist() == want
    assert count_visible(pa.array(texts).slice(4, 9)).tolist() == want[4:13]
    assert count_visible(pa.array([], pa.string())).tolist() == [] and count_visible(pa.array([None], pa.string())).tolist() == [0]


def test_arrays_of_unequal_lengths_and_nulls(spark):
    data = [
        (1, ["ab", "c", None, "word"], ["90", "n/a", "80", "29.9"]), (2, None, ["1"]), (3, ["x"], None), (4, [], []),
        (5, ["abc", "d"], ["NaN"]), (6, ["one"], ["1e9", "5"]), (7, ["q", "r"], ["5d", "-3"]), (8, ["a", "b", "c"], ["33.3", "33.3", "33.1"]),
    ]
    pages = spark.createDataFrame(data, "page int, text array<string>, conf array<string>")
    got = {r.page: (r.ocr_word_count, r.ocr_char_count, r.ocr_readable_word_count, r.ocr_mean_confidence) for r in quality.page_quality_of_arrays(pages).collect()}
    empty = (0.0, 0.0, 0.0, 0.0)
    assert got == {1: (2.0, 6.0, 1.0, 90.0), 2: empty, 3: empty, 4: empty, 5: (1.0, 3.0, 0.0, 0.0), 6: (1.0, 3.0, 1.0, 100.0), 7: empty, 8: (3.0, 3.0, 3.0, 33.2)}


def test_sums_of_arrays_leave_the_interpreter(spark):
    pages = spark.createDataFrame([(1, ["a"], ["90"])], "page int, text array<string>, conf array<string>")
    plan = quality.page_quality_of_arrays(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_array_sums(") == 1 and "aggregate(" not in plan
