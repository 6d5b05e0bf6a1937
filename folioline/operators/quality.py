"""Page legibility from OCR word confidences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioline.functions.once import add_once
from folioline.functions.rounding import mean_of_tenths, round_binary
from folioline.functions.text import count_visible, number_text, visible_chars
from folioline.session import ship_package

PAGE = ["document", "page"]

# Fixed values of the score.
READABLE_CONFIDENCE = 30.0
FULL_COVERAGE_CHARS = 120.0
CLEAR_ABOVE = 80.0
BLURRY_FROM = 50.0

METRICS = [
    "ocr_confidence",
    "ocr_word_count",
    "ocr_char_count",
    "ocr_mean_confidence",
    "ocr_readable_word_count",
    "ocr_readable_char_count",
]


def quality_tier(
    score: Column, clear_above: float = CLEAR_ABOVE, blurry_from: float = BLURRY_FROM
) -> Column:
    return (
        F.when(score > clear_above, "clear")
        .when(score >= blurry_from, "blurry")
        .otherwise("very_blurry")
    )


def parse_confidence(conf: Column) -> Column:
    """Confidence text as a number in 0..100, NaN kept; null when unusable."""
    number = number_text(conf.cast("string")).try_cast("double")
    clipped = F.when(F.isnan(number), number).otherwise(F.least(number, F.lit(100.0)))
    return F.when(number >= 0, clipped)


def clean_words(words: DataFrame) -> DataFrame:
    """Countable words: visible characters and a usable, non-negative confidence."""
    return (
        words.withColumn("chars", visible_chars(F.coalesce("text", F.lit(""))))
        .withColumn("confidence", parse_confidence(F.col("conf")))
        .filter((F.col("chars") > 0) & F.col("confidence").isNotNull())
        .withColumn(
            "readable",
            ~F.isnan("confidence") & (F.col("confidence") >= READABLE_CONFIDENCE),
        )
    )


def page_quality(
    pages: DataFrame,
    words: DataFrame,
    clear_above: float = CLEAR_ABOVE,
    blurry_from: float = BLURRY_FROM,
) -> DataFrame:
    """Score, tier and six metrics per page; pages without words score 0.

    The sums combine map-side, so a page of any size reaches the shuffle as one row per
    task.
    """
    readable = F.col("readable")
    chars = F.col("chars")
    sums = clean_words(words).groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("words"),
        F.sum("chars").alias("all_chars"),
        F.count_if(readable).alias("readable_words"),
        F.sum(F.when(readable, chars)).alias("readable_chars"),
        F.sum(F.when(readable, F.col("confidence") * chars)).alias("weighted"),
    )
    return _scored(pages.join(sums, PAGE, "left"), pages.columns, clear_above, blurry_from)


def page_quality_of_arrays(
    pages: DataFrame,
    text: str = "text",
    conf: str = "conf",
    clear_above: float = CLEAR_ABOVE,
    blurry_from: float = BLURRY_FROM,
) -> DataFrame:
    """``page_quality`` where each page's row holds its words and confidences as arrays.

    The sums are made by Arrow batches of pages: nothing is exploded or shuffled.
    """
    ship_package(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (text, conf)]
    numbers = F.transform(F.col(conf), lambda c: number_text(c.cast("string")).try_cast("double"))
    found = pages.select(*kept, _array_sums(F.col(text).cast("array<string>"), numbers).alias("_found"))
    zero = F.lit(0).cast("bigint")
    sums = [F.nullif(f"_sums.{n}", zero).alias(n) for n in _COUNTS]
    return _scored(
        add_once(found, _sums=F.col("_found")).select(*kept, *sums, F.col("_sums.weighted").alias("weighted")),
        kept, clear_above, blurry_from,
    )


_COUNTS = ["words", "all_chars", "readable_words", "readable_chars"]


@F.arrow_udf(T.StructType([*[T.StructField(n, T.LongType()) for n in _COUNTS], T.StructField("weighted", T.DoubleType())]))
def _array_sums(text: pa.Array, number: pa.Array) -> pa.Array:
    """The sums of each page over its words with visible characters and a number from 0 or NaN."""
    # Words and numbers meet by place; what only one of the lists has does not count.
    sizes = [pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (text, number)]
    size = np.minimum(*sizes)
    row = np.repeat(np.arange(size.size), size)
    place = np.arange(row.size) - np.repeat(np.cumsum(size) - size, size)
    words, numbers = (place + np.repeat(np.cumsum(n) - n, size) for n in sizes)
    chars = count_visible(text.flatten())[words]
    value = number.flatten().fill_null(-1.0).to_numpy(zero_copy_only=False)[numbers]
    counts = (chars > 0) & ((value >= 0) | np.isnan(value))
    row, chars, value = row[counts], chars[counts], value[counts]
    confidence = np.where(np.isnan(value), -1.0, np.minimum(value, 100.0))
    readable = confidence >= READABLE_CONFIDENCE
    # In the order of the words, so that sums of fractions are always the same.
    sums = [
        np.bincount(row, weights=weights, minlength=size.size)
        for weights in (np.ones(row.size), chars, readable, np.where(readable, chars, 0), np.where(readable, confidence * chars, 0.0))
    ]
    return pa.StructArray.from_arrays(
        [*[pa.array(x.astype(np.int64)) for x in sums[:4]], pa.array(sums[4])], names=[*_COUNTS, "weighted"]
    )


def _scored(
    sums: DataFrame, columns: list[str], clear_above: float, blurry_from: float
) -> DataFrame:
    """Score, tier and metrics from the sums of each page, null where it has no words."""
    mean = F.coalesce(F.col("weighted") / F.col("readable_chars"), F.lit(0.0))
    coverage = F.least(F.lit(1.0), F.col("readable_chars") / F.lit(FULL_COVERAGE_CHARS))
    raw = F.coalesce(F.col("mean") * coverage, F.lit(0.0))

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("double")

    scored = (
        sums.withColumn("mean", mean)
        .withColumn("quality_score", round_binary(F.least(raw, F.lit(100.0))))
    )
    return scored.select(
        *columns,
        "quality_score",
        quality_tier(F.col("quality_score"), clear_above, blurry_from).alias("quality_tier"),
        F.col("quality_score").alias("ocr_confidence"),
        count("words").alias("ocr_word_count"),
        count("all_chars").alias("ocr_char_count"),
        round_binary(F.col("mean")).alias("ocr_mean_confidence"),
        count("readable_words").alias("ocr_readable_word_count"),
        count("readable_chars").alias("ocr_readable_char_count"),
    )


def as_assessment(quality: DataFrame) -> DataFrame:
    """The same result as one ``assessment`` struct with a metrics map."""
    pairs = [part for name in METRICS for part in (F.lit(name), F.col(name))]
    kept = [c for c in quality.columns if c not in {*METRICS, "quality_score", "quality_tier"}]
    return quality.select(
        *kept,
        F.struct(
            F.col("quality_score").alias("score"),
            F.col("quality_tier").alias("tier"),
            F.create_map(*pairs).alias("metrics"),
        ).alias("assessment"),
    )


def document_quality(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the rounded page scores per document, and its tier."""
    means = pages.groupBy(*keys).agg(
        round_binary(mean_of_tenths(F.col("quality_score"))).alias("quality_score")
    )
    return means.withColumn("quality_tier", quality_tier(F.col("quality_score")))
