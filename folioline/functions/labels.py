"""Display labels for costs, sizes, tiers and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioline.functions.rounding import fixed_text


def usd_label(value: Column) -> Column:
    """More digits for smaller amounts."""
    return (
        F.when(value == 0, F.lit("$0"))
        .when(value < 0.01, F.concat(F.lit("$"), fixed_text(value, 6)))
        .when(value < 1, F.concat(F.lit("$"), fixed_text(value, 4)))
        .otherwise(F.concat(F.lit("$"), fixed_text(value, 2)))
    )


def tokens_label(value: Column) -> Column:
    return F.format_number(value, 0)


def bytes_label(size: Column) -> Column:
    kib, mib = 1024, 1024 * 1024
    return (
        F.when(size < kib, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mib, F.concat(fixed_text(size / F.lit(float(kib)), 1), F.lit(" KB")))
        .otherwise(F.concat(fixed_text(size / F.lit(float(mib)), 1), F.lit(" MB")))
    )


def tier_label(tier: Column) -> Column:
    return (
        F.when(tier == "clear", "Clear")
        .when(tier == "blurry", "Blurry")
        .when(tier == "very_blurry", "Very blurry")
        .otherwise("Unknown")
    )


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 60, "high").when(confidence > 0, "low").otherwise("none")


def score_badge(score: Column) -> Column:
    """``q<score>`` rounded half up; null without a score."""
    return F.concat(F.lit("q"), F.floor(score + 0.5).cast("string"))


def rate_label(rate: Column, model_count: Column) -> Column:
    """The rate when one model was used, else ``mixed``."""
    plain = F.regexp_replace(rate.cast("string"), r"\.0$", "")
    return F.when(
        (model_count == 1) & rate.isNotNull(), F.concat(F.lit("$"), plain, F.lit("/1M"))
    ).otherwise("mixed")


def caption(kind: Column, page_count: Column, model: Column, skip_reason: Column) -> Column:
    pages = F.coalesce(page_count.cast("string"), F.lit("?"))
    return F.when(
        kind == "document", F.concat(F.lit("Document - "), pages, F.lit(" page(s)"))
    ).otherwise(F.coalesce(model, skip_reason, F.lit("No extraction")))
