"""Choice of the extraction model from the quality tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route_pages(pages: DataFrame, tier_models: DataFrame, default_model: str) -> DataFrame:
    """Add ``model`` and ``route_reason``; a tier without a model takes the default.

    ``tier_models(tier, model)`` is left to Spark's size-checked broadcast.
    """
    lookup = tier_models.select(
        F.col("tier").alias("quality_tier"),
        F.nullif(F.col("model"), F.lit("")).alias("_tier_model"),
    )
    tier = F.coalesce("quality_tier", F.lit("None"))
    # The wording of both reasons.
    found = F.format_string(
        "tier '%s' (score %s) -> %s", tier, F.col("quality_score"), F.col("_tier_model")
    )
    fallback = F.format_string(
        f"tier '%s' has no model configured -> fallback to default model '{default_model}'",
        tier,
    )
    return (
        pages.join(lookup, "quality_tier", "left")
        .withColumn("model", F.coalesce("_tier_model", F.lit(default_model)))
        .withColumn("route_reason", F.when(F.col("_tier_model").isNull(), fallback).otherwise(found))
        .drop("_tier_model")
        .select(*pages.columns, "model", "route_reason")
    )
