"""Small lookup tables given as job parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Models, and USD per million tokens in and out.
SMALL_MODEL = "mistralai/mistral-small-2603"
MEDIUM_MODEL = "mistralai/mistral-medium-3.5"
LARGE_MODEL = "mistralai/mistral-large-2512"
MODEL_RATES = {
    SMALL_MODEL: (0.15, 0.60),
    MEDIUM_MODEL: (1.50, 7.50),
    LARGE_MODEL: (0.50, 1.50),
}
TIER_MODELS = {"clear": SMALL_MODEL, "blurry": MEDIUM_MODEL, "very_blurry": LARGE_MODEL}


def _literal_rows(spark: SparkSession, rows: list[dict], schema: dict[str, str]) -> DataFrame:
    """A literal table inside the plan: Spark knows its size and broadcasts it unasked."""
    structs = [
        F.struct(*[F.lit(row[name]).cast(kind).alias(name) for name, kind in schema.items()])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def model_pricing(
    spark: SparkSession, rates: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    rows = [
        {"model": model, "input_rate": pair[0], "output_rate": pair[1]}
        for model, pair in (rates or MODEL_RATES).items()
    ]
    kinds = {"model": "string", "input_rate": "double", "output_rate": "double"}
    return _literal_rows(spark, rows, kinds)


def tier_models(spark: SparkSession, models: dict[str, str] | None = None) -> DataFrame:
    rows = [{"tier": t, "model": m} for t, m in (models or TIER_MODELS).items()]
    return _literal_rows(spark, rows, {"tier": "string", "model": "string"})
