"""Whole JSON texts as variants."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def accept_repeated_keys(spark: SparkSession) -> None:
    """Let a repeated key's last value win instead of making the text unreadable.

    Spark reads the setting when it plans a query, so it stays on for the session.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parse_whole(text: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else, or null.

    The parser alone stops after the first value. Inside brackets a rest shows up as an
    error or as a second element, unless it closes the bracket itself; the same rest is then
    an error inside braces, which it does not close.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.try_variant_get(boxed, "$[1]", "variant").isNull() & named.isNotNull()
    return F.when(alone, F.try_variant_get(boxed, "$[0]", "variant"))


def kind_of(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, ARRAY, OBJECT, VOID."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def kind_of_text(text: Column) -> Column:
    return kind_of(parse_whole(text))
