"""A whole run: every page of the input gets exactly one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioline.operators.gate import needed_pages
from folioline.operators.grouping import group_pages
from folioline.operators.quality import PAGE
from folioline.operators.replies import page_values, parse_replies
from folioline.operators.routing import route_pages


def place_pages(
    decided: DataFrame,
    replies: DataFrame,
    helpers: list[str],
    tier_models: DataFrame,
    default_model: str,
) -> DataFrame:
    """(document, page, destination, document_index, quality_tier, model) of each page.

    ``decided`` has a page's quality and gate decision, ``replies`` the model's reply to
    each needed page. A page is skipped, goes to review (unreadable, or without a clear
    document), or belongs to one output document.
    """
    routed = route_pages(needed_pages(decided), tier_models, default_model).select(*PAGE, "model")
    answered = routed.select(*PAGE).join(replies, PAGE)
    values = page_values(routed, parse_replies(answered), helpers)
    assigned = group_pages(values).select(*PAGE, "document_index")
    place = (
        F.when(F.col("verdict") == "yes", "skip")
        .when(F.col("document_index").isNotNull(), "document")
        .otherwise("review")
    )
    return (
        decided.select(*PAGE, "verdict", "quality_tier")
        .join(routed, PAGE, "left")
        .join(assigned, PAGE, "left")
        .select(*PAGE, place.alias("destination"), "document_index", "quality_tier", "model")
    )
