"""Counts over a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document").agg(F.count(F.lit(1)).alias("page_count"))


def document_run_lines(pages: DataFrame) -> DataFrame:
    """Per source file: pages by fate and documents written.

    ``pages`` has ``verdict`` and ``document_index``, the latter null for pages that are
    not part of a document. Indexes run 1, 2, ... so their maximum counts documents.
    """
    extracted = F.col("verdict") == "no"
    unplaced = extracted & F.col("document_index").isNull()
    return pages.groupBy("document").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(extracted).alias("extracted"),
        F.count_if(F.col("verdict") == "yes").alias("skipped"),
        F.count_if((F.col("verdict") == "unclear") | unplaced).alias("review"),
        F.coalesce(F.max("document_index"), F.lit(0)).cast("bigint").alias("documents"),
    )


def run_summary(
    inputs: DataFrame, counts: DataFrame, errors: DataFrame | None = None
) -> DataFrame:
    """Files done, files failed (no pages, or a conversion error), pages, exit code.

    ``errors`` has the ``document`` of each file that could not be converted; whatever
    pages are counted for it were not processed.
    """
    listed = inputs.select("document").join(counts, "document", "left")
    if errors is not None:
        broken = errors.select("document").distinct().withColumn("_broken", F.lit(True))
        listed = listed.join(broken, "document", "left").withColumn(
            "page_count", F.when(F.col("_broken").isNull(), F.col("page_count"))
        )
    done = F.coalesce("page_count", F.lit(0)) > 0
    return (
        listed.agg(
            F.count_if(done).alias("succeeded"),
            F.count_if(~done).alias("failed"),
            F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"),
        )
        .withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0))
    )


def destination_counts(pages: DataFrame) -> DataFrame:
    """Pages per destination; every page is in exactly one."""
    return pages.groupBy("destination").agg(F.count(F.lit(1)).alias("pages"))
