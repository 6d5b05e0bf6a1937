"""Consecutive pages with the same helper value become one document.

Ordinary documents are scanned along their pages with window functions, after one shuffle
by document. Documents of very many pages are spread over many tasks: blocks of pages are
scanned on their own, and one row per block carries the neighbouring values and run counts
across block borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioline.operators.numbering import HOT_ROWS, KeySizes, key_sizes, number_rows
from folioline.session import dealt, written

BLOCK_PAGES = 4096
# Fixed values of the review record for a page without a clear document.
REVIEW_REPLY = "document grouping"
REVIEW_REASON = (
    "ambiguous document position - helper value missing or conflicting with surrounding pages"
)


def group_pages(
    values: DataFrame, block_pages: int = BLOCK_PAGES, hot_pages: int = HOT_ROWS,
    keep: tuple[str, ...] = (), sizes: KeySizes | None = None,
) -> DataFrame:
    """``(document, page, value)`` to ``(document, page, value, segment, document_index)``.

    ``value`` is the cleaned helper value, null when missing. ``document_index`` numbers
    the kept runs 1, 2, ... in page order and is null for pages that go to review.
    Documents of more than ``hot_pages`` pages are scanned in blocks. Columns to ``keep`` stay
    with their page. ``sizes`` is a look that was taken already; the rows then lie by document.
    """
    values = values.select("document", "page", "value", *keep)
    if sizes is None:
        sizes = key_sizes(values, ["document"], hot_pages)
        few = values if sizes.hot is None else values.join(sizes.hot, "document", "left_anti")
        few = dealt(few, ["document"], sizes.rows)
    else:
        few = values if sizes.hot is None else values.join(sizes.hot, "document", "left_anti")
    if sizes.hot is None:
        return _group_whole(few, keep)
    many = values.join(sizes.hot, "document", "left_semi")
    return _group_whole(few, keep).unionByName(_group_by_blocks(many, block_pages, keep))


def _group_whole(values: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """All windows are within a document, so that its pages are shuffled once."""
    in_page_order = "OVER (PARTITION BY document ORDER BY page)"
    so_far = f"{in_page_order[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    near = values.selectExpr(
        "*",
        f"lag(value) IGNORE NULLS {in_page_order} AS before",
        f"lead(value) IGNORE NULLS {in_page_order} AS after",
    ).withColumn("start", F.expr("value IS NOT NULL AND value IS DISTINCT FROM before"))
    runs = near.withColumn("run", F.expr(f"sum(int(start)) {so_far}"))
    # A value keeps its first run; the runs kept are numbered in page order.
    first = runs.withColumn(
        "kept", F.expr("run = min(run) OVER (PARTITION BY document, value)")
    ).withColumn("number", F.expr(f"sum(int(start AND kept)) {so_far}"))
    inside = F.expr("value IS NOT NULL OR before <=> after AND before IS NOT NULL")
    # Pages without value take over whether the run they are in was kept.
    run_kept = F.expr(f"last(if(value IS NOT NULL, kept, NULL)) IGNORE NULLS {so_far}")
    return first.withColumn("run_kept", run_kept).select(
        "document",
        "page",
        "value",
        *keep,
        F.when(inside, F.col("run")).alias("segment"),
        F.when(inside & F.col("run_kept"), F.col("number")).alias("document_index"),
    )


def _group_by_blocks(values: DataFrame, block_pages: int, keep: tuple[str, ...]) -> DataFrame:
    block = ["document", "block"]
    rows = values.select(
        "document", "page", "value", *keep, F.floor(F.col("page") / block_pages).alias("block")
    )
    in_page_order = "OVER (PARTITION BY document, block ORDER BY page)"
    so_far = Window.partitionBy(*block).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)

    value, near = F.col("value"), F.col("near_before")
    scanned = (
        rows.withColumn("near_before", F.expr(f"lag(value) IGNORE NULLS {in_page_order}"))
        .withColumn("near_after", F.expr(f"lead(value) IGNORE NULLS {in_page_order}"))
        .withColumn("turn", (value.isNotNull() & near.isNotNull() & (value != near)).cast("int"))
        .withColumn("turns", F.sum("turn").over(so_far))
    )

    # Both tables are read several times below, so each is computed once and stored.
    scanned = written(scanned, "scanned")
    carried = _carry_over_blocks(scanned)
    before = F.coalesce(near, F.col("carry_before"))
    after = F.coalesce(F.col("near_after"), F.col("carry_after"))
    # Before the block's first value the carried run goes on; from there on the block's
    # own runs count, the first of them new unless it continues the carried one.
    started = value.isNotNull() | near.isNotNull()
    segment = F.col("runs_before") + F.when(
        started, F.col("turns") + F.col("first_is_new").cast("int")
    ).otherwise(0)
    placed = scanned.join(carried, block).select(
        *block,
        "page",
        "value",
        *keep,
        F.when(value.isNotNull() | F.coalesce(before == after, F.lit(False)), segment).alias(
            "segment"
        ),
        F.coalesce(value != before, value.isNotNull()).alias("is_start"),
    )
    placed = written(placed, "placed")

    # Each value keeps its first run; the group-by itself yields one row per document.
    kept = (
        placed.filter("is_start")
        .groupBy("document", "value")
        .agg(F.min("segment").alias("segment"))
    )
    numbered = number_rows(
        kept.select("document", "segment"),
        ["document"],
        ["segment"],
        F.floor(F.col("segment") / block_pages),
        "document_index",
    )
    return _attach_index(placed, numbered, keep)


def _carry_over_blocks(scanned: DataFrame) -> DataFrame:
    """Per block: values next to it, runs started before it, does its first run start."""
    has = F.col("value").isNotNull()
    summary = scanned.groupBy("document", "block").agg(
        F.min_by("value", F.when(has, F.col("page"))).alias("first_value"),
        F.max_by("value", F.when(has, F.col("page"))).alias("last_value"),
        F.sum("turn").alias("turns_in_block"),
    )
    before = Window.partitionBy("document").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    after = Window.partitionBy("document").orderBy(F.desc("block")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    first_is_new = F.coalesce(
        F.col("first_value") != F.col("carry_before"), F.col("first_value").isNotNull()
    )
    runs = F.col("turns_in_block") + F.col("first_is_new").cast("int")
    return (
        summary.withColumn("carry_before", F.last("last_value", ignorenulls=True).over(before))
        .withColumn("carry_after", F.last("first_value", ignorenulls=True).over(after))
        .withColumn("first_is_new", first_is_new)
        .withColumn("runs_before", F.coalesce(F.sum(runs).over(before), F.lit(0)))
        .select(
            "document", "block", "carry_before", "carry_after", "first_is_new", "runs_before"
        )
    )


def _attach_index(placed: DataFrame, numbered: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Look up each run's number once per (block, run), then on the block's rows.

    A block holds at most ``block_pages`` runs with consecutive segment numbers, so its
    numbers fit one small array and the page rows keep their partitioning.
    """
    runs = (
        placed.filter(F.col("segment").isNotNull())
        .select("document", "block", "segment")
        .distinct()
    )
    indexed = runs.join(numbered, ["document", "segment"], "left")
    per_block = indexed.groupBy("document", "block").agg(
        F.min("segment").alias("first_segment"),
        F.array_sort(F.collect_list(F.struct("segment", "document_index"))).alias("runs"),
    )
    position = (F.col("segment") - F.col("first_segment")).cast("int")
    return placed.join(per_block, ["document", "block"], "left").select(
        "document",
        "page",
        "value",
        *keep,
        "segment",
        F.when(
            F.col("segment").isNotNull(), F.get(F.col("runs.document_index"), position)
        ).alias("document_index"),
    )


def single_document(pages: DataFrame) -> DataFrame:
    """Without a helper field all needed pages of a file are its one document."""
    return pages.select("document", "page", F.lit(1).cast("bigint").alias("document_index"))


def output_file(stem, document_index, multiple: bool):
    """File name of an output document."""
    if multiple:
        return F.concat(F.lit("invoice-"), document_index.cast("string"), F.lit(".pdf"))
    return F.concat(stem, F.lit(".pdf"))


def document_manifest(assigned: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Ordered source pages of every output document, in long form."""
    kept = assigned.filter(F.col("document_index").isNotNull())
    return number_rows(
        kept.select("document", "document_index", F.col("page").alias("source_page")),
        ["document", "document_index"],
        ["source_page"],
        F.floor(F.col("source_page") / block_pages),
        "position",
    )


def grouping_rejects(assigned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return assigned.filter(F.col("document_index").isNull()).select(
        "document",
        "page",
        *keep,
        F.lit(REVIEW_REPLY).alias("raw_reply"),
        F.lit(REVIEW_REASON).alias("reason"),
    )
