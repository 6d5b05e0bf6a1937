import random
from itertools import product

import pytest

from folioline.operators import grouping

SCHEMA = "document string, page int, value string"


def check_rules(values, index):
    """``values`` and ``index`` by page; each rule is stated on its own."""
    pages = sorted(values)
    valued = [p for p in pages if values[p] is not None]
    for page in pages:
        value = values[page]
        if value is not None:
            # Only the first unbroken stretch of a value is a document.
            first = next(p for p in valued if values[p] == value)
            broken = any(values[p] != value for p in valued if first < p < page)
            assert (index[page] is None) == broken
        else:
            # A page without value belongs where both neighbours with one agree.
            left = [p for p in valued if p < page][-1:]
            right = [p for p in valued if p > page][:1]
            agree = bool(left and right) and values[left[0]] == values[right[0]]
            assert index[page] == (index[left[0]] if agree else None)
    placed = [p for p in valued if index[p] is not None]
    # One document per value, numbered in the order of their first pages.
    assert len({(values[p], index[p]) for p in placed}) == len({values[p] for p in placed})
    assert list(dict.fromkeys(index[p] for p in placed)) == list(range(1, len({index[p] for p in placed}) + 1))


def grouped(spark, values, block_pages=1024):
    rows = [(d, p, v) for (d, p), v in values.items()]
    hot = {} if block_pages == 1024 else {"hot_pages": 3}
    got = grouping.group_pages(spark.createDataFrame(rows, SCHEMA), block_pages, **hot).collect()
    assert len(got) == len(rows)
    result = {}
    for row in got:
        result.setdefault(row.document, {})[row.page] = row.document_index
    return result


@pytest.mark.parametrize("block_pages", [2, 1024])
def test_all_short_sequences(spark, block_pages):
    cases = [case for size in range(1, 7) for case in product([None, "a", "b"], repeat=size)]
    values = {(f"d{i}", p): v for i, case in enumerate(cases) for p, v in enumerate(case, 1)}
    got = grouped(spark, values, block_pages)
    for i, case in enumerate(cases):
        check_rules(dict(enumerate(case, 1)), got[f"d{i}"])


@pytest.mark.parametrize("block_pages", [3, 7])
def test_random_pages_in_small_blocks(spark, block_pages):
    random.seed(block_pages)
    values = {}
    for d in range(40):
        pages = random.sample(range(1, 90), random.randint(1, 45))
        for page in pages:
            values[f"d{d}", page] = random.choice(["a", "a", "b", "c", None, None])
    got = grouped(spark, values, block_pages)
    for d in range(40):
        check_rules({p: v for (k, p), v in values.items() if k == f"d{d}"}, got[f"d{d}"])


def test_one_file_with_nearly_all_pages(spark):
    from pyspark.sql import functions as F

    pages = spark.range(1, 30001).select(
        F.lit("hot").alias("document"),
        F.col("id").cast("int").alias("page"),
        F.when(F.col("id") % 7 == 3, None)
        .otherwise(F.floor(F.col("id") / 50).cast("string"))
        .alias("value"),
    )
    got = grouping.group_pages(pages, 256, hot_pages=20000)
    assert got.count() == 30000
    assert got.agg(F.max("document_index")).first()[0] == 601
    wrong = got.filter(
        F.col("document_index").isNotNull()
        & (F.col("document_index") != F.floor(F.col("page") / 50) + 1)
    )
    assert wrong.count() == 0


def test_manifest_orders_source_pages(spark):
    df = spark.createDataFrame(
        [("d", 5, 1), ("d", 2, 1), ("d", 9, 2), ("d", 3, None)],
        "document string, page int, document_index long",
    )
    got = grouping.document_manifest(df, 4).orderBy("document_index", "position").collect()
    assert [(r.document_index, r.position, r.source_page) for r in got] == [(1, 1, 2), (1, 2, 5), (2, 1, 9)]
    assert grouping.grouping_rejects(df).first().page == 3


def test_single_document(spark):
    df = spark.createDataFrame([("d", 1), ("d", 4)], "document string, page int")
    assert {r.document_index for r in grouping.single_document(df).collect()} == {1}
