import random

import pytest
from pyspark.sql import functions as F

from folioline import session
from folioline.operators import grouping
from folioline.operators.numbering import key_sizes, number_rows, running_total


@pytest.mark.parametrize("hot_rows", [0, 200, 10**6])
def test_numbers_match_a_plain_count(spark, hot_rows):
    random.seed(1)
    rows = [(random.choice("ab"), n) for n in random.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, n int")
    block = F.floor(F.col("n") / 64)
    got = number_rows(df, ["k"], ["n"], block, "no", "total", hot_rows).collect()
    for key in "ab":
        ordered = sorted(n for k, n in rows if k == key)
        mine = {r.n: (r.no, r.total) for r in got if r.k == key}
        assert mine == {n: (i, len(ordered)) for i, n in enumerate(ordered, 1)}


def test_one_key_with_nearly_all_rows_is_spread(spark):
    key = F.when(F.col("id") % 10 == 9, F.concat(F.lit("k"), F.floor(F.col("id") / 100).cast("string"))).otherwise("hot")
    df = spark.range(20000).select(key.alias("k"), F.col("id").alias("n"))
    numbered = number_rows(df, ["k"], ["n"], F.floor(F.col("n") / 512), "no", hot_rows=1000)
    wanted = F.when(F.col("k") == "hot", F.col("n") - F.floor(F.col("n") / 10) + 1).otherwise(
        F.floor(F.col("n") % 100 / 10) + 1
    )
    assert numbered.count() == 20000 and numbered.filter(F.col("no") != wanted).count() == 0
    window = [l for l in numbered._jdf.queryExecution().executedPlan().toString().split("\n")
              if "row_number" in l]
    assert any("_block" in line for line in window)


def test_running_total_with_weights(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 5, 3), ("a", 9, 1)], "k string, v int, w int")
    got = running_total(df, ["k"], "v", "w", F.floor(F.col("v") / 4)).orderBy("v").collect()
    assert [(r.before, r.total) for r in got] == [(0, 6), (2, 6), (5, 6)]


def test_tasks_grow_with_the_rows_and_not_each_task(spark, monkeypatch):
    """A table of many rows is dealt to more tasks than there are shuffle partitions, keys whole."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    df = spark.range(20000).select(F.floor(F.col("id") / 4).cast("string").alias("document"), F.col("id").alias("page"))
    numbered = number_rows(df, ["document"], ["page"], F.lit(0), "no")
    assert numbered.rdd.getNumPartitions() == 40
    assert numbered.groupBy("no").count().collect() and numbered.agg(F.max("no")).first()[0] == 4
    grouped = grouping.group_pages(df.select("*", F.lit("v").alias("value"), F.lit(7).alias("more")), keep=("more",))
    assert grouped.rdd.getNumPartitions() == 40
    assert grouped.filter("document_index = 1 AND more = 7").count() == 20000


def test_sizes_hold_few_sums_and_find_hot_keys(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    sizes = key_sizes(df, ["k"], 1500)
    assert sizes.rows == 3000 and [r.k for r in sizes.hot.collect()] == ["hot"]
    assert key_sizes(df, ["k"], 2000).hot is None and key_sizes(df.limit(0), ["k"], 0).rows == 0
