"""Row numbers that do not pull one key into one task.

``row_number() over (partition by key)`` sorts all rows of a key in one task. That is right
for ordinary keys, and where no key has more than ``HOT_ROWS`` rows it is the whole plan. The
rows of larger keys are cut into blocks by an expression that rises with the wanted order;
they are numbered inside a block, and a running total over the much smaller table of block
sizes gives each block its start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioline.session import dealt

# One task sorts this many narrow rows without trouble.
HOT_ROWS = 1_000_000
# Keys are first counted together, so that the look holds no more sums than this.
_LOOK = 1 << 16


@dataclass(frozen=True)
class KeySizes:
    """Number of rows, and the keys with very many of them: None without any."""

    rows: int
    hot: DataFrame | None


def key_sizes(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> KeySizes:
    """A look at the key columns alone, run at once; sums combine map-side.

    Keys are counted one by one only inside hash values with more rows than a hot key has.
    """
    group = F.pmod(F.xxhash64(*keys), F.lit(_LOOK)).alias("_group")
    groups = df.select(*keys).groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    large = F.when(F.col("_rows") > hot_rows, F.col("_group"))
    rows, wanted = groups.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.collect_list(large)).first()
    if not wanted:
        return KeySizes(rows, None)
    counts = df.select(*keys).filter(group.isin(wanted)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.filter(F.col("_rows") > hot_rows).select(*keys)
    return KeySizes(rows, None if hot.isEmpty() else hot)


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    block: Column,
    name: str,
    total: str | None = None,
    hot_rows: int = HOT_ROWS,
    sizes: KeySizes | None = None,
) -> DataFrame:
    """Add ``name`` = 1, 2, ... per key in ``order``; ``total`` adds the rows per key.

    ``block`` must be non-decreasing along ``order``. Keys must not be null. ``sizes`` of a look
    that was taken already spares another one.
    """
    sizes = sizes or key_sizes(df, keys, hot_rows)
    if sizes.hot is None:
        return _number_within(dealt(df, keys, sizes.rows), keys, order, name, total)
    few = dealt(df.join(sizes.hot, keys, "left_anti"), keys, sizes.rows)
    ordinary = _number_within(few, keys, order, name, total)
    many = df.join(sizes.hot, keys, "left_semi")
    return ordinary.unionByName(_number_by_blocks(many, keys, order, block, name, total, sizes.rows))


def _number_within(
    df: DataFrame, keys: list[str], order: list[str | Column], name: str, total: str | None
) -> DataFrame:
    whole = Window.partitionBy(*keys)
    numbered = df.withColumn(name, F.row_number().over(whole.orderBy(*order)).cast("bigint"))
    return numbered.withColumn(total, F.count(F.lit(1)).over(whole)) if total else numbered


def _number_by_blocks(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    block: Column,
    name: str,
    total: str | None,
    count: int,
) -> DataFrame:
    group = [*keys, "_block"]
    rows = dealt(df.withColumn("_block", block), group, count)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select(
        *group,
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_total"),
    )
    numbered = _number_within(rows, group, order, "_inside", None).join(starts, group)
    numbered = numbered.withColumn(name, F.col("_start") + F.col("_inside"))
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_block", "_start", "_inside", "_total")


def running_total(
    df: DataFrame, keys: list[str], value: str, weight: str, block: Column
) -> DataFrame:
    """Add ``before`` and ``total``: the weight per key ahead of each row, and in all.

    Rows are ordered by ``value``, along which ``block`` must be non-decreasing.
    """
    rows = df.withColumn("_block", block)
    group = [*keys, "_block"]
    to_here = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*to_here)
    inside = Window.partitionBy(*group).orderBy(value).rowsBetween(*to_here)
    sums = rows.groupBy(*group).agg(F.sum(weight).alias("_sum"))
    starts = sums.select(
        *group,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias("total"),
    )
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(starts, group)
        .withColumn("before", F.col("_start") + F.col("_inside"))
        .drop("_block", "_start", "_inside")
    )
