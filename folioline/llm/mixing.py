"""Mixing sources to target weights through a tree of levels, with DataFrame functions only.

*Budgets.* The root's tokens are dealt to its children by weight, down to the leaves. A node
cannot hold more than its documents give in ``max_epochs`` epochs. What a child cannot hold
goes to its siblings in proportion to their weights, until they are full too; only then is
the parent itself full, and the rest goes to the parent's siblings. Sorted by capacity
per weight, the children that get full are a prefix, so one window per level finds the water
level. All amounts are whole numbers; a rounding loses less than one token per node.

*Selection.* Every epoch has its own order of a leaf's documents: the MD5 of seed, epoch and
id. A leaf takes the prefix of epoch 0, 1, ... that its budget fills. Places in
the order come from sums over 4096 slices of the hash and then within a slice, so a leaf with
a third of all rows is no single task.

Defined results: null or empty text has no words, costs nothing, and comes with the prefix it
falls into; a null level value is a node of its own; without a weight a node counts
``default_weight``, and with weight 0 it gets nothing; ties in the order go to the smaller id;
a repeated row is taken as often as it stands there; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that name a slice.
SLICE_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """Weights by level and value, the budget and the order."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default_weight: int = 1
    #: Tokens wanted, as a share of all there are.
    share: tuple[int, int] = (1, 1)
    max_epochs: int = 2
    seed: str = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    value = F.lit(mix.default_weight)
    for name, weight in sorted(mix.weights.get(level, {}).items()):
        value = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(weight)).otherwise(value)
    return value.cast("long")


def _same(left: str, right: str, names: list[str]) -> Column:
    """Equality of level values in which null equals null."""
    found = F.lit(True)
    for name in names:
        found = found & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return found


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """The ``leaves`` (levels, tokens) with their ``budget``; a row for each leaf."""
    levels = list(mix.levels)
    # A leaf with weight 0 on its path holds nothing for its ancestors either.
    usable = F.lit(True)
    for level in levels:
        usable = usable & (_weight(level, mix) > 0)
    held_by_leaf = F.when(usable, F.col("tokens") * mix.max_epochs).otherwise(0)
    capacity = F.sum(held_by_leaf).cast("long").alias("capacity")
    wanted, of = mix.share
    parents = leaves.agg(
        F.least(
            F.expr(f"coalesce(sum(tokens), 0) * {wanted} div {of}"),
            F.coalesce(F.sum(held_by_leaf), F.lit(0)),
        ).cast("long").alias("given")
    )
    above: list[str] = []
    for level in levels:
        names = [*above, level]
        nodes = leaves.groupBy(*names).agg(capacity).withColumn("weight", _weight(level, mix))
        if above:
            nodes = nodes.alias("n").join(parents.alias("p"), _same("n", "p", above)).select("n.*", "p.given")
        else:
            nodes = nodes.crossJoin(F.broadcast(parents))  # one row, the root
        fill = Window.partitionBy(*above, F.lit(0)).orderBy(
            F.expr("CASE WHEN weight > 0 THEN capacity / weight ELSE -1 END"), F.col(level).asc_nulls_first()
        )
        before = fill.rowsBetween(Window.unboundedPreceding, -1)
        rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        held = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)
        whole = Window.partitionBy(*above, F.lit(0))
        nodes = (
            nodes.withColumn("left", F.col("given") - F.coalesce(F.sum(held).over(before), F.lit(0)))
            .withColumn("among", F.sum("weight").over(rest))
            .withColumn("full", F.expr("weight > 0 AND capacity * among <= left * weight"))
            # The first child that does not get full sets the level for all after it.
            .withColumn("level", F.min(F.expr("CASE WHEN weight > 0 AND NOT full THEN struct(capacity / weight, left, among) END")).over(whole))
            .withColumn(
                "given",
                F.expr("""CASE WHEN weight = 0 THEN 0 WHEN full THEN capacity
                          ELSE least(capacity, level.left * weight div level.among) END""").cast("long"),
            )
        )
        parents = nodes.select(*names, "given")
        above = names
    return leaves.alias("l").join(parents.alias("p"), _same("l", "p", levels)).select("l.*", F.col("p.given").alias("budget"))


def select_mix(docs: DataFrame, mix: Mix) -> DataFrame:
    """(doc_id, levels, epoch, n_tokens, start, taken): the documents of each leaf's token-prefix.

    ``docs`` has doc_id, text and the level columns. ``start`` counts the leaf's tokens before the
    document, over all epochs; ``taken`` is below n_tokens only where the budget ends.
    """
    levels = list(mix.levels)
    sized = docs.select("doc_id", *levels, word_count(F.col("text")).alias("n_tokens"))
    leaves = sized.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    budgets = (
        leaf_budgets(leaves, mix)
        .where("budget > 0")
        .select(
            *levels, "budget", "tokens",
            F.explode(F.expr(f"sequence(0, least({mix.max_epochs} - 1, int((budget - 1) div tokens)))")).alias("epoch"),
        )
        .withColumn("quota", F.expr("least(tokens, budget - epoch * tokens)"))
    )
    order = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("epoch").cast("string"), F.col("doc_id").cast("string")))
    ranked = (
        sized.alias("d").join(budgets.alias("b"), _same("d", "b", levels))
        .select("d.*", "b.epoch", "b.quota", "b.tokens")
        .withColumn("order", order)
        .withColumn("slice", F.substring("order", 1, SLICE_DIGITS))
    )
    group = [*levels, "epoch"]
    slices = ranked.groupBy(*group, "slice").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*group, "slice").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranked.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("r")
        .join(slices.alias("s"), _same("r", "s", [*group, "slice"]))
        .select("r.*", (F.col("s.before") + F.col("r.within")).alias("at"))
    )
    return placed.where("at < quota").select(
        "doc_id", *levels, F.col("epoch").cast("int").alias("epoch"), "n_tokens",
        (F.col("epoch") * F.col("tokens") + F.col("at")).cast("long").alias("start"),
        F.expr("least(n_tokens, quota - at)").cast("long").alias("taken"),
    )


def with_domain(docs: DataFrame) -> DataFrame:
    """Sources grouped into three domains by their last character."""
    return docs.withColumn("domain", F.expr("concat('domain', ascii(right(source, 1)) % 3)"))
