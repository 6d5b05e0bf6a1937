"""Runs over what is new: each input file is taken once, tracked by a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioline.operators.cost import COSTS, TOKENS
from folioline.session import written
from folioline.streaming import kept
from folioline.streaming.stateful import change_sums, cost_changes, exact_items, keyed_state, whole_documents

_MONEY = "decimal(38,12)"


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Take what is there, batch by batch, and stop."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def process_new(
    rows: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> None:
    """Run a batch operator over the unseen files of a stream, until none is left.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/done/batch={batch_id}")

    _run(rows, write, checkpoint)


def process_documents(
    rows: DataFrame,
    operator: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    page: str = "page",
    wanted: str = "page_count",
    arrived: str | None = None,
    give_up: str = "1 day",
) -> None:
    """``process_new`` for operators that need all pages of a document.

    Documents wait until they have as many pages as ``wanted`` says; with a time ``arrived``, what has
    come after ``give_up`` goes to ``{out}/given_up``, unprocessed. Without a time pages wait in tables
    beside the checkpoint's own (``kept``), with one in keyed state, which needs a call for each document.
    A checkpoint that has keyed state goes on with it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        whole = written(batch, "whole")
        operator(whole.where("NOT gave_up").drop("gave_up")).write.mode("overwrite").parquet(f"{out}/done/batch={batch_id}")
        whole.where("gave_up").drop("gave_up").write.mode("overwrite").parquet(f"{out}/given_up/batch={batch_id}")

    waiting = kept.WaitingPages(f"{checkpoint}/kept", rows.schema, page, wanted)

    def write_whole(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        operator(waiting.take(batch, batch_id)).write.mode("overwrite").parquet(f"{out}/done/batch={batch_id}")
        batch.limit(0).write.mode("overwrite").parquet(f"{out}/given_up/batch={batch_id}")
        waiting.forget_whole(spark, batch_id)

    if arrived is None and not kept.there_is(rows.sparkSession, f"{checkpoint}/state"):
        _run(rows, write_whole, checkpoint)
        return
    with keyed_state(rows.sparkSession):
        _run(whole_documents(rows, page, wanted, arrived, give_up), write, checkpoint)


def read_given_up(spark: SparkSession, out: str) -> DataFrame:
    """Pages of documents that stayed incomplete for too long."""
    return spark.read.parquet(f"{out}/given_up").drop("batch")


def read_done(spark: SparkSession, out: str) -> DataFrame:
    """What ``process_new`` has made of complete documents so far."""
    return spark.read.parquet(f"{out}/done").drop("batch")


def live_costs(priced: DataFrame) -> DataFrame:
    """Running totals by model; the state is one row per model."""
    return priced.groupBy("model").agg(
        *[F.sum(F.coalesce(t, F.lit(0))).cast("bigint").alias(t) for t in TOKENS],
        *[F.sum(F.coalesce(F.col(c), F.lit(0.0)).cast(_MONEY)).alias(c) for c in COSTS],
        F.count(F.lit(1)).alias("calls"),
    )


def refresh_costs(priced: DataFrame, out: str, checkpoint: str) -> None:
    """Bring the totals up to date and keep each refresh as one folder."""

    def write(totals: DataFrame, batch_id: int) -> None:
        money = [F.col(c).cast("double").alias(c) for c in COSTS]
        plain = totals.select("model", *TOKENS, *money, "calls")
        plain.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(live_costs(priced), write, checkpoint, mode="complete")


def refresh_record_costs(records: DataFrame, out: str, checkpoint: str) -> None:
    """Totals by model over the latest version of each record, brought up to date per batch.

    A record that is processed again counts once: its earlier costs are taken back. Each batch adds
    its changes to the totals of the batch before and keeps them as a folder, a row per model. The
    latest versions are tables beside the checkpoint's own (``kept``); a checkpoint that has keyed
    state goes on with it.
    """
    spark = records.sparkSession

    def write(changes: DataFrame, batch_id: int) -> None:
        totals = changes.groupBy("model").agg(*change_sums())
        if batch_id:
            earlier = spark.read.parquet(f"{out}/batch={batch_id - 1}")
            totals = totals.unionByName(earlier).groupBy("model").agg(
                *[F.sum(c).cast(totals.schema[c].dataType).alias(c) for c in totals.columns if c != "model"]
            )
        totals.where("calls != 0").coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    latest = kept.LatestCosts(f"{checkpoint}/kept")

    def write_latest(batch: DataFrame, batch_id: int) -> None:
        taken = latest.take(batch, batch_id, exact_items(F.col("items")))
        sides = [taken.select(F.lit(sign).alias("sign"), F.inline(side)) for sign, side in ((1, "items"), (-1, "earlier"))]
        write(sides[0].unionByName(sides[1]) if batch_id else sides[0], batch_id)

    if not kept.there_is(spark, f"{checkpoint}/state"):
        _run(records, write_latest, checkpoint)
        return
    with keyed_state(spark):
        _run(cost_changes(records), write, checkpoint)


def latest_record_costs(spark: SparkSession, out: str) -> DataFrame:
    totals = latest_costs(spark, out)
    return totals.select("model", *TOKENS, *[F.col(c).cast("double").alias(c) for c in COSTS], "calls")


def latest_costs(spark: SparkSession, out: str) -> DataFrame:
    """Totals of the last refresh."""
    # A folder per refresh: its name tells the last one, no earlier one is read.
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    last = max(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))
    return spark.read.parquet(f"{out}/batch={last}")
