"""Streams with keyed state: documents that wait for their pages, records that replace earlier ones.

The state lives in Spark's RocksDB store: a batch writes the pages that it brings and no others,
however many wait, and a document of any number of pages is never a single value.

Defined results: rows without key are a key of their own; a page that comes again replaces the one
that waits; a wanted number that is null or 0 is not known yet, so the document waits until its time
is up; a record version that is not above the known one changes nothing, and of equal versions in one
batch the first read counts; an empty stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Pages of a document that wait in one value.
FEW_PAGES = 64


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that start inside keep state in RocksDB; the session's own setting is put back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


class _Waiting(StatefulProcessor):
    """Holds a document's pages until as many are there as wanted, or its time is up.

    A call to the state store costs far more than a row. So up to ``FEW_PAGES`` pages wait in one value
    with their numbers, which is read and written once a batch; more are kept one by one.
    """

    def __init__(self, schema: T.StructType, page: str, wanted: str, arrived: str | None):
        self.schema, self.page, self.wanted, self.arrived = schema, page, wanted, arrived
        self.place = schema.names.index(page)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        key = T.StructType([T.StructField("page", self.schema[self.page].dataType)])
        self.pages = handle.getMapState("pages", key, self.schema)
        numbers = [T.StructField(name, T.LongType()) for name in ("arrived", "wanted", "timer")]
        # Null for a document whose pages are kept one by one.
        few = T.StructField("few", T.ArrayType(self.schema))
        self.tally = handle.getValueState("tally", T.StructType([*numbers, few]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.tally.get()
        arrived, wanted, timer, few = known or (0, 0, None, [])
        if few is not None:
            few = {page[self.place]: tuple(page) for page in few}
        first = None
        for row in rows:
            if few is not None:
                few[row[self.page]] = tuple(row)
                arrived = len(few)
                if arrived > FEW_PAGES:
                    for place, value in few.items():
                        self.pages.updateValue((place,), value)
                    few = None
            else:
                place = (row[self.page],)
                arrived += not self.pages.containsKey(place)
                self.pages.updateValue(place, tuple(row))
            wanted = max(wanted, row[self.wanted] or 0)
            if self.arrived and row[self.arrived] is not None:
                at = int(row[self.arrived].timestamp() * 1000)
                first = at if first is None else min(first, at)
        if 0 < wanted <= arrived:
            if timer is not None:
                self.handle.deleteTimer(timer)
            yield from self._all(few, False)
            if known:
                self.tally.clear()
            return
        if timer is None and first is not None:
            timer = first
            self.handle.registerTimer(timer)
        self.tally.update((arrived, wanted, timer, None if few is None else list(few.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.tally.get()
        if known:
            few = known[3]
            yield from self._all(None if few is None else {p[self.place]: tuple(p) for p in few}, True)
            self.tally.clear()

    def _all(self, few: dict | None, gave_up: bool) -> Iterator[Row]:
        make = Row(*self.schema.names, "gave_up")
        for value in self.pages.values() if few is None else few.values():
            yield make(*value, gave_up)
        if few is None:
            self.pages.clear()

    def close(self) -> None:
        pass


def whole_documents(
    rows: DataFrame, page: str = "page", wanted: str = "page_count", arrived: str | None = None,
    give_up: str = "1 day", key: str = "document",
) -> DataFrame:
    """The rows of a stream, document by document: once all pages are there, or when the newest
    ``arrived`` of the stream is ``give_up`` after the document's first (then ``gave_up`` is true).

    ``arrived`` is the time at which a page reached the stream, such as its file's; without it
    documents wait for ever. Times come from the rows and not from the clock, so a run that is
    repeated gives up the same documents; pages older than ``give_up`` when they come are late and
    left out by the watermark.
    """
    out = T.StructType([*rows.schema.fields, T.StructField("gave_up", T.BooleanType())])
    if arrived:
        rows = rows.withWatermark(arrived, give_up)
    return rows.groupBy(key).transformWithState(
        statefulProcessor=_Waiting(rows.schema, page, wanted, arrived),
        outputStructType=out, outputMode="Append", timeMode="EventTime" if arrived else "None",
    )


_ITEM = "model string, input_tokens long, output_tokens long, input_cost string, output_cost string, total_cost string"
_NUMBERS = ("input_tokens", "output_tokens", "input_cost", "output_cost", "total_cost")
MONEY = "decimal(38,12)"


_CHANGE = Row("sign", "model", *_NUMBERS)


def _values(item) -> tuple:
    """Of a struct, whether it comes as a row or as a dictionary."""
    return tuple(item[name] for name in ("model", *_NUMBERS))


class _Versions(StatefulProcessor):
    """Keeps each record's latest costs; a later version takes the earlier ones back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", f"version long, items array<struct<{_ITEM}>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, items = self.latest.get() if self.latest.exists() else (None, [])
        newest = None
        for row in rows:
            if row.version is not None and (newest is None or row.version > newest.version):
                newest = row
        if newest is None or (version is not None and newest.version <= version):
            return
        for sign, own in ((-1, items), (1, newest.items)):
            for item in own or []:
                yield _CHANGE(sign, *_values(item))
        self.latest.update((newest.version, [_values(item) for item in newest.items or []]))

    def close(self) -> None:
        pass


def exact_items(items: Column, money: str = MONEY) -> Column:
    """Items of (model, tokens, costs): nothing counts 0, and amounts are decimals."""
    return F.transform(
        items,
        lambda x: F.struct(
            x["model"].alias("model"),
            *[F.coalesce(x[c], F.lit(0)).cast("long").alias(c) for c in _NUMBERS[:2]],
            *[F.coalesce(x[c], F.lit(0)).cast(MONEY).cast(money).alias(c) for c in _NUMBERS[2:]],
        ),
    )


def cost_changes(records: DataFrame) -> DataFrame:
    """(sign, model, tokens, costs): what each record version of a stream adds to the totals, and
    with sign -1 what it takes back.

    ``records`` has record, version (a long) and items: an array of (model, tokens, costs).
    """
    # As text the amounts are exact on their way through the state.
    items = exact_items(F.col("items"), "string")
    changes = (
        records.select("record", F.col("version").cast("long").alias("version"), items.alias("items"))
        .groupBy("record")
        .transformWithState(
            statefulProcessor=_Versions(), outputStructType=f"sign int, {_ITEM}", outputMode="Append", timeMode="None"
        )
    )
    return changes.select("sign", "model", *_NUMBERS[:2], *[F.col(c).cast(MONEY).alias(c) for c in _NUMBERS[2:]])


def change_sums() -> list:
    """What changes come to, by model."""
    return [
        # Not sign * amount: that product would have fewer decimals.
        *[F.sum(F.when(F.col("sign") < 0, -F.col(c)).otherwise(F.col(c))).alias(c) for c in _NUMBERS],
        F.sum("sign").cast("long").alias("calls"),
    ]
