"""What a stream keeps between its batches, as tables: pages that wait, latest costs of records.

Each batch stores what it adds as a run, and reads the runs of the batches before; steps are those of
plain tables, without a call for each key. Sixteen runs become one, and sixteen of those, so that a
row is written a few times at most, few runs are read and what is over goes. Which runs there are
follows from the number of the batch: one that is repeated after a failure reads what it read before,
and writes its own run again.

Defined results are those of ``stateful``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioline.session import discard, scaled, written

#: Runs that are merged into one.
FAN = 16
#: From so many kept rows for each new one the keys of the new ones are looked up first.
FEW_NEW = 16


def runs_before(batch: int) -> list[tuple[int, int]]:
    """(first batch, number of batches) of the runs that a batch reads, oldest first."""
    size, found, start = 1, [], 0
    while size * FAN <= batch:
        size *= FAN
    while size:
        while start + size <= batch:
            found.append((start, size))
            start += size
        size //= FAN
    return found


def merged_after(batch: int) -> int:
    """How many batches, itself included, a batch merges into one run: 1 for none."""
    size = 1
    while (batch + 1) % (size * FAN) == 0:
        size *= FAN
    return size


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def there_is(spark: SparkSession, path: str) -> bool:
    system, place = _folder(spark, path)
    return system.exists(place)


class Kept:
    """The runs of a stream below a folder, and the schema of their rows."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def at(self, run: tuple[int, int]) -> str:
        return f"{self.path}/{run[0]}-{run[1]}"

    def read(self, spark: SparkSession, runs: list[tuple[int, int]]) -> DataFrame:
        reader = spark.read.schema(self.schema)
        return reduce(DataFrame.unionByName, [reader.parquet(self.at(run)) for run in runs])

    def tidy(self, spark: SparkSession, batch: int) -> None:
        """Remove runs that merged ones have replaced; the batch that merged them has ended."""
        system, place = _folder(spark, self.path)
        if not system.exists(place):
            return
        wanted = {f"{first}-{size}" for first, size in runs_before(batch)}
        for status in system.listStatus(place):
            name = status.getPath().getName()
            if name not in wanted and int(name.split("-")[0]) < batch:
                system.delete(status.getPath(), True)

    def merge(self, spark: SparkSession, batch: int, merged) -> None:
        """Store what is left of the last runs as one, if it is time: ``merged`` makes it of their rows."""
        size = merged_after(batch)
        if size > 1:
            first = batch + 1 - size
            runs = [run for run in runs_before(batch) if run[0] >= first] + [(batch, 1)]
            self._write(merged(self.read(spark, runs), first == 0), (first, size))

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        rows.write.mode("overwrite").parquet(self.at(run))


def _of_new_keys(known: DataFrame, new: DataFrame, rows: int, key: str) -> DataFrame:
    """Kept rows; of very many only those with a key that the new rows have."""
    if known.count() < FEW_NEW * rows:
        return known
    keys = new.select(F.col(key).alias("_key")).distinct()
    return known.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


class WaitingPages(Kept):
    """Pages that wait until their document is whole.

    A run has the pages that came in its batch and still wait (``_to`` is waits), and the documents
    that became whole with pages of earlier runs (done), whose rows up to then are over.
    """

    def __init__(self, path: str, rows: T.StructType, page: str, wanted: str, key: str = "document"):
        own = "_batch bigint, _order bigint, _wanted bigint, _to string"
        super().__init__(path, T.StructType([*rows.fields, *T.StructType.fromDDL(own).fields]))
        self.rows, self.page, self.wanted, self.key = rows, page, wanted, key

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        rows.write.mode("overwrite").partitionBy("_to").parquet(self.at(run))

    def _looked(self, rows: DataFrame) -> DataFrame:
        """Rows by document and page, the latest of a page first: is it that one, and is it not over."""
        key, latest = f"PARTITION BY `{self.key}`", "_batch DESC, _order DESC"
        # All windows go along one order of a document's rows.
        first = rows.withColumn("_first", F.expr(f"row_number() OVER ({key} ORDER BY `{self.page}`, {latest}) = 1"))
        placed = first.withColumn("_nth", F.expr(f"row_number() OVER ({key}, `{self.page}` ORDER BY {latest})"))
        ended = placed.withColumn("_ended", F.expr(f"coalesce(max(if(_to = 'done', _batch, NULL)) OVER ({key}), -1)"))
        return ended.withColumn("_live", F.expr("_to != 'done' AND _batch > _ended"))

    def take(self, batch: DataFrame, number: int) -> DataFrame:
        """Keep the pages of a batch, and give those of the documents that are whole with it."""
        spark = batch.sparkSession
        self.tidy(spark, number)
        new = written(
            batch.select(
                *self.rows.names, F.lit(number).cast("bigint").alias("_batch"), F.monotonically_increasing_id().alias("_order"),
                F.coalesce(F.col(self.wanted), F.lit(0)).cast("bigint").alias("_wanted"), F.lit("waits").alias("_to"),
            ),
            "arrived",
        )
        every, rows, before = new, new.count(), runs_before(number)
        if before:
            known = self.read(spark, before).where("_to != 'whole'")
            every = new.unionByName(_of_new_keys(known, new, rows, self.key))
            rows += known.count()
        scaled(spark, rows)
        over = f"OVER (PARTITION BY `{self.key}`)"
        tallied = self._looked(every).withColumns({
            "_arrived": F.expr(f"count_if(_live AND _nth = 1) {over}"),
            "_wanted": F.expr(f"max(if(_live, _wanted, 0)) {over}"),
            "_oldest": F.expr(f"min(if(_live, _batch, NULL)) {over}"),
            "_newest": F.expr(f"max(_batch) {over}"),
        })
        whole = "_wanted > 0 AND _wanted <= _arrived"
        to = F.expr(
            f"array_compact(array(if({whole} AND _live AND _nth = 1, 'whole', NULL),"
            f" if(NOT ({whole}) AND _batch = {number} AND _nth = 1, 'waits', NULL),"
            f" if({whole} AND _first AND _oldest < {number}, 'done', NULL)))"
        )
        decided = tallied.where(f"_newest = {number}").select(
            *self.rows.names, F.lit(number).cast("bigint").alias("_batch"), "_order", "_wanted", F.explode(to).alias("_to")
        )
        own = (number, 1)
        self._write(decided, own)
        discard(new)
        self.merge(spark, number, self._left)
        return self.read(spark, [own]).where("_to = 'whole'").select(*self.rows.names)

    def _left(self, rows: DataFrame, all_runs: bool) -> DataFrame:
        """Pages that still wait, and the ends of documents that runs before these may have pages of."""
        looked = self._looked(rows.where("_to != 'whole'"))
        tallied = looked.withColumn("_wanted", F.expr(f"max(if(_live, _wanted, 0)) OVER (PARTITION BY `{self.key}`)"))
        kept = "_live AND _nth = 1" if all_runs else "_live AND _nth = 1 OR _to = 'done' AND _batch = _ended"
        return tallied.where(kept).select(self.schema.names)

    def forget_whole(self, spark: SparkSession, number: int) -> None:
        """The documents that ``take`` gave are no longer needed."""
        system, place = _folder(spark, f"{self.at((number, 1))}/_to=whole")
        system.delete(place, True)


class LatestCosts(Kept):
    """The latest version of each record, with its items."""

    def __init__(self, path: str):
        super().__init__(path, T.StructType())

    def take(self, batch: DataFrame, number: int, items: Column) -> DataFrame:
        """Keep the versions of a batch that are above the known ones.

        Gives (items, earlier): of each such record what counts now and what counted before. ``items``
        makes them of a record's own once its newest version is known.
        """
        spark = batch.sparkSession
        self.tidy(spark, number)
        rows = batch.select("record", F.col("version").cast("long").alias("version"), "items").where("version IS NOT NULL")
        count = rows.count()
        scaled(spark, count)
        # Of equal versions the first read counts.
        placed = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_place", F.struct("version", -F.col("_id")))
        newest = placed.groupBy("record").agg(F.max("version").alias("version"), F.max_by("items", "_place").alias("items"))
        newest = newest.select("record", "version", items.alias("items"))
        self.schema, kind = newest.schema, newest.schema["items"].dataType
        before = runs_before(number)
        if before:
            known = _of_new_keys(self.read(spark, before), rows, count, "record")
            both = newest.withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)))
            old, new = (F.when(side, F.col("version")) for side in (~F.col("_new"), F.col("_new")))
            sides = both.groupBy("record").agg(
                F.max(new).alias("version"), F.max(old).alias("_known"),
                F.max_by("items", new).alias("items"), F.max_by("items", old).alias("earlier"),
            )
            newest = sides.where("version IS NOT NULL AND (_known IS NULL OR version > _known)").drop("_known")
        else:
            newest = newest.withColumn("earlier", F.lit(None).cast(kind))
        own = (number, 1)
        self._write(newest, own)
        self.merge(spark, number, _latest)
        taken = T.StructType([T.StructField("items", kind), T.StructField("earlier", kind)])
        return spark.read.schema(taken).parquet(self.at(own))


def _latest(rows: DataFrame, _: bool) -> DataFrame:
    return rows.groupBy("record").agg(F.max("version").alias("version"), F.max_by("items", "version").alias("items"))
