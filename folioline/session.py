"""Session settings and the shared scratch folder."""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "folioline") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()
#: Attribute of a stored table: its folder.
_STORED_AT = "_folioline_stored_at"


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, as ``--py-files`` would; once per application.

    Spark copies the archive to the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='folioline-')}/folioline", "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the checkpoint folder that all executors can reach.

    Only a local master, where driver and executors share one disk, may fall back
    to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="folioline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Store a table in the shared folder and read it back.

    For a step whose result several later steps read: without it each of them would run
    the step again. Unlike a cache it outlives a lost executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__[_STORED_AT] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove what ``written`` stored for these tables, once no later step reads them."""
    for table in tables:
        path = table.__dict__.pop(_STORED_AT, None)
        if path is not None:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a costly step's input only if its files leave cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Rows that a task of a shuffle is given on average, at most.
TASK_ROWS = 250_000


def scaled(spark: SparkSession, rows: int) -> int:
    """Let the number of shuffle partitions grow with a table's rows; it is never lowered.

    Spark reads the setting when it plans a query, so it stays on for the session. Adaptive
    execution joins partitions that turn out small.
    """
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = math.ceil(rows / TASK_ROWS)
    if wanted > now:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return max(now, wanted)


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The rows by key, ``TASK_ROWS`` to a task, for steps that sort what they get.

    Tables of fewer tasks than cores stay as they are, to be shuffled as usual.
    """
    wanted = math.ceil(rows / TASK_ROWS)
    return df.repartition(wanted, *keys) if wanted > df.sparkSession.sparkContext.defaultParallelism else df
