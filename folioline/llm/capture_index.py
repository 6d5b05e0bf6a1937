"""WARC archives of pages and their capture index, merged from sorted runs.

*Writing.* Each task writes gzipped WARC files of at most ``ARCHIVE_BYTES`` into the shared folder, one
member per record. Of equal payloads of ``LEAST_BYTES`` or more the page with the smallest id
is a response, the others are revisits that refer to it. File names are new for every attempt, and
the table of files holds only what committed tasks wrote, so a lost executor leaves no half
archive in the index.

*Index.* Reading archives back verifies each payload against its digest. A task sorts at most
``RUN_ROWS`` captures at a time by URL key (host labels reversed), time and page and writes them
into the shared folder as a run: a file of small blocks. Loser trees merge at most ``FAN_IN`` runs at
once into longer ones, from files to a file, until no more than that many are left. The first
captures of all blocks give ranges of the whole order, so that a URL with a third of all
captures is split as well; a last loser tree per range merges that range's stretch of
every run. A merge holds one block of each run. Ranges follow each other, so the result is ordered as
a whole by (index_part, index_nth).

Defined results: null html is an empty payload; a null url has an empty key; a null time is
the start of 1970; a null page id is written and indexed but is never the first of a payload;
rows that repeat an id are records of their own with the same role; an empty table writes no archive
and gives an empty index; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioline.session import shared_dir, ship_package, written

LEAST_BYTES = 100
ARCHIVE_BYTES = 1 << 28
_CHUNK = 1 << 20
_PIECE = 1 << 14
#: Captures that a task sorts in memory, runs that a merge reads at once, captures of a range.
RUN_ROWS = 1 << 16
FAN_IN = 128
RANGE_ROWS = 1 << 20
#: Captures of a run's block: what a merge holds of each run.
BLOCK_ROWS = 512
_MOST_TASKS = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels from the right, then port, path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = ",".join(reversed(host.removeprefix("www.").split("."))) if host else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{f':{port}' if port and port not in (80, 443) else ''}){parts.path or '/'}{query}".lower()


def _stamp(seconds: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _header(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page: int | None, url: str | None, seconds: int, payload: bytes, digest: str, first: int | None) -> bytes:
    """A WARC record: a response with its payload, or a revisit of page ``first``."""
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Date", _stamp(seconds)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _header(url)))
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first is None:
        body += payload
    else:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


class _Archive:
    """A file of gzip members, renewed when it is full."""

    def __init__(self, folder: str):
        self.folder, self.done = folder, []
        self.stream, self.path, self.size, self.records = None, "", 0, 0

    def add(self, raw: bytes) -> None:
        if self.stream is None:
            self.path, self.size, self.records = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
            system, path = fs.FileSystem.from_uri(self.path)
            self.stream = system.open_output_stream(path, compression=None)
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.stream.write(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append((self.path, self.size, self.records))
            self.stream = None


def _write_rows(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder)
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "seconds", "payload", "digest", "first")], strict=True):
                archive.add(record(*[v.as_py() for v in row]))
        archive.close()
        path, size, records = zip(*archive.done, strict=True) if archive.done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(records, pa.int64())],
            names=["archive", "bytes", "records"],
        )

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html, seconds) and return the files: (archive, bytes, records)."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or shared_dir(spark, "archives")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("seconds").cast("long"), F.lit(0)).alias("seconds"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Minima come before the shuffle, so a payload of a third of all pages is no hot key here.
    groups = (
        rows.where(F.octet_length("payload") >= LEAST_BYTES)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL").select("digest", "first")
    )
    roles = rows.join(groups, "digest", "left").withColumn(
        "first", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    )
    return written(roles.mapInArrow(_write_rows(folder), "archive string, bytes long, records long"), "files")


def read_records(path: str) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of each record of a gzipped archive, one in memory at a time."""
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner, compression=None) as stream:
        offset, start, parts, unpacker = 0, 0, [], zlib.decompressobj(31)
        while chunk := memoryview(stream.read(_CHUNK)):
            at = 0
            while at < len(chunk):
                # What a record leaves of its last piece is copied, so pieces are short.
                piece = chunk[at : at + _PIECE]
                parts.append(unpacker.decompress(piece))
                taken = len(piece) - len(unpacker.unused_data)
                at, offset = at + taken, offset + taken
                if unpacker.eof:
                    raw = b"".join(parts)
                    head, _, tail = raw.partition(b"\r\n\r\n")
                    lines = head.decode().split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise ValueError(f"{path}: no record at {start}")
                    headers = dict(line.split(": ", 1) for line in lines[1:])
                    yield start, offset - start, headers, tail[: int(headers["Content-Length"])]
                    start, parts, unpacker = offset, [], zlib.decompressobj(31)
        if parts and any(parts):
            raise ValueError(f"{path}: cut off at {start}")


CAPTURES = (
    "archive string, url_key string, stamp string, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, offset long, length long"
)
_FIELDS = [f.split()[0] for f in CAPTURES.split(", ")]
_TYPES = [pa.string() if f.endswith("string") else pa.int64() for f in CAPTURES.split(", ")]


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _capture(path: str, offset: int, length: int, headers: dict[str, str], body: bytes) -> tuple:
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(headers["X-Payload-Length"])
    if headers["WARC-Type"] == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{path}: payload at {offset} is not what was written")
    url = headers.get("WARC-Target-URI")
    return (
        path, url_key(url), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), url, headers["WARC-Type"], size,
        digest, _page(headers.get("WARC-Refers-To")), offset, length,
    )


def _order(row: tuple) -> tuple:
    return row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[9]


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], size: int = 8192) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


#: A run's blocks with their first captures' place in the order.
_BLOCKS = "run string, url_key string, stamp string, has_page boolean, page long, archive string, offset long"
_BLOCK_FIELDS = [f.split()[0] for f in _BLOCKS.split(", ")]
_BLOCK_TYPES = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64()]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[column.to_pylist() for column in batch.columns], strict=True)


def _write_run(folder: str, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Write sorted captures as a new run; its blocks come out when the file is whole."""
    path, firsts = f"{folder}/{uuid.uuid4().hex}.arrow", []
    system, inner = fs.FileSystem.from_uri(path)
    schema = pa.schema(list(zip(_FIELDS, _TYPES, strict=True)))
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with system.open_output_stream(inner) as stream, pa.ipc.new_file(stream, schema, options=options) as run:
        for block in _batches(rows, _FIELDS, _TYPES, BLOCK_ROWS):
            firsts.append((path, *_order(next(_rows(block.slice(0, 1))))))
            run.write_batch(block)
    yield from _batches(firsts, _BLOCK_FIELDS, _BLOCK_TYPES)


def _read_run(path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """A run's captures from ``low`` up to before ``high``, one block in memory at a time."""
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as stream:
        run = pa.ipc.open_file(stream)
        count = run.num_record_batches

        def first(block: int) -> tuple:
            return _order(next(_rows(run.get_batch(block).slice(0, 1))))

        start = 0 if low is None else max(0, bisect_right(range(count), low, key=first) - 1)
        for block in range(start, count):
            for row in _rows(run.get_batch(block)):
                if high is not None and _order(row) >= high:
                    return
                if low is None or _order(row) >= low:
                    yield row


def _run_blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captures = (
            _capture(path, *found)
            for batch in batches for path in batch.column("archive").to_pylist() for found in read_records(path)
        )
        while held := list(islice(captures, RUN_ROWS)):
            yield from _write_run(folder, sorted(held, key=_order))

    return run


def _merge_groups(folder: str, fan_in: int):
    """Runs of one group become one; a group of more than ``fan_in`` becomes several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[str]] = {}
        for batch in batches:
            for name, path in _rows(batch):
                groups.setdefault(name, []).append(path)
        for paths in groups.values():
            for at in range(0, len(paths), fan_in):
                yield from _write_run(folder, LoserTree([_read_run(p) for p in sorted(paths[at : at + fan_in])]))

    return run


class LoserTree:
    """K-way merge: inner nodes hold the loser of their match, the winner is passed up."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * len(runs)
        self.winner = -1
        for leaf in range(len(runs)):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return (_order(self.heads[a]), a) < (_order(self.heads[b]), b)

    def _play(self, leaf: int) -> None:
        node, playing = (leaf + len(self.runs)) // 2, leaf
        while node:
            other = self.losers[node]
            if other < 0:
                # The first to come waits for its opponent.
                self.losers[node] = playing
                return
            if self._beats(other, playing):
                self.losers[node], playing = playing, other
            node //= 2
        self.winner = playing

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] is not None:
            leaf = self.winner
            yield self.heads[leaf]
            self.heads[leaf] = next(self.runs[leaf], None)
            self._play(leaf)


def _range_rows(paths: list[str]):
    """Merge the stretch of every run that lies in a task's ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *bounds in _rows(batch):
                low, high = (bound and tuple(bound.values()) for bound in bounds)
                merged = LoserTree([_read_run(p, low, high) for p in paths])
                rows = ((*row, part, nth) for nth, row in enumerate(merged))
                yield from _batches(rows, [*_FIELDS, "index_part", "index_nth"], [*_TYPES, pa.int32(), pa.int64()])

    return run


def capture_index(files: DataFrame, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index of archives (archive, ...): captures in global order of (index_part, index_nth).

    ``fan_in``, at least 4, bounds the runs that a merge reads at once.
    """
    spark = files.sparkSession
    ship_package(spark)
    folder = shared_dir(spark, "runs")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    # Rows are names of large files here, so partitions are asked for by number, not left to sizes.
    archives = files.select("archive")
    tasks = min(max(1, archives.count()), _MOST_TASKS)
    blocks = written(archives.repartition(tasks, "archive").mapInArrow(_run_blocks(folder), _BLOCKS), "blocks")
    while (runs := blocks.select("run").distinct().count()) > fan_in:
        groups = -(-2 * runs // fan_in)
        group = F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group")
        dealt = blocks.select("run").distinct().select(group, "run").repartition(min(groups, _MOST_TASKS), "group")
        blocks = written(dealt.mapInArrow(_merge_groups(folder, fan_in), _BLOCKS), "blocks")
    paths = sorted(r.run for r in blocks.select("run").distinct().collect())  # at most fan_in
    place = _BLOCK_FIELDS[1:]
    cores = spark.sparkContext.defaultParallelism
    n_blocks = blocks.count()
    wanted = max(1, min(cores, n_blocks), n_blocks * BLOCK_ROWS // range_rows)
    lows = (
        blocks.repartitionByRange(min(wanted, _MOST_TASKS), *place)
        .select(F.spark_partition_id().alias("part"), F.struct(*place).alias("low"))
        .groupBy("part").agg(F.min("low").alias("low"))
    )
    # One row a range: few enough for one window.
    ordered = Window.orderBy("low")
    ranges = written(
        lows.select(
            (F.row_number().over(ordered) - 1).cast("int").alias("index_part"), "low", F.lead("low").over(ordered).alias("high")
        ), "ranges",
    )
    dealt = ranges.repartitionByRange(min(wanted, _MOST_TASKS), "index_part")
    return dealt.mapInArrow(_range_rows(paths), f"{CAPTURES}, index_part int, index_nth long")
