"""Removal of word windows that occur more than once in the corpus.

Every window of ``width`` words has a Rabin-Karp hash, from running sums over word hashes.
To count all of them Spark need not move all of them:

1. In each window the 12-word stretch with the smallest hash is its anchor; neighbouring
   windows mostly share theirs. A repeated window repeats its anchor, at the same place in
   it. So only anchors that occur twice matter, and one row stands for a run of windows
   with one anchor: (anchor hash, hash of all words of the run, document, place).
2. Equal runs repeat all their windows. Where one anchor has different runs (at the ends
   of copied passages), one of each kind is looked at window by window, with 128-bit hashes.
3. Repeated windows merge into maximal intervals of words, which are cut out.

Before each shuffle a task keeps one row of each hash, so that a passage found in a third of
all documents reaches a reducer once per task.

Defined results: null or empty text has no words; a text shorter than the window stays whole;
windows are judged on the input; kept words are joined by one space; a repeated row repeats
all its windows; rows without id, and rows whose id has several texts, go by a hash of id and text;
an empty table gives an empty result; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioline.llm.hashing import U64, Words, mixed, pieces, running_hash, stretch_hash, words
from folioline.session import discard, ship_package, written

#: Words of an anchor; at most the window.
ANCHOR = 12
_PLACE = U64((1 << 24) - 1)
#: A run has at most this many windows: places and lengths share one number.
_LENGTHS = 64
#: Rows that a task gathers before it passes them on.
GATHER = 1 << 20


def _sliding_least(keys: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` neighbours."""
    span = 1
    while 2 * span <= size:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: keys.size - (size - span)], keys[size - span :]) if size > span else keys


def runs(found: Words, width: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, run hash, document row, first window, windows) of runs with one anchor."""
    n = found.hashes.size
    if n < width:
        return tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64))
    anchor_words = min(ANCHOR, width)
    running = running_hash(found.hashes)
    at = np.arange(n - anchor_words + 1)
    grams = stretch_hash(running, at, at + anchor_words)
    keys = (grams & ~_PLACE) | (at.astype(U64) & _PLACE)
    least = _sliding_least(keys, width - anchor_words + 1)
    starts = np.arange(n - width + 1)
    doc = np.searchsorted(found.first, starts, side="right") - 1
    starts = starts[starts + width <= found.first[doc + 1]]
    anchor = starts + ((least[starts] - starts.astype(U64)) & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if starts.size else starts
    length = np.diff(np.concatenate([head, [starts.size]]))
    first, anchor = starts[head], anchor[head]
    whole = stretch_hash(running, first, first + length - 1 + width)
    run = mixed(whole ^ mixed((anchor - first).astype(U64) * U64(_LENGTHS) + length.astype(U64)))
    doc = np.searchsorted(found.first, first, side="right") - 1
    return grams[anchor], run, doc, first - found.first[doc], length


def _once_per_task(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows (key1, key2, doc, span) with equal keys: the first goes on with its count, and all
    of them are known to be repeated (rows with null keys)."""
    if not parts:
        return
    one, two, doc, span = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((span, doc, two, one))
    one, two, doc, span = one[order], two[order], doc[order], span[order]
    if not one.size:
        return
    head = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    count = np.diff(np.concatenate([head, [one.size]]))
    again = np.repeat(count > 1, count)
    for rows, keyed in ((head, True), (np.flatnonzero(again), False)):
        for at in range(0, rows.size, 1 << 16):
            own = rows[at : at + (1 << 16)]
            keys = [pa.array(k[own].view(np.int64)) if keyed else pa.nulls(own.size, pa.int64()) for k in (one, two)]
            repeated = count[at : at + (1 << 16)] > 1 if keyed else np.ones(own.size, bool)
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(doc[own]), pa.array(span[own]), pa.array(repeated)], names=names
            )


_RUN_NAMES = ["anchor", "run", "doc_id", "span", "again"]
_WINDOW_NAMES = ["h1", "h2", "doc_id", "span", "again"]


def _run_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, end, data, offsets in pieces(batch.column("text")):
                anchor, whole, doc, first, length = runs(words(data, offsets), width)
                parts.append((anchor, whole, ids[row:end][doc], first * _LENGTHS + length))
                held += anchor.size
                if held > GATHER:
                    yield from _once_per_task(parts, _RUN_NAMES)
                    parts, held = [], 0
        yield from _once_per_task(parts, _RUN_NAMES)

    return run


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            spans = batch.column("spans")
            for row, end, data, offsets in pieces(batch.column("text")):
                found = words(data, offsets)
                lists = spans.slice(row, end - row)
                span = lists.flatten().to_numpy()
                doc = np.repeat(np.arange(end - row), np.diff(lists.offsets.to_numpy()))
                length = span % _LENGTHS
                start = np.repeat(span // _LENGTHS, length)
                start += np.arange(start.size) - np.repeat(np.cumsum(length) - length, length)
                doc = np.repeat(doc, length)
                at = found.first[doc] + start
                h1, h2 = (stretch_hash(running_hash(found.hashes, i), at, at + width) for i in (0, 1))
                parts.append((h1, h2, ids[row:end][doc], start * _LENGTHS + 1))
                held += start.size
                if held > GATHER:
                    yield from _once_per_task(parts, _WINDOW_NAMES)
                    parts, held = [], 0
        yield from _once_per_task(parts, _WINDOW_NAMES)

    return run


def cut(found: Words, offsets: np.ndarray, keep: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each document's kept words, joined by one space; ``whole`` ones unchanged."""
    size = found.data.size
    kept = np.zeros(size + 1, dtype=np.int8)
    np.add.at(kept, found.starts[keep], 1)
    np.add.at(kept, found.ends[keep], -1)
    kept = np.cumsum(kept, dtype=np.int8)[:size].astype(bool)
    # One byte after each kept word becomes its space, but not after a document's last.
    number = np.flatnonzero(keep)
    doc = np.searchsorted(found.first, number, side="right") - 1
    goes_on = number[:-1][(doc[1:] == doc[:-1]) & ~whole[doc[1:]]] if number.size else number
    text = found.data.copy()
    text[found.ends[goes_on]] = 0x20
    kept[found.ends[goes_on]] = True
    kept |= np.repeat(whole, np.diff(offsets))
    lengths = np.concatenate([[0], np.cumsum(kept)])
    return text[kept], lengths[offsets]


def _cut_rows(width: int, keep_layout: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").fill_null([])
            rows = batch.column("row")
            for row, end, data, offsets in pieces(batch.column("text")):
                found = words(data, offsets)
                lists = spans.slice(row, end - row)
                span = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(end - row), np.diff(lists.offsets.to_numpy()))
                gone = np.zeros(found.hashes.size + 1, dtype=np.int64)
                start = found.first[doc] + span // _LENGTHS
                np.add.at(gone, start, 1)
                np.add.at(gone, start + span % _LENGTHS - 1 + width, -1)
                keep = np.cumsum(gone)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[found.first]
                n = np.diff(found.first)
                text, bounds = cut(found, offsets, keep, keep_layout & (np.diff(kept) == n))
                column = pa.LargeStringArray.from_buffers(
                    end - row, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text)
                ).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(row, end - row), column, pa.array(n), pa.array(n - np.diff(kept))],
                    names=["row", "text", "n_words", "n_removed"],
                )

    return run


def row_key(*content: str) -> Column:
    """A row's ``doc_id``; without one a negative hash of its content."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(*content).bitwiseOR(F.lit(-(1 << 63))))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, text, doc_id): ``doc_id`` is the row's key, which one text has only."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"), row_key("text").alias("doc_id"))
    versions = packed.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    # Written, so that Spark knows that they are few and moves no texts for them.
    several = written(versions.where("low != high").select("doc_id", F.lit(True).alias("several")), "several")
    hashed = F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(1 << 63)))
    return packed.join(several, "doc_id", "left").select(
        "row", "text", F.when(F.col("several"), hashed).otherwise(F.col("doc_id")).alias("doc_id")
    )


def removal_spans(named: DataFrame, width: int = 35) -> DataFrame:
    """(doc_id, spans): runs of repeated windows of each document of (doc_id, text) that has any.

    A span is first window * 64 + number of windows. Rows with equal ids must have equal texts.
    """
    if not ANCHOR <= width < ANCHOR + _LENGTHS - 1:
        raise ValueError(f"width must be {ANCHOR} to {ANCHOR + _LENGTHS - 2}")
    ship_package(named.sparkSession)
    rows = written(
        named.mapInArrow(_run_rows(width), "anchor long, run long, doc_id long, span long, again boolean"), "runs"
    )
    judged = (
        rows.where("anchor IS NOT NULL")
        .repartition("anchor")
        .selectExpr(
            "doc_id", "span", "again",
            "max(again) OVER (PARTITION BY anchor, run) OR count(*) OVER (PARTITION BY anchor, run) > 1 AS repeated",
            "row_number() OVER (PARTITION BY anchor, run ORDER BY doc_id, span) = 1 AS leading",
            "min(run) OVER (PARTITION BY anchor) != max(run) OVER (PARTITION BY anchor) AS varied",
        )
        .where("repeated OR varied")
    )
    judged = written(judged, "judged")
    # Of equal runs one stands for all where another run has the same anchor.
    open_runs = judged.where("varied AND leading").groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    windows = written(
        named.join(open_runs, "doc_id").mapInArrow(
            _window_rows(width), "h1 long, h2 long, doc_id long, span long, again boolean"
        ),
        "windows",
    )
    across = (
        windows.where("h1 IS NOT NULL")
        .selectExpr("doc_id", "span", "count(*) OVER (PARTITION BY h1, h2) AS n")
        .where("n > 1")
        .select("doc_id", "span")
    )
    repeated = (
        judged.where("repeated").select("doc_id", "span")
        .unionByName(rows.where("anchor IS NULL").select("doc_id", "span"))
        .unionByName(windows.where("h1 IS NULL").select("doc_id", "span"))
        .unionByName(across)
    )
    spans = written(repeated.groupBy("doc_id").agg(F.collect_set("span").alias("spans")), "spans")
    discard(rows, judged, windows)
    return spans


def cut_repeats(docs: DataFrame, width: int = 35, keep_layout: bool = False) -> DataFrame:
    """The documents with ``text`` cut to its kept words, and ``n_words`` and ``n_removed`` longs.

    With ``keep_layout`` a text that loses nothing stays as it is. Columns of the input named
    ``n_words`` or ``n_removed`` are replaced.
    """
    keyed = _keyed(docs)
    spans = removal_spans(keyed.select("doc_id", "text"), width)
    joined = keyed.join(spans, "doc_id", "left").select("row", "text", "spans")
    out = T.StructType([
        joined.schema["row"], T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    ])
    made = joined.mapInArrow(_cut_rows(width, keep_layout), out)
    order = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    return made.select(
        *[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in order], "n_words", "n_removed"
    )
