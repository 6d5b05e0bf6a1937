"""Packing of tokenised documents into sequences by vector best fit.

A document's tokens (and one closing id) are cut only if they exceed a sequence; its first
piece is then the shorter one. A piece needs (tokens, 1 document, attention cost = tokens
squared); a sequence has a capacity in each of the three. Longest pieces first, each piece goes to
the open sequence that can hold it in all three and whose residual is left shortest (weighted
norm) or fits best (weighted dot product). With the default capacities only tokens can bind, as
pieces have at least one token and the squares of lengths sum to at most the square of their sum.

Pieces of one length are alike, so are sequences with equal residuals. The choice is
therefore made once for a whole class: the driver sees how many pieces there are of each
length, at most one number per token count, and moves whole classes of sequences. The plan
has a row for each step, and its size depends on the sequence length, not on the number of
documents. Tasks then find each piece's place by its number among those of its length.

Defined results: null text is an empty text; an empty text is the closing id alone; a
repeated row is packed again; a null id is kept; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioline.llm.hashing import pieces, stretch_keys
from folioline.session import ship_package, written

#: Stretches of text whose ids a task remembers.
REMEMBERED = 500_000
_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class StretchTokenizer:
    """Ids of whole texts, a stretch of white space and the following other characters at a time.

    Byte-level BPE splits a text before such a stretch, so its ids do not depend on what
    is around it, and most stretches occur again and again. Texts with white space beyond ASCII
    are tokenised whole. ``ranks_path``, the same vocabulary as a rank file, makes new stretches
    cheaper; those with the special token's name are left to the tokenizer.
    """

    special = "<|endoftext|>"

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = _ranks(ranks_path) if ranks_path else None
        self._forget()

    def _forget(self) -> None:
        # Hashes of known stretches in order, and where their ids are.
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.ids, self.used = np.zeros(1 << 20, dtype=np.uint32), 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """``keys``, in order, are unknown."""
        found: list[list[int]] = [[]] * len(texts)
        other = [i for i, t in enumerate(texts) if self.ranks is None or self.special in t]
        rest = set(other)
        for i, text in enumerate(texts):
            if i not in rest:
                found[i] = self.ranks.encode_ordinary(text)
        encoded = self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)
        for i, encoding in zip(other, encoded, strict=True):
            found[i] = encoding.ids
        flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32)
        if self.used + flat.size > self.ids.size:
            self.ids = np.concatenate([self.ids, np.zeros(max(self.ids.size, flat.size), np.uint32)])
        self.ids[self.used : self.used + flat.size] = flat
        lengths = np.array([len(f) for f in found], dtype=np.int64)
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += flat.size
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.lengths = np.insert(self.lengths, at, lengths)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of each text's ids)."""
        if self.keys.size > REMEMBERED:
            self._forget()
        docs = offsets.size - 1
        space = _ASCII_SPACE[data]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][offsets[:-1] < data.size]] = True
        odd = _wide_space(data, offsets)
        doc_of_byte = None
        if odd.any():
            doc_of_byte = np.repeat(np.arange(docs), np.diff(offsets))
            first = np.zeros(data.size, dtype=bool)
            first[offsets[:-1][offsets[:-1] < data.size]] = True
            begins &= first | ~odd[doc_of_byte]
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], data.size)[: starts.size]
        keys, where, inverse = np.unique(stretch_keys(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = place < self.keys.size
        known[known] = self.keys[place[known]] == keys[known]
        unknown = np.flatnonzero(~known)
        if unknown.size:
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8") for a, b in zip(starts[where[unknown]], ends[where[unknown]], strict=True)]
            self._learn(keys[unknown], texts)
        number = np.searchsorted(self.keys, keys)[inverse]
        length = self.lengths[number]
        total = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(self.starts[number] - total[:-1], length) + np.arange(total[-1])
        return self.ids[at], total[np.searchsorted(starts, offsets)]


def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _tokenizer(path: str, ranks_path: str | None) -> StretchTokenizer:
    """One for all tasks of a worker."""
    return StretchTokenizer(path, ranks_path)


def _wide_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has white space beyond ASCII."""
    found = np.zeros(data.size + 1, dtype=bool)
    if data.size > 1:
        a, b = data[:-1], data[1:]
        found[: a.size] = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    if data.size > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        wide = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        wide |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        wide |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        wide |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        found[: a.size] |= wide
    return np.diff(np.concatenate([[0], np.cumsum(found)])[offsets]) > 0


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def _piece_rows(path: str, ranks_path: str | None, size: int):
    """Each document's pieces; ``nth`` numbers the task's pieces of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, ranks_path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, end, data, offsets in pieces(batch.column("text")):
                tokens, bounds = tokenizer(data, offsets)
                out: list[list] = [[] for _ in range(7)]
                for i in range(end - row):
                    own = np.append(tokens[bounds[i] : bounds[i + 1]], 0).astype("<u4")
                    first = (own.size - 1) % size + 1
                    cuts = [0, *range(first, own.size + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        crc = zlib.crc32(own[a:b].tobytes())
                        values = (ids[row + i], k, a, b - a, crc, part, seen[b - a])
                        seen[b - a] += 1
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return run


@dataclass
class Capacity:
    """What one sequence holds, and how much each resource counts in the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    def room(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.int64)

    def need(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], dtype=np.int64)


def plan(counts: dict[int, int], capacity: Capacity) -> np.ndarray:
    """Steps (length, from, number, sequence, offset): pieces ``from``, ``from`` + 1, ... of a length
    go to ``sequence``, ``sequence`` + 1, ... at ``offset``."""
    room, weights = capacity.room(), np.array(capacity.weights)
    scale = weights / room
    # Classes of sequences: residual (3), first sequence, number of sequences.
    left = np.zeros((0, 3), dtype=np.int64)
    spans = np.zeros((0, 2), dtype=np.int64)
    steps, opened = [], 0
    for length in sorted(counts, reverse=True):
        need, waiting, placed = capacity.need(length), counts[length], 0
        if (need > room).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence")
        while waiting:
            fits = (left >= need).all(axis=1) & (spans[:, 1] > 0)
            if fits.any():
                at = np.flatnonzero(fits)
                rest = (left[at] - need) * scale
                score = (
                    np.linalg.norm(rest, axis=1) if capacity.rule == "norm" else -(left[at] * scale * need * scale).sum(axis=1)
                )
                best = at[score.argmin()]
                number = min(waiting, int(spans[best, 1]))
                sequence = int(spans[best, 0])
                offset = capacity.tokens - int(left[best, 0])
                new = left[best] - need
                spans[best] += (number, -number)
                fresh = [(new, sequence, number)]
            else:
                # Open as many as these pieces fill when several fit into one.
                per = int((room // need).min())
                number = -(-waiting // per)
                sequence, offset, fresh = opened, 0, []
                opened += number
                for k in range(per):
                    own = min(number, waiting)
                    if not own:
                        break
                    steps.append((length, placed, own, sequence, k * length))
                    placed, waiting = placed + own, waiting - own
                    if own < number:
                        fresh.append((room - k * need, sequence + own, number - own))
                        number = own
                    last = k + 1
                fresh.append((room - last * need, sequence, number))
                number = 0
            if number:
                steps.append((length, placed, number, sequence, offset))
                placed, waiting = placed + number, waiting - number
            left = np.concatenate([left, [f[0] for f in fresh]])
            spans = np.concatenate([spans, [f[1:] for f in fresh]])
            useful = (spans[:, 1] > 0) & (left[:, 0] > 0) & (left[:, 1] > 0)
            left, spans = left[useful], spans[useful]
    return np.array(steps, dtype=np.int64).reshape(-1, 5)


def _placed(steps: np.ndarray):
    """Sequence and offset of each numbered piece."""
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[order]
    lengths = steps[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array([(int(n) << 44) + int(f) for n, f in steps[:, :2]], dtype=np.int64)
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(keys, (length << 44) + number, side="right") - 1
            assert (lengths[at] == length).all()
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            sequence = steps[at, 3] + number - steps[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(steps[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: Capacity | None = None, ranks_path: str | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    capacity = capacity or Capacity()
    ship_package(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = written(named.mapInArrow(_piece_rows(tokenizer_path, ranks_path, capacity.tokens), PIECES), "pieces")
    # A number within the length = the task's own number + the pieces of earlier tasks.
    per_task = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = per_task.selectExpr(
        "length", "part",
        "coalesce(sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier",
    )
    # One row for each length, at most ``capacity.tokens`` of them.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(counts, capacity)
    numbered = cut.join(before, ["length", "part"]).withColumn("number", F.col("nth") + F.col("earlier"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        _placed(steps), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
