"""Language identification with hyperdimensional profiles.

Letters become random vectors of +1 and -1. A trigram is the product of its letters' vectors,
shifted by two, one and no places; a text is the sum of its trigrams, a language the sum of
its training texts at unit length. The prediction is the language with the largest cosine.

Case is folded; every stretch of other characters is one boundary letter. Letters outside
a-z share ``SYMBOLS`` - 27 vectors by code point, so that any script has a profile.

The sums of a piece of text are one matrix product, trigram counts by trigram vectors, so
no Python code runs per character. Training sums are of integers, hence the same in any
order of rows.

Defined results: null text or text without letters is ``und`` with score 0; so is every text
if nothing was learned; ties go to the first language in alphabetical order; a repeated row
gives its row again; a null id is never held out and is not learned from; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioline.llm.hashing import pieces
from folioline.session import ship_package

DIMENSIONS = 1024
SYMBOLS = 64
#: Training texts are a sample of about this many labelled rows.
TRAINING_ROWS = 20_000
#: Languages that a profile table may have; it is sent to every task.
MOST_LANGUAGES = 10_000
_UNIT = float(1 << 20)
#: Counts of one matrix product, and trigrams whose vectors are made at once.
_CELLS, _TRIGRAMS = 1 << 20, 2048


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point; 0 where it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low * 31 % (SYMBOLS - 27)
    return table


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each symbol's vector, at the three places of a trigram."""
    vectors = np.random.default_rng(41).choice(np.array([-1.0, 1.0], dtype=np.float32), (SYMBOLS, DIMENSIONS))
    return tuple(np.roll(vectors, shift, axis=1) for shift in (2, 1, 0))


def _trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    first, second, third = _letters()
    return first[trigrams // SYMBOLS**2] * second[trigrams // SYMBOLS % SYMBOLS] * third[trigrams % SYMBOLS]


def profiles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of trigram vectors, whether there is a letter) of each document."""
    docs = offsets.size - 1
    text = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    # Code points before each byte offset: bytes that go on a character do not count.
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = begins[offsets]
    symbols = _symbols()[text]
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    # One boundary between words, and one before and after each document.
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    keep[bounds[:-1][bounds[:-1] < text.size]] |= True
    symbols, doc = symbols[keep], doc[keep]
    has_letter = np.bincount(doc[symbols > 0], minlength=docs) > 0
    out = np.zeros((docs, DIMENSIONS), dtype=np.float32)
    if symbols.size < 3:
        return out, has_letter
    wide = symbols.astype(np.int32)
    trigram = (wide[:-2] * SYMBOLS + wide[1:-1]) * SYMBOLS + wide[2:]
    inside = (doc[:-2] == doc[2:]) & ((wide[:-2] > 0) | (wide[1:-1] > 0) | (wide[2:] > 0))
    trigram, doc = trigram[inside], doc[:-2][inside]
    seen = np.flatnonzero(np.bincount(trigram, minlength=SYMBOLS**3))
    column = np.zeros(SYMBOLS**3, dtype=np.int64)
    column[seen] = np.arange(seen.size)
    first = np.searchsorted(doc, np.arange(docs + 1))
    vectors = np.empty((seen.size, DIMENSIONS), dtype=np.float32)
    for at in range(0, seen.size, _TRIGRAMS):
        vectors[at : at + _TRIGRAMS] = _trigram_vectors(seen[at : at + _TRIGRAMS])
    step = max(1, _CELLS // max(1, seen.size))
    for row in range(0, docs, step):
        end = min(row + step, docs)
        own = slice(first[row], first[end])
        cells = (doc[own] - row) * seen.size + column[trigram[own]]
        counts = np.bincount(cells, minlength=(end - row) * seen.size).reshape(end - row, seen.size)
        out[row:end] = counts.astype(np.float32) @ vectors
    return out, has_letter


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1.0)


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, profile): the task's sums of unit profiles, in whole 2**-20."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for row, end, data, offsets in pieces(batch.column("text")):
            whole = np.rint(_unit(profiles(data, offsets)[0]) * _UNIT).astype(np.int64)
            for lang in set(langs[row:end]):
                own = whole[langs[row:end] == lang].sum(axis=0)
                sums[lang] = sums[lang] + own if lang in sums else own
    yield _sum_batch(sums)


def _total_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, profile in zip(batch.column("lang").to_pylist(), batch.column("profile"), strict=True):
            own = profile.values.to_numpy()
            sums[lang] = sums[lang] + own if lang in sums else own
    yield _sum_batch(sums)


def _sum_batch(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([list(v) for v in sums.values()], pa.list_(pa.int64()))],
        names=["lang", "profile"],
    )


def _drawn(share: float) -> Column:
    """Whether a row is of the share, by a hash of its id; some rows are at any size of the table."""
    return (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < max(1, int(share * (1 << 62)))) | F.lit(share >= 1.0)


def learn(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> list[tuple[str, list[int]]]:
    """Language profiles from (doc_id, text, lang): rows of known language, drawn by their id."""
    ship_package(docs.sparkSession)
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    rows = max(1, known.select("lang").count())
    share = min(1.0, training_rows / rows)
    drawn = known.where(_drawn(share))
    sums = drawn.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(
        _sum_rows, "lang string, profile array<long>"
    )
    table = sums.repartition("lang").mapInArrow(_total_rows, "lang string, profile array<long>")
    found = table.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return sorted((r.lang, list(r.profile)) for r in found)


def predict(docs: DataFrame, learned: list[tuple[str, list[int]]]) -> DataFrame:
    """``docs`` with lang_pred and score appended; only ``text`` is looked at.

    Columns of the input of these names are replaced.
    """
    made = _predicted(docs, learned)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return made.select(*[F.col("row").getField(c).alias(c) for c in kept], "lang_pred", "score")


def _predicted(docs: DataFrame, learned: list[tuple[str, list[int]]]) -> DataFrame:
    """(row, lang_pred, score): the whole row as a struct."""
    ship_package(docs.sparkSession)
    names = np.array([name for name, _ in learned] or ["und"], dtype=object)
    known = np.array([p for _, p in learned], dtype=np.float64).reshape(len(learned), DIMENSIONS)
    prototypes = _unit(known).T.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in pieces(batch.column("text")):
                vectors, letters = profiles(data, offsets)
                best, score = np.zeros(end - row, dtype=np.int64), np.zeros(end - row)
                if prototypes.shape[1]:
                    cosine = (_unit(vectors) @ prototypes.astype(np.float64)).round(9)
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(end - row), best], 0.0, 1.0)
                score = np.where(letters, score, 0.0)
                found = np.where(letters, names[best], "und")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(row, end - row), pa.array(found.tolist(), pa.string()), pa.array(score)],
                    names=["row", "lang_pred", "score"],
                )

    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    out = T.StructType(
        [packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return packed.mapInArrow(run, out)


def held_out() -> Column:
    """The documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that have a language; all columns as they were. Texts without letters go.

    Where no language can be learned, as no row has one, all documents stay.
    """
    learned = learn(docs.where(~held_out()))
    if not learned:
        return docs
    return _predicted(docs, learned).where("lang_pred != 'und'").select("row.*")
