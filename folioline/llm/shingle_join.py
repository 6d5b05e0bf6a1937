"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments, and a
document into its segments, one for each fragment.

*Candidates.* Two documents that link differ in at most D n-grams, so of D + 1 fragments
one at least holds equal segments. D depends on size: sizes are dealt into bands, each with
its own number of fragments, and a document goes to every band in which it may have a
partner. Equality of whole segments is a rare event even where a frequent line or passage
puts the same n-grams into very many documents; so no frequency table is needed.

*Counts.* For each candidate pair the overlap is counted in each of four coarse fragments
separately and summed per pair; the sum decides.

*Fewer candidates.* A document has more segments than it can differ in, so linked documents
share a known number of them, ``need``. A document that shares fewer with all others together has no
partner. The others leave out their ``need`` - 1 most frequent shared segments: of ``need`` common
ones the rarest is left on both sides. So passages of very many documents make no candidates.

*Large groups.* A document is first compared with one other, the smallest member of most of its
groups. Groups that still hold several components are looked at block by block: pairs that
a bound on their difference (the parities of their n-grams, in buckets) leaves open are
ranked for each two components of the block, and only the likeliest are compared; what stays apart
gets the next ranks, and at last all. So no link that matters for the result is lost, and a
group of near copies costs some pairs a document and not all pairs.

Defined results: null or empty text, or text without words, has an empty set and links with
nothing; equal texts link; a document shorter than one n-gram is one n-gram; repeated ids
are one node; rows without id link with nothing and have a null component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioline.llm.components import components
from folioline.llm.hashing import U64, mixed, pieces, shingles, words
from folioline.session import discard, ship_package, written

#: Ratio of a band's upper to its lower size.
BAND_RATIO = 1.5
#: Bits of the filter of document ids, at most; beyond some 30 million ids it lets more pass.
FILTER_BITS = 1 << 27
SKETCH_BITS = 256
#: Parities of a document that may have partners: two for each n-gram, within these limits.
LEAST_BITS, MOST_BITS = 512, 1 << 14
#: Ranks of the pairs of two components in a block that are compared in each round.
RANKS = ((0, 4), (4, 64), (64, 1 << 62))
_NO_MARK = -(1 << 63)
#: Documents compared with each other in one block.
BLOCK = 1000
#: Signatures that a task gathers before it passes them on.
GATHER = 1 << 20
#: Coarse fragments in which overlaps are counted; a power of 2.
PARTS = 4


class Bands:
    """Size bands and their numbers of fragments for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        limits = [1]
        while limits[-1] < 1 << 40:
            limits.append(max(limits[-1] + 1, int(limits[-1] * BAND_RATIO)))
        self.limits = np.array(limits, dtype=np.int64)
        self.most = [self.difference(2 * (top - 1)) for top in limits[1:]]
        self.spare = [self._spare(low, d) for low, d in zip(limits, self.most, strict=False)]

    @staticmethod
    def _spare(size: int, difference: int) -> int:
        """Fragments beyond difference + 1: more than the empty segments that a document of this
        size is likely to have, so that linked documents share some that are not empty."""
        spare, most = 2, max(2, difference)
        while True:
            fragments = difference + 1 + spare
            empty = fragments * math.exp(-size / fragments)
            need = min(math.ceil(empty + 4 * math.sqrt(empty) + 1), most)
            if spare >= need:
                return spare
            spare = need

    def difference(self, sizes: int) -> int:
        """The largest symmetric difference of two linked sets of so many n-grams together."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.limits, n, side="right")) - 1

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, fragments, spare ones) in which a document of ``n`` n-grams looks for partners."""
        band = self.band(n)
        last = int(np.searchsorted(self.limits, 100 * n // self.percent, side="right")) - 1
        return [
            (k, self.most[k] + 1 + self.spare[k], self.spare[k])
            for k in range(band, last + 1) if self.most[k]
        ]

    def need(self, band: int, segments: int) -> int:
        """How many signatures a document with so many segments that are not empty shares with each partner.

        A differing n-gram changes one segment. Where too many are empty these count as well.
        """
        return max(segments - self.most[band], 1)


def _cuts(grams: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """Fragment of each n-gram, and where the segments begin."""
    part = ((grams >> U64(32)) * U64(fragments)) >> U64(32)
    return part, np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))


def _signatures(grams: np.ndarray, spread: np.ndarray, bands: Bands, code_at: int = 0) -> list[np.ndarray]:
    """Hashes of (band, fragment, segment) of one sorted set; the band modulo 4 is kept at bit ``code_at``."""
    found = []
    for band, fragments, spare in bands.of(grams.size):
        part, starts = _cuts(grams, fragments)
        salt = part[starts] * U64(0x9E3779B97F4A7C15) + U64(band * 0xC2B2AE3D27D4EB4F & (2**64 - 1))
        own = [mixed(np.add.reduceat(spread, starts) ^ mixed(salt))]
        if fragments - starts.size > spare:
            # So many empty segments may be all that two linked documents share.
            empty = np.setdiff1d(np.arange(fragments, dtype=U64), part)
            own.append(mixed(empty * U64(0x9E3779B97F4A7C15) + U64(band + 1), salt=7))
        code = U64(3 << code_at)
        found += [(x & ~code) | U64((band & 3) << code_at) for x in own]
    return found


#: Size, digest, parities, band, and signatures shared with any partner in it and the next two bands.
_NUMBERS = ("doc_id", "n", "d1", "d2", "s0", "s1", "s2", "s3", "band", "w0", "w1", "w2")


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sorted distinct n-gram hashes of each) of pieces of the input."""
    for batch in batches:
        ids = batch.column("doc_id")
        for row, end, data, offsets in pieces(batch.column("text")):
            grams, bounds = shingles(words(data, offsets, fold=True), width)
            yield ids.slice(row, end - row), [np.unique(grams[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def _digest(spread: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return spread.sum(dtype=U64), mixed(spread, salt=2).sum(dtype=U64)


def _set_rows(width: int, percent: int):
    """Each document's number of n-grams, set digest, parities and signatures needed."""
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, width):
            numbers = np.zeros((len(_NUMBERS), len(sets)), dtype=np.int64)
            for i, own in enumerate(sets):
                if own.size:
                    spread = mixed(own, salt=1)
                    counts = np.bincount(own & U64(SKETCH_BITS - 1), minlength=SKETCH_BITS)
                    numbers[1, i] = own.size
                    numbers[2:4, i] = np.array(_digest(spread), dtype=U64).view(np.int64)
                    numbers[4:8, i] = np.packbits((counts & 1).astype(np.uint8)).view(np.int64)
                    numbers[8, i] = bands.band(own.size)
                    for band, fragments, _ in bands.of(own.size):
                        numbers[9 + band - numbers[8, i], i] = bands.need(band, _cuts(own, fragments)[1].size)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, numbers[1:])], names=list(_NUMBERS))

    return run


_ROUTED = "route long, kind int, bucket int, base long, bytes int, signatures binary, docs binary"
#: Kinds of routed rows: segments of one document in a task, those of several (counted only, as
#: their documents travel as members), and these members.
_ONE, _SEVERAL, _MEMBER = range(3)
#: Bits of a signature that are kept within its bucket: a clash only makes a candidate more.
_KEPT_BITS = 48


def _signature_rows(width: int, percent: int, buckets: int):
    """Signatures and documents of a task, in byte strings by bucket (the top bits).

    A segment that several of the task's documents have is known to be shared: its documents go
    on as members, wherever there is room. Under the segment itself a task sends one document,
    so a segment of a third of all documents meets in a bucket once per task.
    """
    bands, shift = Bands(percent), U64(64 - (buckets - 1).bit_length())
    code_at = int(shift) - _KEPT_BITS

    def packed(sig: np.ndarray, doc: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        if not sig.size:
            return
        bucket = (sig >> shift).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rows = []
        for a, b in zip(starts, [*starts[1:], sig.size], strict=True):
            base = int(doc[a:b].min())
            span = int(doc[a:b].max()) - base
            size = 2 if span < 1 << 16 else 4 if span < 1 << 32 else 8
            kept = ((sig[a:b] << (U64(64) - shift)) >> U64(64 - _KEPT_BITS)).view(np.uint8).reshape(-1, 8)[:, :6]
            route = int(bucket[a]) if kind != _MEMBER else int(mixed(sig[a:a + 1] + doc[a:a + 1].view(U64))[0] >> U64(1))
            rows.append((route, kind, int(bucket[a]), base, size, kept.tobytes(), (doc[a:b] - base).astype(f"<u{size}").tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in _ROUTED.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
        )

    def flushed(sigs: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sigs:
            return
        sig, doc = np.concatenate(sigs), np.concatenate(docs).astype(np.int64)
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])])
        sig, doc = sig[fresh], doc[fresh]
        head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(np.concatenate([head, [sig.size]]))
        yield from packed(sig[head[count == 1]], doc[head[count == 1]], _ONE)
        yield from packed(sig[head[count > 1]], doc[head[count > 1]], _SEVERAL)
        several = np.repeat(count > 1, count)
        yield from packed(sig[several], doc[several], _MEMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, docs, held = [], [], 0
        for ids, sets in _sets(batches, width):
            for doc, own in zip(ids.to_numpy(zero_copy_only=False), sets, strict=True):
                if own.size:
                    found = _signatures(own, mixed(own, salt=1), bands, code_at)
                    sigs += found
                    number = sum(f.size for f in found)
                    docs.append(np.full(number, doc))
                    held += number
            if held > GATHER:
                yield from flushed(sigs, docs)
                sigs, docs, held = [], [], 0
        yield from flushed(sigs, docs)

    return run


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, doc_id) of segments that two documents or more have, from all of a bucket."""
    parts: tuple[list, list, list] = ([], [], [])

    def made(sig: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, sig.size, 1 << 16):
            own = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(sig[own].view(np.int64)), pa.array(doc[own])], names=["signature", "doc_id"])

    for batch in batches:
        for _, kind, bucket, base, size, sigs, docs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            sig = (U64(bucket) << U64(_KEPT_BITS)) | _unpacked(sigs, low=True)
            doc = np.frombuffer(docs, dtype=f"<u{size}").astype(np.int64) + base
            if kind == _MEMBER:
                yield from made(sig, doc)
            else:
                for part, values in zip(parts, (sig, doc, np.full(sig.size, kind == _ONE)), strict=True):
                    part.append(values)
    if parts[0]:
        sig, doc, one = (np.concatenate(p) for p in parts)
        order = np.argsort(sig, kind="stable")
        sig, doc, one = sig[order], doc[order], one[order]
        same = sig[1:] == sig[:-1]
        shared = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & one
        yield from made(sig[shared], doc[shared])


def _segments(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, part, grams): the sorted n-gram hashes in each coarse fragment, of the documents
    with the given ids and maybe some others; their parities as part -1.

    A bitmap of hashed ids, of bounded size, spares a shuffle of all texts.
    """
    bits = 1 << 20
    wanted = 16 * ids.count()
    while bits < min(wanted, FILTER_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    maps = (
        ids.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
        .collect()
    )
    # 4096 bytes for each bucket of 32768 bits.
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for row in maps:
        whole[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["map"], dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(whole)
    return docs.withColumn("place", place - 1).mapInArrow(
        _segment_rows(width, shared), "doc_id long, part int, grams binary"
    )


def _parities(grams: np.ndarray) -> bytes:
    """Whether an odd number of the n-grams falls into each bucket; more buckets for more of them."""
    bits = LEAST_BITS
    while bits < min(2 * grams.size, MOST_BITS):
        bits *= 2
    counts = np.bincount(mixed(grams, salt=5) & U64(bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


class Parities:
    """Parities of some documents; of two numbers of buckets the smaller is compared."""

    def __init__(self, blobs: np.ndarray):
        self.size = np.array([len(x) for x in blobs], dtype=np.int64)
        self.at, self.tables = {}, {}
        for size in np.unique(self.size).tolist():
            # Half as many buckets: two become one, odd if one of them was.
            rows = np.flatnonzero((self.size == size) | (self.size == 2 * size))
            self.at[size] = np.zeros(self.size.size, dtype=np.int64)
            self.at[size][rows] = np.arange(rows.size)
            parts = [np.frombuffer(blobs[i], dtype=U64) for i in rows]
            half = size // 8
            self.tables[size] = np.stack([p if p.size == half else p[:half] ^ p[half:] for p in parts])

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """At most the number of n-grams that only one of both has."""
        found = np.zeros(left.size, dtype=np.int64)
        size = np.minimum(self.size[left], self.size[right])
        # Sizes of linked documents are less than a factor of 2 apart, so theirs are at most one step.
        near = np.maximum(self.size[left], self.size[right]) <= 2 * size
        for own, table in self.tables.items():
            pairs = np.flatnonzero((size == own) & near)
            for at in range(0, pairs.size, 1 << 13):
                some = pairs[at : at + (1 << 13)]
                x, y = (table[self.at[own][side[some]]] for side in (left, right))
                found[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return found


def _segment_rows(width: int, shared):
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy(zero_copy_only=False)
            hit = (shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array([p << 62 for p in range(1, PARTS)], dtype=U64)
        for ids, sets in _sets(chosen(batches), width):
            blobs = []
            for own in sets:
                blobs.append(_parities(own))
                # The top 6 bytes: within a fragment of one pair they tell n-grams apart.
                blobs += [
                    piece.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
                    for piece in np.split(own, np.searchsorted(own, cuts))
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids.to_numpy(zero_copy_only=False), PARTS + 1)),
                    pa.array(np.tile(np.arange(-1, PARTS, dtype=np.int32), len(sets))),
                    pa.array(blobs, pa.binary()),
                ],
                names=["doc_id", "part", "grams"],
            )

    return run


def _unpacked(blob: bytes, low: bool = False) -> np.ndarray:
    """Numbers of which the upper (or lower) 6 bytes were kept."""
    wide = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    wide[:, slice(0, 6) if low else slice(2, 8)] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(U64)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros(batch.num_rows, dtype=np.int64)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            both = np.concatenate([_unpacked(x.as_py()), _unpacked(y.as_py())])
            both.sort()
            counts[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("part"), pa.array(counts)],
            names=["a", "b", "part", "overlap"],
        )


def _block_pairs(percent: int, ranks: tuple[int, int]):
    """(a, b): pairs of documents within sorted runs of one key that are of different components.

    For each two first components of a run, the open pairs are ranked by their parities and those
    of the given ranks go on. ``more`` is the signature of a run with further ranks.
    """
    columns = ["signature", "low", "high", "block", "first", "component", "doc_id", "n", "parity"]

    def pairs(rows: dict[str, np.ndarray]) -> np.ndarray:
        key = np.stack([rows["signature"], rows["low"], rows["high"]])
        run = np.cumsum(np.concatenate([[0], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if key.size else key[0]
        parities = Parities(rows["parity"])
        found = []
        for step in range(1, run.size):
            left = np.flatnonzero(run[step:] == run[:-step])
            if not left.size:
                break
            right = left + step
            keep = rows["first"][left] != rows["first"][right]
            # Pairs inside one block are looked at where the two blocks are one.
            keep &= (rows["block"][left] != rows["block"][right]) | (rows["low"][left] == rows["high"][left])
            n, m = rows["n"][left], rows["n"][right]
            keep &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            left, right = left[keep], right[keep]
            if not left.size:
                continue
            most = (100 - percent) * (n[keep] + m[keep]) // (100 + percent)
            apart = parities.apart(left, right)
            keep = apart <= most
            left, right, apart = left[keep], right[keep], apart[keep]
            one, two = rows["first"][left], rows["first"][right]
            a, b = rows["doc_id"][left], rows["doc_id"][right]
            open_yet = rows["component"][left] != rows["component"][right]
            found.append(np.stack([
                run[left], np.minimum(one, two), np.maximum(one, two), apart - most[keep], np.minimum(a, b), np.maximum(a, b), open_yet,
            ]))
        if not found:
            return np.zeros((3, 0), np.int64)
        table = np.concatenate(found, axis=1)
        table = table[:, np.lexsort(table[5::-1])]
        fresh = np.ones(table.shape[1], dtype=bool)
        fresh[1:] = (table[:3, 1:] != table[:3, :-1]).any(axis=0)
        head = np.flatnonzero(fresh)
        rank = np.arange(fresh.size) - head[np.cumsum(fresh) - 1]
        more = np.unique(rows["signature"][np.searchsorted(run, table[0, rank >= ranks[1]])])
        table = table[:, (rank >= ranks[0]) & (rank < ranks[1]) & (table[6] > 0)]
        chosen = np.unique(table[4:6], axis=1)
        marks = np.stack([np.full(more.size, -1), np.full(more.size, -1), more])
        return np.concatenate([np.concatenate([chosen, np.full((1, chosen.shape[1]), _NO_MARK)]), marks], axis=1)

    def taken(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns[:-1]}
        rows["parity"] = np.empty(batch.num_rows, dtype=object)
        rows["parity"][:] = batch.column("parity").to_pylist()
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for batch in batches:
            rows = taken(batch)
            if kept is not None:
                rows = {c: np.concatenate([kept[c], rows[c]]) for c in columns}
            if not rows["signature"].size:
                continue
            # The last key may go on in the next batch.
            last = np.ones(rows["signature"].size, dtype=bool)
            for c in ("signature", "low", "high"):
                last &= rows[c] == rows[c][-1]
            kept = {c: v[last] for c, v in rows.items()}
            yield _pair_batch(pairs({c: v[~last] for c, v in rows.items()}))
        if kept is not None:
            yield _pair_batch(pairs(kept))

    return run


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    """Columns a and b of a pair, or more."""
    is_pair = pairs[2] == _NO_MARK
    columns = [pa.array(column, mask=~is_pair if i < 2 else is_pair) for i, column in enumerate(pairs)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "more"])


def _equal(sets: DataFrame) -> DataFrame:
    """(a, b): each document of a set that several have, with the smallest of them.

    The star of a document may lead to another set, so it is not left to the stars.
    """
    own = ["d1", "d2", "n"]
    heads = sets.where("n > 0").groupBy(*own).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"))
    # Written, so that the join's sides are plain exchanges, which Spark splits where one set is frequent.
    heads = written(heads.where("a != last").drop("last"), "equal")
    return sets.join(heads.hint("merge"), own).where("a != doc_id").select("a", F.col("doc_id").alias("b"))


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and parities do not rule out; ``same`` marks equal sets."""
    for side in ("a", "b"):
        own = sets.select(*[F.col(c).alias(side if c == "doc_id" else f"{side}_{c}") for c in sets.columns])
        pairs = pairs.join(own.hint("merge"), side)
    apart = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(1, 4)),
                F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    return pairs.where(
        (apart * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent))
        & (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    ).select(
        "a", "b", "a_n", "b_n",
        ((F.col("a_d1") == F.col("b_d1")) & (F.col("a_d2") == F.col("b_d2")) & (F.col("a_n") == F.col("b_n"))).alias("same"),
    )


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, a_n, b_n) those whose overlaps, summed over fragments, suffice."""
    # The centres, ``a``, are few: they travel once for the members and no member for them.
    x, y = (
        segments.where("part >= 0").select(F.col("doc_id").alias(c), "part", F.col("grams").alias(g))
        for c, g in (("a", "x"), ("b", "y"))
    )
    sizes = pairs.select("a", "b", "a_n", "b_n")
    parts = (
        sizes.select("a", "b").join(y.hint("merge"), "b").join(x.hint("merge"), ["a", "part"]).select("a", "b", "part", "x", "y")
        .mapInArrow(_overlaps, "a long, b long, part int, overlap long")
    )
    # A row that is repeated in the input gives the same count again, not more overlap.
    once = parts.groupBy("a", "b", "part").agg(F.max("overlap").alias("overlap"))
    total = once.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    union = F.col("a_n") + F.col("b_n") - F.col("overlap")
    return total.join(sizes, ["a", "b"]).where(F.col("overlap") * 100 >= union * percent).select("a", "b")


def _groups(named: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(signature, doc_id): shared segments by which every document meets each partner."""
    partitions = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 15, 4 << (partitions - 1).bit_length())
    every = written(
        named.mapInArrow(_signature_rows(width, percent, buckets), _ROUTED)
        .repartition("route").mapInArrow(_group_rows, "signature long, doc_id long"),
        "groups",
    )
    sizes = every.groupBy("signature").agg(F.count(F.lit(1)).alias("size"))
    needs = (
        sets.select("doc_id", F.posexplode(F.array("w0", "w1", "w2")).alias("next", "need"), "band").where("need > 0")
        .groupBy("doc_id", ((F.col("band") + F.col("next")) % 4).alias("code")).agg(F.min("need").alias("need"))
    )
    kept = (
        every.join(sizes.hint("merge"), "signature")
        .withColumn("code", F.col("signature").bitwiseAND(F.lit(3)))
        .join(needs.hint("merge"), ["doc_id", "code"])
        .selectExpr(
            "signature", "doc_id", "need",
            "row_number() OVER (PARTITION BY doc_id, code ORDER BY size, signature) AS place",
            "count(*) OVER (PARTITION BY doc_id, code) AS shared",
        )
        .where("place <= shared - need + 1")
        .select("signature", "doc_id")
    )
    kept = written(kept, "candidates")
    discard(every)
    return kept


def jaccard_classes(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document of (doc_id, text).

    Linked are documents whose sets of ``width``-word shingles (A-Z as a-z) have
    100 * intersection >= percent * union; ``percent`` is above 50 and at most 100.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id IS NOT NULL")
    all_sets = written(docs.mapInArrow(_set_rows(width, percent), ", ".join(f"{c} long" for c in _NUMBERS)), "sets")
    sets = all_sets.where("doc_id IS NOT NULL")

    groups = _groups(named, sets, width, percent)
    segments = written(_segments(named, groups.select("doc_id").distinct(), width), "segments")
    # A group's smallest document is its centre. Of its centres a document first tries the one
    # with which it shares most segments: the others count only if this leaves them apart.
    centres = groups.groupBy("signature").agg(F.min("doc_id").alias("centre"))
    shared = (
        groups.join(centres.hint("merge"), "signature").where("centre != doc_id")
        .groupBy("doc_id", "centre").agg(F.count(F.lit(1)).alias("n"))
    )
    stars = shared.groupBy("doc_id").agg(F.max(F.struct("n", -F.col("centre"))).alias("top")).select(
        (-F.col("top.col2")).alias("a"), F.col("doc_id").alias("b")
    )
    pairs = written(_bounded(stars, sets, percent), "pairs")
    links = written(
        _equal(sets).unionByName(_linked(pairs.where("NOT same"), segments, percent)),
        "links",
    )
    classes = written(components(links, "a", "b"), "classes")
    classes = _rest(groups, sets, segments, pairs, links, classes, percent)
    # The classes are written: only they and the sets are read from here on.
    discard(groups, segments, pairs, links)
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"))
        .join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .unionByName(
            all_sets.where("doc_id IS NULL")
            .select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        )
    )


def _rest(groups, sets, segments, tried, links, classes, percent: int) -> DataFrame:
    """The classes, with what the stars left apart: groups with documents of several components."""
    # Of equal sets one document stands for all.
    one_each = (
        sets.where("n > 0")
        .join(classes.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left")
        .withColumn("first", F.coalesce("component", "doc_id"))
        .groupBy("d1", "d2", "n").agg(F.min_by("first", "doc_id").alias("first"), F.min("doc_id").alias("doc_id"))
    )
    placed = written(groups.join(one_each.hint("merge"), "doc_id").select("signature", "doc_id", "n", "first"), "members")
    mixed_groups = (
        placed.groupBy("signature")
        .agg(F.count(F.lit(1)).alias("size"), F.min("first").alias("low"), F.max("first").alias("high"))
        .where("low != high")
        .select("signature", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    )
    gone = [placed]
    parities = segments.where("part = -1").select("doc_id", F.col("grams").alias("parity"))
    apart = written(
        placed.join(mixed_groups.hint("merge"), "signature").join(parities.distinct().hint("merge"), "doc_id")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))),
        "apart",
    )
    for ranks in RANKS:
        now = classes.select(F.col("node").alias("doc_id"), "component")
        blocks = (
            apart.join(now.hint("merge"), "doc_id", "left")
            .withColumn("component", F.coalesce("component", "doc_id"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .withColumn("low", F.least("block", "other"))
            .withColumn("high", F.greatest("block", "other"))
            .select("signature", "low", "high", "block", "first", "component", "doc_id", "n", "parity")
            .repartition("signature", "low", "high")
            .sortWithinPartitions("signature", "low", "high")
        )
        found = written(blocks.mapInArrow(_block_pairs(percent, ranks), "a long, b long, more long").distinct(), "found")
        rest = found.where("more IS NULL").select("a", "b")
        rest = rest.join(tried.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        rest = written(_bounded(rest, sets, percent), "rest")
        gone += [found, rest, apart]
        if not rest.isEmpty():
            tried = tried.unionByName(rest)
            links = written(links.unionByName(_linked(rest, segments, percent)), "links")
            gone.append(links)
            classes = written(components(links, "a", "b"), "classes")
        open_runs = found.where("more IS NOT NULL").select(F.col("more").alias("signature")).distinct()
        if open_runs.isEmpty():
            break
        apart = written(apart.join(open_runs.hint("merge"), "signature", "left_semi"), "apart")
    discard(*gone, apart)
    return classes


def keep_first(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """The document with the smallest id of each class, and the rows without id; all columns."""
    classes = jaccard_classes(docs, percent, width).where("doc_id = component_id").select("doc_id").distinct()
    # A union takes columns by place.
    found = docs.join(classes, "doc_id", "left_semi").select(*docs.columns)
    return found.union(docs.where("doc_id IS NULL"))
