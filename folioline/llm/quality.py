"""Quality classification by co-training of two views of a document.

The *text* view has the shares of kinds of characters and words, and the hashed words; the
*page* view has source, language and length as the table gives them. Each has a logistic
model of its own. Both start from a sample of the labelled rows. In each round either scores the whole
table and names the rows that it is surest of, and the other takes these as labelled. At the end
each is calibrated (Platt) on labelled rows kept back from training, and the log-odds of both, less
the prior counted twice, give the score of every document.

*Pseudo-labels of any number.* Rows that a view is sure of (calibrated probability of ``SURE`` or more;
a view that knows nothing is sure of none) are not collected: a pass over the table sums, by
class, the gradient of the other view's loss on them and a bound of its curvature (a quarter of
the features' products; for hashed words, whose row has the root of its length as its sum, that sum times
each). These sums stand for the rows when the other view is fitted again: a quadratic never below the
rows' own loss, equal to it at the present weights. They are whole numbers of ``_UNIT``, so that
no order or partitioning changes them. Of a class, such rows together weigh at most as much as its labelled ones.

Only the labelled sample is bounded, ``TRAINING_ROWS`` drawn by the hash of their ids. Labelled rows beyond it
count as unlabelled, so texts meet the labels in no shuffle but that of the sample.

Defined results: null or empty text has no words and is scored by what is left; null metadata is a
value of its own; without labelled rows of both kinds every score is the share of good ones (0.5
without any); a label of a row that is repeated counts as often as it stands there; a null id has no
label but is scored like others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioline.llm.hashing import Words, pieces, words
from folioline.session import ship_package, written

TRAINING_ROWS = 6000
ROUNDS = 3
SURE = 0.95
WORD_BITS = 16
PAGE_BITS = 12
_STEPS = 60
#: Sums over the table are whole numbers of this share of one.
_UNIT = 2.0**-20

_KINDS = 9
_KIND = np.zeros(256, dtype=np.int64)
for _byte in range(256):
    _char = chr(_byte)
    _KIND[_byte] = (
        0 if _byte >= 0x80 else 1 if _char.islower() else 2 if _char.isupper() else 3 if _char.isdigit()
        else 4 if _char in ".,;:'\"-()?" else 5 if _char == "!" else 6 if _char in " \t\n\r\v\f" else 7 if _char in "|#*%&$@^~=<>{}[]\\/_+" else 8
    )


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def shape(found: Words, offsets: np.ndarray) -> np.ndarray:
    """(document, feature): shares of character kinds and of kinds of words."""
    size = np.maximum(np.diff(offsets), 1)
    kind = _KIND[found.data]
    columns = [_sums(kind == k, offsets) / size for k in range(_KINDS)]
    number = np.diff(found.first)
    some = np.maximum(number, 1)
    length = found.ends - found.starts
    last = found.data[found.ends - 1] if length.size else found.data[:0]
    columns += [_sums(length, found.first) / some, np.log1p(number)]
    columns += [_sums(_KIND[last] == k, found.first) / some for k in (2, 4, 5, 7)]
    letters = np.concatenate([[0], np.cumsum(kind <= 2)])
    columns.append(_sums(letters[found.ends] == letters[found.starts], found.first) / some)
    capital = np.concatenate([[0], np.cumsum(kind == 2)])
    columns.append(_sums(capital[found.ends] - capital[found.starts] > 1, found.first) / some)
    for lag in (1, 2, 3):
        same = np.zeros(found.hashes.size, dtype=bool)
        same[lag:] = found.hashes[lag:] == found.hashes[:-lag]
        columns.append(_sums(same, found.first) / some)
    return np.stack(columns, axis=1)


def word_buckets(found: Words) -> np.ndarray:
    return (found.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


_PAGE_COLUMNS = ["source", "lang", "n_chars"]


def _page_features(docs: DataFrame) -> DataFrame:
    """``page``: hashed metadata values, as buckets."""
    length = F.coalesce(F.floor(F.log2(F.col("n_chars") + 1)).cast("string"), F.lit("null"))
    names = [
        F.concat(F.lit("source:"), F.coalesce(F.col("source").cast("string"), F.lit("null"))),
        F.concat(F.lit("lang:"), F.coalesce(F.col("lang").cast("string"), F.lit("null"))),
        F.concat(F.lit("length:"), length),
    ]
    return docs.withColumn("page", F.array(*[F.pmod(F.xxhash64(n), F.lit(1 << PAGE_BITS)) for n in names]))


@dataclass
class View:
    """Rows of hashed features (bucket lists of any length, with counts) and dense ones."""

    buckets: np.ndarray
    bounds: np.ndarray
    dense: np.ndarray
    size: int
    counts: np.ndarray | None = None

    def __post_init__(self):
        if self.counts is None:
            self.counts = np.ones(len(self.buckets))

    def take(self, rows: np.ndarray) -> View:
        lengths = np.diff(self.bounds)[rows]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.bounds[rows] - total[:-1], lengths) + np.arange(total[-1])
        return View(self.buckets[at], total, self.dense[rows], self.size, self.counts[at])

    def number(self) -> np.ndarray:
        """Hashed features of each row, 1 at least."""
        return np.maximum(_sums(self.counts, self.bounds), 1)


@dataclass
class Sums:
    """Of rows by class (bad, good): number, gradient and curvature in whole units, class first."""

    number: np.ndarray
    sparse: np.ndarray
    sparse_bound: np.ndarray
    dense: np.ndarray
    dense_bound: np.ndarray

    @staticmethod
    def empty(size: int, dense: int) -> Sums:
        return Sums(*(np.zeros((2, *s), dtype=np.int64) for s in ((1,), (size,), (size,), (dense + 1,), ((dense + 1) ** 2,))))

    def parts(self) -> list[np.ndarray]:
        return [self.number, self.sparse, self.sparse_bound, self.dense, self.dense_bound]


class Logistic:
    """Logistic regression on a view: mean weight of its buckets plus standardised dense features."""

    def __init__(self, view: View):
        self.sparse = np.zeros(view.size, dtype=np.float64)
        self.mean = view.dense.mean(axis=0) if len(view.dense) else np.zeros(view.dense.shape[1])
        spread = view.dense.std(axis=0) if len(view.dense) else np.ones(view.dense.shape[1])
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        self.dense = np.zeros(view.dense.shape[1])
        self.bias = 0.0
        self.slope, self.shift = 1.0, 0.0

    def _scaled(self, view: View) -> np.ndarray:
        return np.clip((view.dense - self.mean) / self.spread, -8, 8)

    def raw(self, view: View) -> np.ndarray:
        sparse = _sums(self.sparse[view.buckets] * view.counts, view.bounds) / np.sqrt(view.number())
        # Added up column by column: a row's score must not depend on the rows beside it.
        return sparse + (self._scaled(view) * self.dense).sum(axis=1) + self.bias

    def add_sums(self, view: View, label: int, sums: Sums) -> None:
        """Add the rows of ``view``, all taken as ``label``, to ``sums``."""
        if not len(view.dense):
            return
        error = _sigmoid(self.raw(view)) - label
        lengths, root = np.diff(view.bounds), np.sqrt(view.number())
        dense = np.column_stack([self._scaled(view), np.ones(len(error))])
        # Each row's share is rounded by itself, so sums are exact.
        share = np.rint(np.repeat(error / root, lengths) * view.counts / _UNIT)
        bound = np.rint(0.25 * view.counts / _UNIT)
        sums.number[label] += len(error)
        sums.sparse[label] += np.bincount(view.buckets, weights=share, minlength=view.size).astype(np.int64)
        sums.sparse_bound[label] += np.bincount(view.buckets, weights=bound, minlength=view.size).astype(np.int64)
        sums.dense[label] += np.rint(dense * error[:, None] / _UNIT).astype(np.int64).sum(axis=0)
        for i in range(dense.shape[1]):
            at = slice(i * dense.shape[1], (i + 1) * dense.shape[1])
            sums.dense_bound[label, at] += np.rint(0.25 * dense[:, i : i + 1] * dense / _UNIT).astype(np.int64).sum(axis=0)

    def surrogate(self, sums: Sums, labels: np.ndarray) -> Callable[[list[np.ndarray]], list[np.ndarray]]:
        """The gradient that the summed rows add, as a function of the weights (sparse, dense, bias)."""
        start = [self.sparse.copy(), np.append(self.dense, self.bias)]
        labelled = np.array([(labels == 0).sum(), (labels > 0).sum()])
        number = sums.number[:, 0]
        weight = 0.5 / np.maximum(np.maximum(labelled, number), 1) * _UNIT
        sparse, sparse_bound = weight @ sums.sparse, weight @ sums.sparse_bound
        dense, dense_bound = weight @ sums.dense, (weight @ sums.dense_bound).reshape(len(start[1]), -1)

        def gradient(parameters: list[np.ndarray]) -> list[np.ndarray]:
            # Twice each block's curvature bounds that of both together.
            own = sparse + 2 * sparse_bound * (parameters[0] - start[0])
            rest = dense + 2 * dense_bound @ (np.concatenate(parameters[1:]) - start[1])
            return [own, rest[:-1], rest[-1:]]

        return gradient

    def fit(self, view: View, labels: np.ndarray, sums: Sums | None = None) -> None:
        """Adam on the whole sample, and on ``sums`` of other rows; both classes weigh the same."""
        root, dense = np.sqrt(view.number()), self._scaled(view)
        share = min(max(labels.mean(), 1e-6), 1 - 1e-6)
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / len(labels)
        further = self.surrogate(sums, labels) if sums is not None and sums.number.any() else None
        parameters = [self.sparse, self.dense, np.array([self.bias])]
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        for step in range(1, _STEPS + 1):
            self.bias = float(parameters[2][0])
            error = (_sigmoid(self.raw(view)) - labels) * weight
            spread = np.repeat(error / root, np.diff(view.bounds)) * view.counts
            gradients = [
                np.bincount(view.buckets, weights=spread, minlength=view.size) + 1e-4 * self.sparse,
                dense.T @ error + 1e-4 * self.dense, np.array([error.sum()]),
            ]
            if further:
                gradients = [g + f for g, f in zip(gradients, further(parameters), strict=True)]
            for p, g, m, v in zip(parameters, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.bias = float(parameters[2][0])

    def calibrate(self, view: View, labels: np.ndarray) -> None:
        """Slope and shift of the log-odds on rows that were not trained on (Newton's method)."""
        raw = self.raw(view)
        # Platt's targets keep the probabilities of a separable sample off 0 and 1.
        good, bad = labels.sum(), (1 - labels).sum()
        target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
        self.slope, self.shift = 1.0, 0.0
        for _ in range(50):
            p = _sigmoid(self.slope * raw + self.shift)
            gradient = np.array([((p - target) * raw).sum() + 1e-3 * (self.slope - 1), (p - target).sum()])
            w = p * (1 - p)
            hessian = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
            change = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
            self.slope, self.shift = self.slope - change[0], self.shift - change[1]
            if np.abs(change).max() < 1e-8:
                break

    def log_odds(self, view: View) -> np.ndarray:
        return np.clip(self.slope * self.raw(view) + self.shift, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    prior: float
    views: tuple[Logistic, Logistic] | None

    def score(self, views: tuple[View, View]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, text view's, page view's) probability of each row."""
        if self.views is None:
            flat = np.full(len(views[0].dense), self.prior)
            return flat, flat, flat
        odds = [model.log_odds(view) for model, view in zip(self.views, views, strict=True)]
        prior = np.log(self.prior / (1 - self.prior))
        return _sigmoid(odds[0] + odds[1] - prior), _sigmoid(odds[0]), _sigmoid(odds[1])


def sure_sums(models: list[Logistic], views: tuple[View, View], sums: list[Sums]) -> None:
    """Add the rows that one view is sure of to the sums of the other."""
    for giver, taker in ((0, 1), (1, 0)):
        chance = _sigmoid(models[giver].log_odds(views[giver]))
        for label, rows in ((0, chance <= 1 - SURE), (1, chance >= SURE)):
            models[taker].add_sums(views[taker].take(np.flatnonzero(rows)), label, sums[taker])


def empty_sums(models: list[Logistic]) -> list[Sums]:
    return [Sums.empty(len(model.sparse), len(model.dense)) for model in models]


def co_train(
    views: tuple[View, View], labels: np.ndarray, kept_back: np.ndarray, gather: Callable[[list[Logistic]], list[Sums]]
) -> Model:
    """Learn from labelled rows (1, 0) and from what ``gather`` sums over all others.

    ``gather`` takes the models of both views; ``kept_back`` rows calibrate only.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(float(labels.mean()) if len(labels) else 0.5, None)
    prior = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    train, held = ~kept_back, kept_back
    if len(set(labels[held])) < 2 or len(set(labels[train])) < 2:
        train = held = np.ones(len(labels), dtype=bool)
    used, calibration = np.flatnonzero(train), np.flatnonzero(held)
    models = [Logistic(view) for view in views]
    sums: list[Sums | None] = [None, None]
    for round_no in range(ROUNDS):
        for model, view, seen in zip(models, views, sums, strict=True):
            model.fit(view.take(used), labels[used].astype(np.float64), seen)
            model.calibrate(view.take(calibration), labels[calibration])
        if round_no < ROUNDS - 1:
            sums = gather(models)
    return Model(prior, tuple(models))


def _page_view(pages: np.ndarray) -> View:
    return View(pages.ravel(), np.arange(len(pages) + 1) * pages.shape[1], np.zeros((len(pages), 1)), 1 << PAGE_BITS)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[View, View]]]:
    """(first row, end, both views) of stretches of a batch (text, page, ...)."""
    pages = batch.column("page").flatten().to_numpy().reshape(batch.num_rows, len(_PAGE_COLUMNS))
    for row, end, data, offsets in pieces(batch.column("text")):
        found = words(data, offsets, fold=False)
        yield row, end, (View(word_buckets(found), found.first, shape(found, offsets), 1 << WORD_BITS), _page_view(pages[row:end]))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row's distinct buckets with their counts, at most 2**WORD_BITS, and its dense features."""
    for batch in batches:
        for row, end, (text, _) in _pieces(batch):
            cells = [np.unique(text.buckets[a:b], return_counts=True) for a, b in zip(text.bounds, text.bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).slice(row, end - row) for c in ("doc_id", "label", "page")],
                    *[pa.array([c[i].astype(np.int32).tobytes() for c in cells], pa.binary()) for i in (0, 1)],
                    pa.array([d.tobytes() for d in text.dense], pa.binary()),
                ],
                names=["doc_id", "label", "page", "buckets", "counts", "dense"],
            )


def _drawn(known: DataFrame, size: int, rows: int) -> DataFrame:
    """About ``size`` of ``rows`` labels, by the hash of their ids, which is added as ``draw``."""
    bound = max(1, int(min(1.0, size / max(1, rows)) * 2**62))
    drawn = known.withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(1)), 2))
    return drawn.where(F.col("draw") <= bound)


def _views(rows: list) -> tuple[View, View]:
    blobs = [[np.frombuffer(bytes(r[c]), dtype=np.int32) for r in rows] for c in ("buckets", "counts")]
    buckets, counts = (np.concatenate(b).astype(np.int64) for b in blobs)
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in blobs[0]])])
    dense = np.stack([np.frombuffer(bytes(r["dense"])) for r in rows])
    return View(buckets, bounds, dense, 1 << WORD_BITS, counts.astype(np.float64)), _page_view(np.array([r["page"] for r in rows], dtype=np.int64))


def _input(docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_PAGE_COLUMNS)
    return _page_features(named).select("doc_id", "text", "page")


def _sum_rows(models: list[Logistic], labelled: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = empty_sums(models)
        for batch in batches:
            ids = batch.column("doc_id")
            other = ~np.isin(ids.fill_null(0).to_numpy(), labelled) | ids.is_null().to_numpy(zero_copy_only=False)
            for row, end, views in _pieces(batch):
                rows = np.flatnonzero(other[row:end])
                sure_sums(models, (views[0].take(rows), views[1].take(rows)), sums)
        for taker, held in enumerate(sums):
            for kind, values in enumerate(held.parts()):
                flat = values.ravel()
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), taker * 5 + kind), pa.int32()), pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())],
                    names=["part", "at", "amount"],
                )

    return run


def gather_sums(docs: DataFrame, models: list[Logistic], labelled: np.ndarray) -> list[Sums]:
    """The sums over all rows whose id is not in ``labelled``, the ids of the bounded sample.

    What comes back has a fixed size, that of both models' weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast((models, labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sum_rows(*shared.value)(batches)

    found = _input(docs).mapInArrow(run, "part int, at int, amount long").groupBy("part", "at").agg(F.sum("amount").alias("amount"))
    sums = empty_sums(models)
    total = found.toArrow()
    part, at, amount = (total.column(c).to_numpy() for c in ("part", "at", "amount"))
    for taker, held in enumerate(sums):
        for kind, values in enumerate(held.parts()):
            own = part == taker * 5 + kind
            values.reshape(-1)[at[own]] = amount[own]
    return sums


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels`` (doc_id, quality: 1 good, 0 bad) for documents like ``docs``."""
    ship_package(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")
    )
    drawn = written(
        _drawn(known, TRAINING_ROWS, known.count()).orderBy("draw", "doc_id", "label").limit(2 * TRAINING_ROWS), "labels"
    )
    sample = _input(docs).join(drawn, "doc_id").select("doc_id", "text", "label", "page").mapInArrow(
        _feature_rows, "doc_id long, label int, page array<long>, buckets binary, counts binary, dense binary"
    )
    # Written first, so that no order of arrival matters. Ids may repeat in the documents, hence the limit.
    order = [F.xxhash64("doc_id", F.lit(1)), "doc_id", "label", F.sha2("buckets", 256), F.sha2("dense", 256), "page"]
    found = written(sample, "features").orderBy(*order).limit(2 * TRAINING_ROWS).collect()
    if not found:
        return Model(0.5, None)
    target = np.array([r["label"] for r in found])
    kept_back = np.array([r["doc_id"] // 7 % 4 == 0 for r in found])
    labelled = np.unique([r["doc_id"] for r in found])
    return co_train(_views(found), target, kept_back, lambda models: gather_sums(docs, models, labelled))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, text_score, page_score, keep) for each document."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, views in _pieces(batch):
                scores = shared.value.score(views)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), *map(pa.array, scores), pa.array(scores[0] >= 0.5)],
                    names=["doc_id", "score", "text_score", "page_score", "keep"],
                )

    return _input(docs).mapInArrow(
        run, "doc_id long, score double, text_score double, page_score double, keep boolean"
    )
