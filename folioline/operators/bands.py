"""Raster measures of full-size scans, from bands of rows.

A page of nine million pixels is too much for one cell of an Arrow batch that holds thousands. Here
a page is a set of bands, ``(document, page, width, height, top, gray)``: ``gray`` holds some whole rows,
``top`` is the first one's number and ``height`` the page's. Colour bands become gray with
``raster.luma``, which looks at single pixels.

Bands give histograms and sums that merge by addition, so a page's pixels meet in no task. The
Laplacian is linear: each row is a sum of what it and its two neighbours give. Rows whose neighbours lie in
another band are sent as they are, at most four rows a band, and added up by row number.
All sums are of whole numbers, so the results equal those of the whole raster to the last bit.

Defined results: bands may have any heights, also of one row; an empty or null raster has no bands, and
a page without bands no row; pixels are 0 to 255 and never null; bands of one page must not
overlap; null keys are a page of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioline.operators.raster import is_blank_page
from folioline.session import ship_package, written

#: About as many pixels are in a band.
BAND_PIXELS = 1 << 18
_LEVELS = 256
# Behind the histogram: number, sum and sum of squares of the Laplacian.
_CELLS = _LEVELS + 3


def cut_bands(rasters: DataFrame, pixels: int = BAND_PIXELS) -> DataFrame:
    """Bands of rasters ``(document, page, width, gray)`` that are whole in one column."""
    sized = rasters.where(F.size("gray") > 0).select(
        "document", "page", F.col("width").cast("int").alias("width"),
        F.floor(F.size("gray") / F.col("width")).cast("int").alias("height"), "gray",
    )
    rows = F.greatest(F.lit(1), F.floor(F.lit(pixels) / F.col("width")).cast("int"))
    cut = F.transform(
        F.sequence(F.lit(0), F.col("height") - 1, rows),
        lambda top: F.struct(
            top.alias("from"), F.slice("gray", top * F.col("width") + 1, rows * F.col("width")).alias("band")
        ),
    )
    placed = sized.select("document", "page", "width", "height", F.inline(cut))
    return placed.withColumnsRenamed({"from": "top", "band": "gray"})


def _band(gray: np.ndarray, top: int, height: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """A band's own sums, and by row number what it gives to rows that are not whole in it."""
    around = np.pad(gray, ((0, 0), (1, 1)), mode="reflect")
    second = around[:, :-2] + around[:, 2:] - 4 * gray
    second[1:] += gray[:-1]
    second[:-1] += gray[1:]
    rows, end = len(gray), top + len(gray)
    # Beyond the border the page is mirrored: its outermost rows have their one neighbour twice.
    if height == 1:
        second += 2 * gray
    elif rows > 1:
        if top == 0:
            second[0] += gray[1]
        if end == height:
            second[-1] += gray[-2]
    first_open = top > 0 or (rows == 1 and height > 1)
    last_open = end < height or (rows == 1 and height > 1)
    seams: dict[int, np.ndarray] = {}
    if first_open:
        seams[top] = second[0]
    if last_open:
        seams[end - 1] = second[-1]
    if top > 0:
        seams[top - 1] = gray[0] * (2 if top == 1 else 1)
    if end < height:
        seams[end] = gray[-1] * (2 if end == height - 1 else 1)
    whole = second[int(first_open) : rows - int(last_open)] if rows > 1 or not first_open else second[:0]
    own = np.bincount(gray.ravel(), minlength=_LEVELS)
    return np.concatenate([own, [whole.size, whole.sum(), (whole * whole).sum()]]), seams


def _band_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pixels = batch.column("gray")
        ends = pixels.offsets.to_numpy()
        flat = pixels.values.to_numpy()
        numbers = [batch.column(c).to_pylist() for c in ("width", "height", "top")]
        for at, (width, height, top) in enumerate(zip(*numbers, strict=True)):
            gray = flat[ends[at] : ends[at + 1]].astype(np.int64).reshape(-1, width)
            own, seams = _band(gray, top, height)
            lines = [None, *seams]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("document").take(pa.array([at] * len(lines))),
                    batch.column("page").take(pa.array([at] * len(lines))),
                    pa.array(lines, pa.int64()),
                    pa.array([own, *seams.values()], pa.list_(pa.int64())),
                ],
                names=["document", "page", "line", "amounts"],
            )


_MEASURES = T.StructType(
    [
        T.StructField("sharpness", T.DoubleType()), T.StructField("threshold", T.IntegerType()),
        T.StructField("std", T.DoubleType()),
    ]
)


def _variance(n: int, total: int, squares: int) -> float:
    return float(n * squares - total * total) / float(n * n)


@F.pandas_udf(_MEASURES)
def _measures(cells: pd.Series) -> pd.DataFrame:
    """Of 256 counts and three sums: Laplacian's variance, best split, standard deviation."""
    found = []
    levels = np.arange(_LEVELS)
    for cell in cells:
        sums = np.zeros(_CELLS, dtype=np.int64)
        for entry in cell:
            sums[entry["cell"]] = entry["amount"]
        counts = sums[:_LEVELS]
        n, mass = int(counts.sum()), int(counts @ levels)
        below, dark = np.cumsum(counts), np.cumsum(counts * levels)
        # Python's whole numbers, since those of a large page exceed 64 bits.
        gaps = [float(int(d) * (n - int(b)) - (mass - int(d)) * int(b)) for b, d in zip(below, dark, strict=True)]
        sizes = [float(int(b) * (n - int(b))) for b in below]
        between = [gap * gap / size if size else 0.0 for gap, size in zip(gaps, sizes, strict=True)]
        std = _variance(n, mass, int(counts @ (levels * levels))) ** 0.5
        found.append((_variance(*map(int, sums[_LEVELS:])), int(np.argmax(between)), std))
    return pd.DataFrame(found, columns=["sharpness", "threshold", "std"])


def band_measures(bands: DataFrame) -> DataFrame:
    """``(document, page, sharpness, threshold, std, blank)`` of pages that come in bands."""
    ship_package(bands.sparkSession)
    keys = [bands.schema["document"], bands.schema["page"]]
    made = T.StructType([*keys, T.StructField("line", T.LongType()), T.StructField("amounts", T.ArrayType(T.LongType()))])
    chosen = bands.select(
        "document", "page", *[F.col(c).cast("int").alias(c) for c in ("width", "height", "top")],
        F.col("gray").cast("array<smallint>").alias("gray"),
    )
    # Histograms and seams, some hundredths of the pixels; both are read below.
    parts = written(chosen.mapInArrow(_band_parts, made), "bands")
    own = parts.where("line IS NULL").select("document", "page", F.posexplode("amounts").alias("cell", "amount"))
    added = F.reduce(
        F.slice("given", 2, 2), F.get("given", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    )
    # A row gets at most three shares: its own band's and one from either side.
    seams = (
        parts.where("line IS NOT NULL").groupBy("document", "page", "line")
        .agg(F.collect_list("amounts").alias("given")).select("document", "page", added.alias("row"))
    )
    zero = F.lit(0).cast("bigint")
    sums = F.array(
        F.size("row").cast("bigint"), F.reduce("row", zero, lambda a, x: a + x),
        F.reduce("row", zero, lambda a, x: a + x * x),
    )
    moments = seams.select("document", "page", F.posexplode(sums).alias("cell", "amount"))
    cells = (
        own.unionByName(moments.withColumn("cell", F.col("cell") + _LEVELS)).where("amount != 0")
        .groupBy("document", "page", "cell").agg(F.sum("amount").alias("amount"))
    )
    # At most 259 cells a page.
    pages = cells.groupBy("document", "page").agg(F.collect_list(F.struct("cell", "amount")).alias("cells"))
    measured = pages.select("document", "page", _measures("cells").alias("found"))
    return measured.select("document", "page", "found.*", is_blank_page(F.col("found.std")).alias("blank"))
