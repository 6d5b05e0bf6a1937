"""Measures on page rasters: luma, sharpness, Otsu threshold, skew.

Rasters are row-major arrays in one column. Pixel work is numpy inside Arrow batches;
a page's pixels never leave its row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioline.functions.rounding import round_binary
from folioline.operators.numbering import running_total

# Fixed values of the enhancement decisions.
LUMA_WEIGHTS = (0.299, 0.587, 0.114)
BLUR_BELOW = 50.0
MIN_DESKEW_DEGREES = 0.3
BLANK_STD_BELOW = 5.0
MAX_SKEW_DEGREES = 45.0

_OTSU = T.StructType(
    [T.StructField("threshold", T.IntegerType()), T.StructField("std", T.DoubleType())]
)


@F.pandas_udf(T.ArrayType(T.ShortType()))
def luma(red: pd.Series, green: pd.Series, blue: pd.Series) -> pd.Series:
    """Gray values of a colour raster, rounded half up."""
    wr, wg, wb = LUMA_WEIGHTS
    return pd.Series(
        [
            np.floor(
                wr * np.asarray(r, np.float64)
                + wg * np.asarray(g, np.float64)
                + wb * np.asarray(b, np.float64)
                + 0.5
            ).astype(np.int16)
            for r, g, b in zip(red, green, blue)
        ]
    )


def _population_variance(values: np.ndarray) -> float:
    """From exact whole-number sums."""
    whole = values.astype(np.int64)
    n, total, squares = whole.size, int(whole.sum()), int((whole * whole).sum())
    return float(n * squares - total * total) / float(n * n)


@F.pandas_udf(T.DoubleType())
def sharpness(gray: pd.Series, width: pd.Series) -> pd.Series:
    """Variance of the 4-neighbour Laplacian, the border mirrored."""
    found = []
    for pixels, columns in zip(gray, width):
        image = np.asarray(pixels, np.int64).reshape(-1, int(columns))
        around = np.pad(image, 1, mode="reflect")
        laplacian = (
            around[:-2, 1:-1] + around[2:, 1:-1] + around[1:-1, :-2] + around[1:-1, 2:] - 4 * image
        )
        found.append(_population_variance(laplacian))
    return pd.Series(found, dtype="float64")


@F.pandas_udf(_OTSU)
def otsu(gray: pd.Series) -> pd.DataFrame:
    """Threshold that best separates dark from light, the lowest of equals; and the spread."""
    found = []
    for pixels in gray:
        values = np.asarray(pixels, np.int64)
        histogram = np.bincount(values, minlength=256)
        below = np.cumsum(histogram)
        dark = np.cumsum(histogram * np.arange(256))
        above, light = below[-1] - below, dark[-1] - dark
        weight = (below * above).astype(np.float64)
        gap = (dark * above - light * below).astype(np.float64)
        between = np.divide(gap * gap, weight, out=np.zeros(256), where=weight > 0)
        found.append((int(between.argmax()), _population_variance(values) ** 0.5))
    return pd.DataFrame(found, columns=["threshold", "std"])


def is_blank_page(std: Column) -> Column:
    return std < BLANK_STD_BELOW


def raster_measures(rasters: DataFrame) -> DataFrame:
    """Add ``sharpness``, ``threshold``, ``std`` and ``blank``; drop the pixels."""
    return (
        rasters.withColumn("sharpness", sharpness("gray", "width"))
        .withColumn("_otsu", otsu("gray"))
        .withColumn("threshold", F.col("_otsu.threshold"))
        .withColumn("std", F.col("_otsu.std"))
        .withColumn("blank", is_blank_page(F.col("std")))
        .drop("gray", "_otsu")
    )


def laplacian_pixels(pixels: DataFrame) -> DataFrame:
    """Laplacian of small exploded rasters ``(document, page, x, y, gray)``, for checks."""
    row = Window.partitionBy("document", "page", "y").orderBy("x")
    column = Window.partitionBy("document", "page", "x").orderBy("y")

    def both(window) -> Column:
        before, after = F.lag("gray").over(window), F.lead("gray").over(window)
        return F.coalesce(before, after) + F.coalesce(after, before)

    return pixels.withColumn("laplacian", both(row) + both(column) - 4 * F.col("gray"))


def skew_angle(segments: DataFrame) -> DataFrame:
    """Median angle of a page's long, nearly level line segments.

    ``segments(document, page, x1, y1, x2, y2, width)``. Equal angles are counted first
    and the middle is found by running counts over angle ranges, so that the exact median
    of a page with any number of segments needs no list of them.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    needed = F.greatest(F.lit(50), F.floor(F.col("width") / 20))
    angles = (
        segments.withColumn("angle", F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))))
        .filter((dx * dx + dy * dy >= needed * needed) & (F.abs("angle") <= MAX_SKEW_DEGREES))
        .groupBy("document", "page", "angle")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    ranked = running_total(
        angles, ["document", "page"], "angle", "times", F.floor(F.col("angle") * 4)
    )

    def covers(rank: Column) -> Column:
        return (F.col("before") < rank) & (rank <= F.col("before") + F.col("times"))

    lower = F.floor((F.col("total") + 1) / 2)
    upper = F.floor((F.col("total") + 2) / 2)
    return (
        ranked.groupBy("document", "page")
        .agg(
            F.max(F.when(covers(lower), F.col("angle"))).alias("_lower"),
            F.max(F.when(covers(upper), F.col("angle"))).alias("_upper"),
        )
        .select("document", "page", ((F.col("_lower") + F.col("_upper")) / 2).alias("skew_angle"))
    )


def enhancement_steps(
    sharpness_value: Column,
    angle: Column,
    std: Column,
    denoise: bool = True,
    deskew: bool = True,
    enhance_contrast: bool = True,
    deblur: bool = True,
    binarize: bool = False,
) -> Column:
    """Names of the steps a page goes through, in order. A missing angle counts 0."""
    turn = F.coalesce(angle, F.lit(0.0))
    sign = F.when(turn < 0, "-").otherwise("+")
    size = F.format_string("%.2f", round_binary(F.abs(turn), 2))
    # The names of the steps.
    steps = [F.lit("grayscale")]
    if deblur:
        steps.append(
            F.when(sharpness_value < BLUR_BELOW, "deblur(wiener+unsharp)").otherwise(
                "deblur(skipped: already sharp)"
            )
        )
    if denoise:
        steps.append(F.lit("denoise(median)"))
    if deskew:
        steps.append(
            F.when(
                F.abs(turn) >= MIN_DESKEW_DEGREES,
                F.concat(F.lit("deskew("), sign, size, F.lit("deg)")),
            ).otherwise("deskew(skipped: already straight)")
        )
    if enhance_contrast:
        steps.append(F.lit("contrast(CLAHE)"))
    if binarize:
        steps.append(
            F.when(is_blank_page(std), "binarize(skipped: blank page)").otherwise("binarize(otsu)")
        )
    return F.array(*steps)


def enhancement_report(pages: DataFrame, **toggles: bool) -> DataFrame:
    """``report`` with the deskew angle and step list from ``sharpness, skew_angle, std``."""
    used = F.coalesce("skew_angle", F.lit(0.0)) if toggles.get("deskew", True) else F.lit(0.0)
    steps = enhancement_steps(F.col("sharpness"), F.col("skew_angle"), F.col("std"), **toggles)
    return pages.withColumn(
        "report", F.struct(used.alias("deskew_angle"), steps.alias("steps_applied"))
    )
