"""Pages in bands against the same pages whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioline.operators import bands, raster

SCHEMA = "document string, page int, width int, gray array<smallint>"


def whole(spark, images):
    rows = [("d", page, image.shape[1], [int(v) for v in image.ravel()]) for page, image in enumerate(images)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {(r.document, r.page): (r.sharpness, r.threshold, r.std, r.blank) for r in df.collect()}


@pytest.mark.parametrize("pixels", [1, 13, 40, 10_000])
def test_bands_equal_the_whole_raster(spark, pixels):
    """To the last bit, with bands of one row, of two and of all, and borders in every band."""
    rng = np.random.default_rng(pixels)
    shapes = [(1, 1), (1, 6), (6, 1), (2, 5), (3, 4), (4, 2), (7, 13), (12, 3), (20, 20)]
    images = [rng.integers(0, 256, shape) for shape in shapes] + [np.full((5, 5), 9)]
    rasters = whole(spark, images)
    cut = bands.cut_bands(rasters, pixels)
    assert cut.agg(F.sum(F.size("gray"))).first()[0] == sum(i.size for i in images)
    assert found(bands.band_measures(cut)) == found(raster.raster_measures(rasters))


def test_uneven_bands_in_any_order(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (11, 4))
    cuts = [0, 1, 2, 5, 6, 10, 11]
    rows = [
        (None, None, 4, 11, a, [int(v) for v in image[a:b].ravel()]) for a, b in zip(cuts, cuts[1:], strict=False)
    ]
    df = spark.createDataFrame(rows[::-1], "document string, page int, width int, height int, top int, gray array<int>")
    got = found(bands.band_measures(df.repartition(4)))
    (expected,) = found(raster.raster_measures(whole(spark, [image]))).values()
    assert got == {(None, None): expected}


def test_a_full_size_page_among_small_ones(spark):
    """A page of 2550 x 3300 pixels: no band holds more than its bound."""
    at = F.col("id")
    large = spark.range(3300, numPartitions=6).select(
        F.lit("large").alias("document"), F.lit(1).alias("page"), F.lit(2550).alias("width"), F.lit(3300).alias("height"),
        at.cast("int").alias("top"), F.transform(F.sequence(F.lit(0), F.lit(2549)), lambda x: ((x * x + at * 31 + x * at) % 256).cast("smallint")).alias("gray"),
    )
    x, y = np.arange(2550)[None, :], np.arange(3300)[:, None]
    image = (x * x + y * 31 + x * y) % 256
    around = np.pad(image, 1, mode="reflect")
    lap = around[:-2, 1:-1] + around[2:, 1:-1] + around[1:-1, :-2] + around[1:-1, 2:] - 4 * image
    (row,) = bands.band_measures(large).collect()
    assert row.sharpness == raster._population_variance(lap) and row.std == raster._population_variance(image) ** 0.5
    one = spark.createDataFrame([("s", 1, 2550, [5] * 2550 * 110)], SCHEMA)
    sizes = [r[0] for r in bands.cut_bands(one).select(F.size("gray")).collect()]
    assert sum(sizes) == 2550 * 110 and max(sizes) <= bands.BAND_PIXELS


def test_pages_without_pixels(spark):
    rasters = spark.createDataFrame([("d", 1, 5, []), ("d", 2, 5, None), ("d", 3, 2, [1, 2])], SCHEMA)
    cut = bands.cut_bands(rasters)
    assert [r.page for r in cut.collect()] == [3]
    assert bands.band_measures(cut.limit(0)).collect() == []
