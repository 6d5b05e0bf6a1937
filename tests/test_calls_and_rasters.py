import asyncio
import math
import statistics
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioline.operators import inference, raster
from folioline.sources import files


def test_inference_captures_errors(spark):
    def client():
        def call(model, request):
            if request == "bad":
                raise TimeoutError("slow")
            return (None if request == "empty" else f"{model}:{request}"), None, 3
        return call

    df = spark.createDataFrame([(1, "m", "ok"), (2, "m", "bad"), (3, "m", "empty")], "id int, model string, request string")
    got = {r.id: r for r in inference.run_inference(df, client).collect()}
    assert (got[1].raw_response, got[1].input_tokens, got[1].output_tokens) == ("m:ok", 0, 3)
    assert got[1].success and got[1].error is None and got[1].processing_time >= 0
    assert not got[2].success and got[2].error == "TimeoutError: slow" and got[2].raw_response == ""
    assert got[3].success and got[3].raw_response == ""


@pytest.mark.parametrize("asynchronous", [False, True])
def test_a_window_of_calls_runs_at_once_and_keeps_the_order(spark, asynchronous):
    """Across Arrow batches of three rows; the slowest call comes first."""

    def client():
        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def enter(request):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            return 0.3 if request == "r0" else 0.05

        def leave(request):
            with lock:
                state["now"] -= 1
                if request == "r7":
                    raise ValueError("seven")
                return request, state["most"], 1

        def call(model, request):
            time.sleep(enter(request))
            return leave(request)

        async def call_async(model, request):
            await asyncio.sleep(enter(request))
            return leave(request)

        return call_async if asynchronous else call

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(20).selectExpr("id", "'m' AS model", "concat('r', id) AS request").coalesce(1)
        for window in (1, 6):
            rows = inference.run_inference(df, client, window).collect()
            assert [r.id for r in rows] == list(range(20))
            assert [r.raw_response for r in rows] == ["" if i == 7 else f"r{i}" for i in range(20)]
            assert [r.error for r in rows if not r.success] == ["ValueError: seven"]
            most = max(r.input_tokens for r in rows)
            assert most == 1 if window == 1 else 4 <= most <= 6
        assert inference.run_inference(df.limit(0), client, 6).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    with pytest.raises(ValueError):
        inference.run_inference(df, client, 0)


def test_media_function_falls_back(spark):
    outputs = T.StructType([T.StructField("size", T.LongType())])

    def make():
        return lambda content: {"size": 10 // (len(content) - 1)}

    large = 9007199254740993
    df = spark.createDataFrame([(large, b"abc"), (2, b"a"), (None, b"abcd"), (4, None)], "page long, content binary")
    got = {r.page: r.size for r in inference.apply_media(df, make, outputs, {"size": 0}).collect()}
    assert got == {large: 5, 2: 0, None: 3, 4: 0}


def test_inference_keeps_large_keys(spark):
    df = spark.createDataFrame([(9007199254740993, "m", "x"), (None, "m", "y")], "id long, model string, request string")
    got = inference.run_inference(df, lambda: lambda model, request: (request, 1, 1)).collect()
    assert {r.id: r.raw_response for r in got} == {9007199254740993: "x", None: "y"}


def test_raster_measures_by_hand(spark):
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, (6, 5)), np.full((6, 5), 9), np.where(rng.random((6, 5)) > 0.5, 200, 20)]
    rows = [("d", p, 5, [int(v) for v in image.ravel()]) for p, image in enumerate(images)]
    df = spark.createDataFrame(rows, "document string, page int, width int, gray array<smallint>")
    for row in raster.raster_measures(df).collect():
        image = images[row.page].astype(float)
        around = np.pad(image, 1, mode="reflect")
        lap = around[:-2, 1:-1] + around[2:, 1:-1] + around[1:-1, :-2] + around[1:-1, 2:] - 4 * image
        assert row.sharpness == pytest.approx(lap.var())
        assert row.std == pytest.approx(image.std()) and row.blank == (image.std() < 5)
        best, threshold = 0.0, 0
        for t in range(256):
            dark, light = image[image <= t], image[image > t]
            if dark.size and light.size:
                spread = dark.size * light.size * (dark.mean() - light.mean()) ** 2
                if spread > best * (1 + 1e-12):
                    best, threshold = spread, t
        assert row.threshold == threshold


def test_stencil_agrees_with_the_batch_form(spark):
    image = np.arange(20).reshape(4, 5) ** 2 % 97
    pixels = [("d", 1, x, y, int(image[y, x])) for y in range(4) for x in range(5)]
    df = spark.createDataFrame(pixels, "document string, page int, x int, y int, gray int")
    stencil = raster.laplacian_pixels(df).agg(F.var_pop("laplacian")).first()[0]
    whole = spark.createDataFrame([([int(v) for v in image.ravel()], 5)], "gray array<smallint>, width int")
    assert whole.select(raster.sharpness("gray", "width")).first()[0] == pytest.approx(stencil)


def test_skew_is_the_median_of_long_level_segments(spark):
    segments = [("d", 1, 0, 0, 100, dy, 1000) for dy in (1, 5, 5, 9, -3, 2)]
    segments += [("d", 1, 0, 0, 10, 3, 1000), ("d", 1, 0, 0, 10, 200, 1000), ("e", 1, 0, 0, 9, 1, 1000)]
    df = spark.createDataFrame(segments, "document string, page int, x1 int, y1 int, x2 int, y2 int, width int")
    got = {r.document: r.skew_angle for r in raster.skew_angle(df).collect()}
    angles = [math.degrees(math.atan2(dy, 100)) for dy in (1, 5, 5, 9, -3, 2)]
    assert got.keys() == {"d"} and got["d"] == pytest.approx(statistics.median(angles))


def test_enhancement_steps(spark):
    df = spark.createDataFrame([(10.0, -0.5, 3.0), (90.0, None, 30.0)], "sharpness double, skew_angle double, std double")
    tilted, straight = raster.enhancement_report(df, binarize=True).collect()
    assert tilted.report.steps_applied == [
        "grayscale", "deblur(wiener+unsharp)", "denoise(median)", "deskew(-0.50deg)", "contrast(CLAHE)",
        "binarize(skipped: blank page)"]
    assert straight.report.steps_applied[3] == "deskew(skipped: already straight)"
    assert straight.report.deskew_angle == 0.0
    bare = raster.enhancement_report(df, deblur=False, denoise=False, deskew=False, enhance_contrast=False)
    assert bare.first().report.steps_applied == ["grayscale"] and bare.first().report.deskew_angle == 0.0


def test_input_folder_scan(spark, tmp_path):
    for name, size in (("a.pdf", 3), ("B.PDF", 4), ("c.txt", 5), (".pdf", 6)):
        (tmp_path / name).write_bytes(b"x" * size)
    scan = files.scan_input(spark, str(tmp_path))
    got = sorted((r.name, r.stem, r.size) for r in scan.collect())
    assert got == [("B.PDF", "B", 4), ("a.pdf", "a", 3)]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("FileScan")[1].split("Batched")[0]


def test_record_texts_are_placed_by_folder(spark, tmp_path):
    (tmp_path / "A b").mkdir()
    (tmp_path / "A b" / "invoice-1.json").write_text('{"x":\n1}')
    (tmp_path / "p_1.json").write_text("{}")
    (tmp_path / "p_1.png").write_text("no")
    got = files.read_record_texts(spark, str(tmp_path), "output").collect()
    assert sorted((r.bucket, r.folder, r.stem) for r in got) == [
        ("output", "", "p_1"), ("output", "A b", "invoice-1")]
    (tmp_path / "t.json").write_text('{"extracted_fields":{}}')
    assert files.read_templates(spark, str(tmp_path / "t.json")).first().template.startswith("{")


def test_call_ingest(spark, tmp_path):
    (tmp_path / "calls.json").write_text('{"document":"d","page":1,"model":"m","reply":null,"prompt_tokens":7}\n')
    row = files.read_calls(spark, str(tmp_path)).first()
    assert (row.reply, row.input_tokens, row.output_tokens) == ("", 7, 0)
