"""Caller-supplied functions over pages: model calls and image work.

Partitions and the window of calls in each bound the parallelism: repartition before the call
to limit how many run.
"""

from __future__ import annotations

import asyncio
import inspect
import threading
import time
from collections import deque
from collections.abc import Awaitable, Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CALL_FIELDS = [
    T.StructField("raw_response", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
]

Reply = tuple[str | None, int | None, int | None]


class _Calls:
    """Calls in flight, on threads or, where the client is a coroutine function, on one event loop."""

    def __init__(self, call: Callable[[str, str], Reply | Awaitable[Reply]], window: int):
        self.call, self.loop = call, None
        if inspect.iscoroutinefunction(call) or inspect.iscoroutinefunction(getattr(call, "__call__", None)):
            self.loop = asyncio.new_event_loop()
            self.runner = threading.Thread(target=self.loop.run_forever, daemon=True)
            self.runner.start()
        else:
            self.pool = ThreadPoolExecutor(window)

    def submit(self, model: str, request: str) -> Future:
        if self.loop:
            return asyncio.run_coroutine_threadsafe(self._awaited(model, request), self.loop)
        return self.pool.submit(self._called, model, request)

    def _called(self, model: str, request: str) -> tuple:
        started = time.perf_counter()
        try:
            return _outcome(started, self.call(model, request))
        except Exception as exc:  # noqa: BLE001
            return _outcome(started, failure=exc)

    async def _awaited(self, model: str, request: str) -> tuple:
        started = time.perf_counter()
        try:
            return _outcome(started, await self.call(model, request))
        except Exception as exc:  # noqa: BLE001
            return _outcome(started, failure=exc)

    def close(self) -> None:
        if self.loop:
            self.loop.call_soon_threadsafe(self.loop.stop)
            self.runner.join()
            self.loop.close()
        else:
            self.pool.shutdown(cancel_futures=True)


def _outcome(started: float, reply: Reply = ("", 0, 0), failure: Exception | None = None) -> tuple:
    text, asked, answered = reply
    made = (text or "", int(asked or 0), int(answered or 0))
    error = None if failure is None else f"{type(failure).__name__}: {failure}"
    return (*made, round(time.perf_counter() - started, 2), failure is None, error)


def run_inference(
    requests: DataFrame,
    make_client: Callable[[], Callable[[str, str], Reply | Awaitable[Reply]]],
    window: int = 1,
) -> DataFrame:
    """Call a model for each ``(model, request)`` row.

    ``make_client`` runs once per partition and returns ``call(model, request)``, a function or a
    coroutine function, which gives reply text, prompt and completion tokens. Up to ``window``
    calls of a partition run at once, across Arrow batches; rows keep their order. An exception
    becomes the row's error and never stops the job. The request text is not kept.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    keep = [f for f in requests.schema.fields if f.name != "request"]
    schema = T.StructType(keep + CALL_FIELDS)

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls = None
        # Batches whose calls are not all done, and the calls that nobody has waited for.
        held: deque[tuple[pa.RecordBatch, list[Future]]] = deque()
        in_flight: deque[Future] = deque()
        try:
            for batch in incoming:
                calls = calls or _Calls(make_client(), window)
                futures: list[Future] = []
                held.append((batch, futures))
                for model, request in zip(batch["model"].to_pylist(), batch["request"].to_pylist(), strict=True):
                    while len(in_flight) >= window:
                        in_flight.popleft().result()
                    futures.append(calls.submit(model, request))
                    in_flight.append(futures[-1])
                while held and all(f.done() for f in held[0][1]):
                    yield _answered(*held.popleft())
            while held:
                yield _answered(*held.popleft())
        finally:
            if calls:
                calls.close()

    return requests.mapInArrow(batches, schema)


def _answered(batch: pa.RecordBatch, futures: list[Future]) -> pa.RecordBatch:
    return _with_columns(batch, "request", [f.result() for f in futures], CALL_FIELDS)


def _with_columns(
    batch: pa.RecordBatch, dropped: str, rows: list[tuple], fields: list[T.StructField]
) -> pa.RecordBatch:
    """The batch without one column, and the rows' values as further ones.

    The other columns stay Arrow arrays, so that keys keep their exact values.
    """
    kept = [name for name in batch.schema.names if name != dropped]
    values = list(zip(*rows, strict=True)) or [()] * len(fields)
    made = [
        pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(values, fields, strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [*[batch[name] for name in kept], *made], names=[*kept, *[f.name for f in fields]]
    )


def apply_media(
    pages: DataFrame,
    make_function: Callable[[], Callable[[bytes], dict]],
    outputs: T.StructType,
    fallback: dict,
    image: str = "content",
) -> DataFrame:
    """Apply an image or OCR function to each page's bytes.

    ``make_function`` runs once per partition, with its toggles bound. A page on which it
    fails gets the ``fallback`` values. The bytes are not kept.
    """
    keep = [f for f in pages.schema.fields if f.name != image]
    names = [f.name for f in outputs.fields]

    def one(function, content: bytes | None) -> tuple:
        try:
            made = function(bytes(content))
        except Exception:  # noqa: BLE001
            made = fallback
        return tuple(made[name] for name in names)

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in incoming:
            if function is None:
                function = make_function()
            rows = [one(function, content) for content in batch[image].to_pylist()]
            yield _with_columns(batch, image, rows, outputs.fields)

    return pages.mapInArrow(batches, T.StructType(keep + outputs.fields))
