import random
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioline.operators.cost import price_calls
from folioline.operators.grouping import group_pages
from folioline.session import shared_dir
from folioline.sources.tables import SMALL_MODEL, model_pricing
from folioline.streaming import runs, stateful


def test_each_file_is_taken_once(spark, tmp_path):
    schema = "document string, page int, value string"
    out = shared_dir(spark, "test-ingest")

    def arrive(document, values):
        rows = [(document, p, v) for p, v in enumerate(values, 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runs.process_new(stream, group_pages, f"{out}/pages", f"{out}/log")
        return spark.read.parquet(f"{out}/pages/done")

    arrive("a", ["1", None, "1"])
    assert run().count() == 3
    arrive("b", ["1", "2"])
    got = run()
    assert got.count() == 5 and got.select("batch").distinct().count() == 2
    assert run().count() == 5


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_size for p in Path(folder).rglob("*") if p.is_file()}


def test_documents_wait_for_their_pages(spark, tmp_path):
    schema = "document string, page int, page_count int, value string"
    out = shared_dir(spark, "test-waiting")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runs.process_documents(stream, group_pages, f"{out}/pages", f"{out}/log")
        return {(r.document, r.page): r.document_index for r in runs.read_done(spark, f"{out}/pages").collect()}

    # A null key is a document as well; an unknown number of pages waits.
    assert run([("a", 1, 3, "x"), ("b", 1, 1, "y"), (None, 1, 1, "z"), ("c", 1, None, "y")]) == {("b", 1): 1, (None, 1): 1}
    # The page that comes again takes the place of the first.
    assert run([("a", 3, 3, "y"), ("a", 3, 3, "z"), ("c", 2, None, "y")]) == {("b", 1): 1, (None, 1): 1}
    got = run([("a", 2, 3, "x"), ("c", 3, 3, "y")])
    assert got == {
        ("b", 1): 1, (None, 1): 1, ("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("c", 1): 1, ("c", 2): 1, ("c", 3): 1
    }
    assert runs.read_given_up(spark, f"{out}/pages").count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_mixed_pages_over_five_files_equal_the_batch(spark, tmp_path):
    """One document has a third of all pages. What a batch writes does not grow with what waits."""
    schema = "document string, page int, page_count int, value string"
    pages = [(f"d{i}", p, 4, f"v{(i + p) % 3}") for i in range(200) for p in range(1, 5)]
    pages += [("hot", p, 400, f"v{p // 50}") for p in range(1, 401)]
    random.Random(4).shuffle(pages)
    out, sizes = shared_dir(spark, "test-mixed"), []
    for number in range(5):
        part = pages[number::5]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        before = files(out)
        runs.process_documents(stream, group_pages, f"{out}/pages", f"{out}/log")
        # RocksDB's own changelog or snapshot files of this batch.
        sizes.append(sum(n for name, n in files(out).items() if "/state/" in f"/{name}" and before.get(name) != n))
    want = group_pages(spark.createDataFrame(pages, schema)).collect()
    assert Counter(map(tuple, runs.read_done(spark, f"{out}/pages").select(want[0].__fields__).collect())) == Counter(map(tuple, want))
    assert sizes[3] < 2 * sizes[0] + 200_000


def test_documents_are_given_up_in_time(spark, tmp_path):
    schema = "document string, page int, page_count int, value string, arrived timestamp"
    out, start = shared_dir(spark, "test-given-up"), datetime(2024, 5, 1, 12)

    def run(rows, minutes):
        rows = [(*r, start + timedelta(minutes=minutes)) for r in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runs.process_documents(stream, group_pages, f"{out}/pages", f"{out}/log", arrived="arrived", give_up="1 hour")
        given = {(r.document, r.page) for r in runs.read_given_up(spark, f"{out}/pages").collect()}
        return given, {r.document for r in runs.read_done(spark, f"{out}/pages").collect()}

    assert run([("a", 1, 2, "x"), ("b", 1, 2, "x"), ("e", 1, 1, "x")], 0) == (set(), {"e"})
    assert run([("c", 1, 2, "x"), ("b", 2, 2, "x")], 50) == (set(), {"b", "e"})
    # a's time is up, c's is not.
    assert run([("d", 1, 1, "x")], 70) == ({("a", 1)}, {"b", "d", "e"})
    assert run([("c", 2, 2, "x")], 80) == ({("a", 1)}, {"b", "c", "d", "e"})


def test_a_record_processed_again_counts_once(spark, tmp_path):
    item = "model string, input_tokens long, output_tokens long, input_cost double, output_cost double, total_cost double"
    schema = f"record string, version long, items array<struct<{item}>>"
    out = shared_dir(spark, "test-corrections")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runs.refresh_record_costs(stream, f"{out}/totals", f"{out}/log")
        return {r.model: tuple(r[1:]) for r in runs.latest_record_costs(spark, f"{out}/totals").collect()}

    def cost(model, tokens):
        return (model, tokens, 1, tokens / 10, None, tokens / 10)

    assert run([("a", 1, [cost("m", 5), cost("n", 2)]), ("b", 1, [cost("m", 1)]), ("c", None, [cost("m", 9)]), ("d", 1, None)]) == {
        "m": (6, 2, 0.6, 0.0, 0.6, 2), "n": (2, 1, 0.2, 0.0, 0.2, 1)
    }
    # Again: a's second and third version, b's known version, an older version of nothing known.
    assert run([("a", 2, [cost("k", 7)]), ("a", 3, [cost("n", 4)]), ("b", 1, [cost("m", 100)]), ("b", 0, [])]) == {
        "m": (1, 1, 0.1, 0.0, 0.1, 1), "n": (4, 1, 0.4, 0.0, 0.4, 1)
    }
    assert run([("b", 5, [])]) == {"n": (4, 1, 0.4, 0.0, 0.4, 1)}


def test_costs_refresh(spark, tmp_path):
    schema = "model string, input_tokens long, output_tokens long"
    out = shared_dir(spark, "test-costs")

    def run(tokens):
        rows = [(SMALL_MODEL, tokens, 0), ("other", 1, 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runs.refresh_costs(price_calls(stream, model_pricing(spark)), f"{out}/totals", f"{out}/log")
        return {r.model: r for r in runs.latest_costs(spark, f"{out}/totals").collect()}

    assert run(100)[SMALL_MODEL].input_tokens == 100
    second = run(50)
    assert second[SMALL_MODEL].input_tokens == 150 and second["other"].calls == 2
    assert second[SMALL_MODEL].input_cost == 150 * 0.15 / 1e6


def test_a_waiting_document_costs_one_read_and_one_write_a_batch(monkeypatch):
    calls = []

    class State:
        def __init__(self):
            self.value, self.map = None, {}

        def __getattr__(self, name):
            calls.append(name)
            return {
                "get": lambda: self.value, "exists": lambda: self.value is not None,
                "update": lambda v: setattr(self, "value", v), "containsKey": lambda k: k in self.map,
                "updateValue": self.map.__setitem__, "values": lambda: list(self.map.values()),
                "clear": lambda: (setattr(self, "value", None), self.map.clear()),
            }[name]

    class Handle:
        def getMapState(self, *_):
            return State()

        def getValueState(self, *_):
            return State()

    monkeypatch.setattr(stateful, "FEW_PAGES", 3, raising=False)
    schema = T.StructType.fromDDL("document string, page int, page_count int")
    for wanted, most in ((3, 2), (5, 40)):
        waiting = stateful._Waiting(schema, "page", "page_count", None)
        waiting.init(Handle())
        made = []
        for page in (1, 2, 2, 3, 4, 5)[: wanted + 1]:
            assert made == []
            calls.clear()
            made = [tuple(r) for r in waiting.handleInputRows(("d",), iter([Row(document="d", page=page, page_count=wanted)]), None)]
            assert len(calls) <= most
        assert sorted(made) == [("d", p, wanted, False) for p in range(1, wanted + 1)]
        assert waiting.tally.value is None and not waiting.pages.map
