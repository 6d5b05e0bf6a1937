"""Pages that wait and latest costs, kept as runs of tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioline.operators.grouping import group_pages
from folioline.session import shared_dir
from folioline.streaming import kept, runs

PAGES = "document string, page int, page_count int, value string"


def test_few_runs_hold_all_batches(monkeypatch):
    monkeypatch.setattr(kept, "FAN", 3)
    stored = set()
    for batch in range(200):
        found = kept.runs_before(batch)
        assert [b for first, size in found for b in range(first, first + size)] == list(range(batch))
        assert stored >= set(found) and len(found) <= 2 * 5
        stored |= {(batch, 1), (batch + 1 - kept.merged_after(batch), kept.merged_after(batch))}


def test_documents_of_many_batches(spark, monkeypatch):
    """As pages in a dictionary: pages that come again, in whole documents too, null keys, late numbers."""
    monkeypatch.setattr(kept, "FAN", 2)
    monkeypatch.setattr(kept, "FEW_NEW", 2)
    draw = random.Random(7)
    place = shared_dir(spark, "test-kept")
    waiting = kept.WaitingPages(place, spark.createDataFrame([], PAGES).schema, "page", "page_count")
    held, wanted = {}, {}
    for number in range(9):
        rows = [
            (draw.choice([None, *"abcdefgh"]), draw.choice([None, 1, 2, 3, 4]), draw.choice([None, 0, 3, 4]), f"v{number}-{i}")
            for i in range(3 if number == 6 else 9)
        ]
        for row in rows:
            held.setdefault(row[0], {})[row[1]] = row
            wanted[row[0]] = max(wanted.get(row[0], 0), row[2] or 0)
        whole = [d for d in held if 0 < wanted[d] <= len(held[d]) and d in {r[0] for r in rows}]
        want = [row for d in whole for row in held[d].values()]
        for d in whole:
            del held[d], wanted[d]
        # A batch that is repeated after a failure gives the same.
        for _ in range(2):
            got = waiting.take(spark.createDataFrame(rows, PAGES).coalesce(1), number)
            assert got.columns == ["document", "page", "page_count", "value"]
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        waiting.forget_whole(spark, number)
        names = {p.name for p in Path(place).iterdir()}
        assert names <= {f"{a}-{b}" for a, b in [*kept.runs_before(number), *kept.runs_before(number + 1), (number, 1)]}


def test_waiting_pages_are_tables_and_a_batch_adds_its_own(spark, tmp_path):
    """No call to a state store for each document; what a batch writes does not grow with what waits."""
    out, sizes = shared_dir(spark, "test-tables"), []
    pages = [(f"d{i}", p, 5, f"v{i % 3}") for p in range(1, 6) for i in range(300)]
    for number in range(5):
        part = pages[number * 300 : (number + 1) * 300]
        spark.createDataFrame(part, PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PAGES).parquet(str(tmp_path / "in"))
        runs.process_documents(stream, group_pages, f"{out}/pages", f"{out}/log")
        sizes.append(sum(p.stat().st_size for p in Path(out, "log", "kept", f"{number}-1").rglob("*.parquet")))
    assert not Path(out, "log", "state").exists()
    assert runs.read_done(spark, f"{out}/pages").count() == 1500
    assert sizes[3] < 1.5 * sizes[0]


@pytest.mark.parametrize("fan", [2, 16])
def test_latest_costs_of_many_batches(spark, monkeypatch, fan):
    monkeypatch.setattr(kept, "FAN", fan)
    monkeypatch.setattr(kept, "FEW_NEW", 2)
    draw = random.Random(fan)
    latest = kept.LatestCosts(shared_dir(spark, "test-latest"))
    known = {}
    for number in range(7):
        rows = [
            (draw.choice([None, *"abcdefghij"]), draw.choice([None, 1, 2, 3, 4]), draw.choice([None, [], [number], [number, i]]))
            for i in range(2 if number == 5 else 8)
        ]
        best, want = {}, []
        for record, version, items in rows:
            if version is not None and version > best.get(record, (-1,))[0]:
                best[record] = (version, items)
        for record, (version, items) in best.items():
            if version > known.get(record, (-1, None))[0]:
                want.append((items, known.get(record, (-1, None))[1]))
                known[record] = (version, items)
        for _ in range(2):
            batch = spark.createDataFrame(rows, "record string, version int, items array<int>").coalesce(1)
            got = latest.take(batch, number, F.col("items")).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_record_costs_need_no_keyed_state(spark, tmp_path):
    item = "model string, input_tokens long, output_tokens long, input_cost double, output_cost double, total_cost double"
    schema = f"record string, version long, items array<struct<{item}>>"
    rows = [(f"r{i % 50}", i, [("m", i, 1, 0.1, None, 0.1)]) for i in range(200)]
    out = shared_dir(spark, "test-no-state")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    runs.refresh_record_costs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), f"{out}/totals", f"{out}/log")
    (got,) = runs.latest_record_costs(spark, f"{out}/totals").collect()
    assert tuple(got) == ("m", sum(range(150, 200)), 50, 5.0, 0.0, 5.0, 50)
    assert not Path(out, "log", "state").exists()
