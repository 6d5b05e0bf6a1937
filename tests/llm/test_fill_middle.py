"""Fill-in-middle against a plain loop, and its round trip."""

import hashlib
import random
import re

import pytest

from compare import connect, differences
from folioline.llm import fill_middle, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n string, form long, output string, h1 string"


def by_loop(doc_id, text):
    text = text or ""
    units = [m.group() for m in UNIT.finditer(text)]
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def made_texts():
    rng = random.Random(5)
    pieces = ["a", "word", " ", "\n", "\t\r", "\x0b", " ", "é", "漢字", "😀", "<", "P>", "<M", "\x00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [None, "", " ", "\n\n ", "x", " x ", "a <P> b", "<S>", "c<M>", "long words " * 40_000, *texts, *texts[:20]]


def test_transformation_against_a_loop(spark):
    rows = [(i if i % 90 else None, t, "x", 1, "y", "z") for i, t in enumerate(made_texts())]
    rows += rows[5:9]  # repeated rows
    found = fill_middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3))
    found = found.withColumn("back", fill_middle.restored())
    got = sorted(map(repr, (tuple(r) for r in found.collect())))
    assert got == sorted(repr((r[0], *by_loop(*r[:2]), r[1] or "")) for r in rows)
    forms = {r.form for r in found.collect()}
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("stretch", [1, 3, 17])
def test_stretches_have_the_ends_of_one_match(stretch):
    for text in made_texts():
        if text and len(text) < 1000:
            assert fill_middle.unit_ends(text, stretch) == fill_middle.unit_ends(text) == [m.end() for m in UNIT.finditer(text)]


def test_a_very_long_text_in_stretches():
    text = ("some words  and\n" * 600_000)[:-1] + "   "
    ends = fill_middle.unit_ends(text)
    assert len(text) > 2 * fill_middle.STRETCH and len(ends) == 1_800_001 and ends[-1] == len(text)
    assert len(fill_middle.unit_ends("x" * (2 * fill_middle.STRETCH))) == 1


def test_empty_table_and_all_rates(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fill_middle.fill_in_middle(empty).collect() == []
    rows = spark.createDataFrame([(i, f"a b c {i}") for i in range(50)], "doc_id long, text string")
    for percent, spm, forms in [(0, 80, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})]:
        assert {r.form for r in fill_middle.fill_in_middle(rows, 1, percent, spm).collect()} == forms


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    query = queries.QUERIES["op13_fill_in_middle"](spark, sf)
    assert differences(query, connect(sf), queries.ORACLES["op13_fill_in_middle"]) == []
