"""Deletes and clears of folders on disk."""

from pathlib import Path

import pytest

from folioline.operators import listings
from folioline.sources import removal

FILES = [
    ("input", "", "a.pdf"), ("input", "", "a.json"), ("skip", "", "p_1.png"), ("skip", "", "p_1.json"), ("skip", "", "p_2.json"),
    ("output", "doc", "r.json"), ("output", "doc/deep/er", "x.json"), ("output", "doc2", "r.json"), ("output", "", "notes.txt"),
]
MANIFEST = "bucket string, folder string, name string"


@pytest.fixture
def root(tmp_path):
    for place in FILES:
        path = tmp_path / "/".join(p for p in place if p)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    (tmp_path / "outside.txt").write_text("x")
    return tmp_path


def left(root: Path) -> set[str]:
    return {str(p.relative_to(root)) for p in root.rglob("*")}


def test_deletes_change_the_folder(spark, root):
    files = spark.createDataFrame(FILES, MANIFEST)
    asked = [
        ("page", "skip", "p_1"), ("page", "skip", "p_1"), ("page", "skip", "gone"), ("document", "output", "doc"),
        ("input", "input", "a.pdf"), ("input", "input", "../outside.txt"), ("page", "skip", None),
    ]
    requests = spark.createDataFrame(asked, "kind string, bucket string, target string")
    kept = {tuple(r) for r in listings.delete_survivors(files, requests).collect()}
    outcomes = removal.delete_stored(files, requests, str(root))
    status = {(r.kind, r.target): r.status for r in outcomes.collect()}
    assert status["page", "p_1"] == status["document", "doc"] == status["input", "a.pdf"] == "deleted"
    assert status["page", "gone"] == "not_found" and status["input", "../outside.txt"] == "invalid"
    after = left(root)
    assert {p for p in after if (root / p).is_file()} == {"outside.txt"} | {"/".join(x for x in p if x) for p in kept}
    assert "output/doc" not in after and "output/doc2" in after
    # A second run finds nothing to do and harms nothing.
    removal.delete_stored(files, requests, str(root))
    assert left(root) == after


def test_clears_keep_other_kinds(spark, root):
    files = spark.createDataFrame(FILES, MANIFEST)
    counts = removal.clear_stored(files, ["input", "output"], str(root))
    assert {r.bucket: r.removed for r in counts.collect()} == {"input": 1, "output": 2}
    assert left(root) == {
        "input", "input/a.json", "skip", "skip/p_1.png", "skip/p_1.json", "skip/p_2.json", "output", "output/notes.txt", "outside.txt",
    }


def test_places_outside_and_unlisted_files_stay(spark, root):
    (root / "output/doc/own.txt").write_text("x")
    odd = [("output", "..", "outside.txt"), ("..", "", "outside.txt"), ("skip", "", "../outside.txt"), (None, "", "a.pdf"),
           ("skip", None, "p_1.png"), ("output", "doc", "r.json"), ("output", "doc/deep/er", "x.json"), ("skip", "", "not there")]
    done = removal.remove_files(spark.createDataFrame(odd, MANIFEST), str(root))
    assert sum(r.removed for r in done.collect()) == 3
    assert (root / "outside.txt").exists() and (root / "skip/p_1.png").exists()
    assert (root / "output/doc/own.txt").exists() and not (root / "output/doc/deep").exists()
    assert removal.remove_files(spark.createDataFrame([], MANIFEST), str(root)).collect() == []
