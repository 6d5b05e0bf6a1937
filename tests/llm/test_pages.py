"""Archives, their index, and the main text of pages."""

import hashlib
import random
import time

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from folioline.llm import capture_index, main_text, queries
from folioline.session import shared_dir

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, seconds long, digest string, first string"


def made_pages():
    same, short = "<p>" + "same page " * 20, "<p>short"
    rows = [
        (5, "http://www.b.example/x?q=1", same, 100), (2, "https://b.example:8443/", same, 50), (9, None, same, None),
        (7, "http://a.example/é", short, 7), (8, "http://a.example/é", short, 7), (1, "not a url\r\nX: y", None, -5),
        (3, "http://a.example/é", "", 3), (None, "http://z.example", same, 1), (11, "http://[bad", "ü" * 99, 1),
        (12, "http://c.example/", "ü" * 99, 1),
    ]
    return [(*r, "d", "f") for r in [*rows, rows[0]]]


def test_archives_and_index(spark):
    docs = made_pages()
    files = capture_index.write_archives(spark.createDataFrame(docs, SCHEMA))
    rows = [r.asDict() for r in capture_index.capture_index(files).collect()]
    assert len(rows) == len(docs)
    first = {}
    for page, _, html, *_ in docs:
        payload = (html or "").encode()
        if len(payload) >= 100 and page is not None:
            first[payload] = min(page, first.get(payload, page))
    by_page = {r["page_id"]: r for r in rows}
    for page, url, html, seconds, *_ in docs:
        payload, row = (html or "").encode(), by_page[page]
        leader = first.get(payload)
        revisit = leader is not None and leader != page
        assert (row["payload_bytes"], row["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (row["record_type"], row["refers_to"]) == (("revisit", leader) if revisit else ("response", None))
        assert row["url"] == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
        assert row["stamp"] == capture_index._stamp(seconds or 0)
    order = sorted(rows, key=lambda r: (r["index_part"], r["index_nth"]))
    keys = [(r["url_key"], r["stamp"]) for r in order]
    assert keys == sorted(keys)
    assert by_page[2]["url_key"] == "example,b:8443)/" and by_page[5]["url_key"] == "example,b)/x?q=1"


def test_archives_roll_over(spark, monkeypatch):
    monkeypatch.setattr(capture_index, "ARCHIVE_BYTES", 200)
    folder = shared_dir(spark, "archives")
    archive = capture_index._Archive(folder)
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    pages = [(i, f"http://h/{i}", i, random.Random(i).randbytes(90 + i), "x", None) for i in range(12)]
    for page in pages:
        archive.add(capture_index.record(*page))
    archive.close()
    assert len(archive.done) > 3 and sum(r for *_, r in archive.done) == 12
    bodies = [body for path, *_ in archive.done for *_, body in capture_index.read_records(path)]
    assert [b.partition(b"\r\n\r\n")[2] for b in bodies] == [p[3] for p in pages]


def test_merge_in_passes_with_a_hot_url(spark, monkeypatch):
    """Runs of a few captures, merged four at a time; two thirds of all pages have one URL and time."""
    # Tasks of a local session are processes forked with these values.
    monkeypatch.setattr(capture_index, "ARCHIVE_BYTES", 3000)
    pages = spark.range(600, numPartitions=6).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://h/"), F.col("id") % 7)).otherwise("http://hot.example/x").alias("url"),
        F.concat(F.lit("page "), F.col("id")).alias("html"), F.lit(5).alias("seconds"),
    )
    folder = shared_dir(spark, "archives")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    archive = capture_index._Archive(folder)
    for row in pages.collect():
        archive.add(capture_index.record(row.page_id, row.url, 5, row.html.encode(), hashlib.sha256(row.html.encode()).hexdigest(), None))
    archive.close()
    assert len(archive.done) > 16
    files = spark.createDataFrame(archive.done, "archive string, bytes long, records long").repartition(40)
    index = capture_index.capture_index(files, fan_in=4, range_rows=512).collect()
    order = sorted(index, key=lambda r: (r.index_part, r.index_nth))
    keys = [(r.url_key, r.stamp, r.page_id) for r in order]
    assert keys == sorted(keys) and sorted(k[2] for k in keys) == list(range(600))
    parts = {r.index_part for r in index if r.url_key == "example,hot)/x"}
    assert len(parts) > 1 and parts <= set(range(max(parts) + 1))


def test_run_stretches(tmp_path):
    """Every stretch of a run is what a plain filter gives, ties of key and time included."""
    rng = random.Random(4)
    rows = sorted(
        ((f"a{i % 3}", rng.choice(["", "k", "l"]), "t", rng.choice([None, 1, 2]), None, "", 0, "", None, i, 0) for i in range(2000)),
        key=capture_index._order,
    )
    (blocks,) = capture_index._write_run(str(tmp_path), rows)
    path = blocks.column("run")[0].as_py()
    assert blocks.num_rows == 4 and list(capture_index._read_run(path)) == rows
    for a, b in [(0, 1), (511, 512), (512, 1024), (3, 1999), (700, 701)]:
        low, high = capture_index._order(rows[a]), capture_index._order(rows[b])
        assert list(capture_index._read_run(path, low, high)) == rows[a:b]
    assert list(capture_index._read_run(path, capture_index._order(rows[1500]))) == rows[1500:]


@pytest.mark.parametrize("runs", [1, 2, 3, 7, 8])
def test_loser_tree(runs):
    rng = random.Random(runs)

    def row(key, run, at):
        return (f"run{run}", key, "t", rng.choice([None, 1, 2]), None, "", 0, "", None, at, 0)

    rows = [sorted((row(rng.choice("abc"), r, at) for at in range(rng.randrange(0, 9))), key=capture_index._order) for r in range(runs)]
    merged = list(capture_index.LoserTree([iter(r) for r in rows]))
    assert merged == sorted((x for r in rows for x in r), key=capture_index._order)
    assert list(capture_index.LoserTree([])) == []


def test_warc_query(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op1_warc_index(spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in rows} == {
        k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in pages.items()
    }


def test_no_pages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert capture_index.capture_index(capture_index.write_archives(empty)).collect() == []
    assert main_text.extract(empty).collect() == []


WORDS = "some words of an article that is long enough to be one, "


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<html><head><title>T</title></head></html>", ""), ("plain text", "plain text"),
    ("<article><h1>Head</h1><p>One&nbsp;&amp; two<br>three <b>bo</b>ld &#x41;&copy</article><footer>no</footer>", "Head One & two three bold A©"),
    ("<nav>menu</nav><div class='ad'>buy</div><article><p>x</p></article>", "x"),
    (f"<div id=top-menu><a>Home</a></div><div><p>{WORDS * 3}</p><p>tiny.</p><p>{WORDS * 3}</p></div>"
     f"<section class='reader comments'><p>{WORDS}</p></section><aside>{WORDS}</aside>",
     f"{WORDS * 3}{' '}tiny. {WORDS * 3}".replace("  ", " ").replace(",  ", ", ")),
    ("<script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<article><p>a<form><input value='x>y'>send</form></p><p hidden>no</p><div style='display: none'>no</div>b</article>", "a b"),
    ("<nav>never closed <p>kept</p>", "never closed kept"),
    ("<article>text<!-- open", "text"), ("<p title='a > b'>q</p>", "q"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<article><p>one</p><div class='newsletter-signup'>mail</div><p>two</p></article>", "one two"),
])
def test_main_text(page, text):
    assert main_text.main_text(page) == " ".join(text.split())


def test_surge_and_dive():
    lines = [("a", 1, False)] * 5 + [("x" * 60, 60, False), ("s", 1, False), ("y" * 60, 60, False)] + [("b", 1, False)] * 9
    kept = main_text.kept_lines(lines)
    assert "x" * 60 in kept and "s" in kept and "y" * 60 in kept
    assert len(kept) <= 3 + 2 * main_text.WINDOW


@pytest.mark.parametrize("short", [
    "<ul>" + "".join(f"<li>item {i} ..." for i in range(6)) + "</ul>",
    "<table>" + "".join(f"<tr><td>k{i}<td>v{i}" for i in range(6)) + "</table>",
    "<p>" + "<br>".join(f"verse {i}" for i in range(9)) + "</p>",
])
def test_short_lines_of_an_article_stay(short):
    inner = " ".join(main_text.html.unescape(main_text._TAG.sub(" ", short)).split())
    long = f"<p>{WORDS * 9}</p>"
    words = (WORDS * 9).strip()
    assert main_text.main_text(f"<div>{long}{short}{long}</div>") == f"{words} {inner} {words}"
    assert main_text.main_text(f"<div>{long}{short}</div>") == f"{words} {inner}"
    assert main_text.main_text(f"<div>{short}{long}</div>") == f"{inner} {words}"


def test_short_paragraphs_between_long_ones_stay():
    talk = "".join(f"<p>- say {i}</p>" for i in range(8))
    found = main_text.main_text(f"<p>{WORDS * 9}</p>{talk}<p>{WORDS * 9}</p>")
    assert all(f"say {i}" in found for i in range(8))


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "comments-open", "share-story", "legal", "toc"])
@pytest.mark.parametrize("inner", ["<p>{}</p>", "<article><p>{}</p></article>"])
def test_names_around_an_article_stay(name, inner):
    text = (WORDS * 9).strip()
    found = main_text.main_text(f"<div><p>Other words outside</p></div><div class='{name}'>{inner.format(text)}</div>")
    assert text in found
    nested = f"<article><p>one</p><div class='{name}'><p>{text}</p></div><p>two</p></article>"
    assert main_text.main_text(nested) == f"one {text} two"


@pytest.mark.parametrize("name", ["sidebar-left", "commentList", "related-posts", "ad-container", "x-share_buttons", "toc"])
def test_names_of_boilerplate_go(name):
    text = (WORDS * 9).strip()
    for page in (f"<p>{text}</p><div class='{name}'><p>{WORDS}</p></div>", f"<article>{text}<div id='{name}'>{WORDS}</div></article>"):
        assert main_text.main_text(page) == text


def test_head_names_go_outside_an_article():
    text = (WORDS * 9).strip()
    assert main_text.main_text(f"<div class='site-header'>{WORDS}</div><p>{text}</p>") == text


def test_list_of_links_after_an_article_goes():
    links = "".join(f"<li><a href=x>other story {i}</a>" for i in range(9))
    assert "story 5" not in main_text.main_text(f"<p>{WORDS * 9}</p><ul>{links}</ul>")


def test_extraction_query(spark):
    rows = queries.op6_html_extraction(spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    inner = pages.select("page_id", F.regexp_extract("html", "(?s)<article>(.*?)(</article>|$)", 1).alias("a")).collect()
    import html
    import re

    wanted = {r.page_id: " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", r.a))).split()) for r in inner}
    assert {r.page_id: r.text for r in rows} == wanted


@pytest.mark.parametrize("page", [
    "<div class='comment'><p>hello there</p></div>" * 100_000, "<nav>x" * 50_000, "<select>x" * 50_000, "<" * 200_000,
    "<p class=\"" * 50_000, "<a href=x>y" * 50_000, "<!--" * 100_000, "<script>" * 50_000,
])
def test_time_grows_with_the_page(page):
    started = time.perf_counter()
    found = main_text.main_text("<p>" + "word " * 200 + "</p>" + page)
    assert found.startswith("word word") and time.perf_counter() - started < 5
