from folioline.functions import labels
from folioline.operators import listings, summary
from pyspark.sql import functions as F

FILES = "bucket string, folder string, name string, size long"


def manifest(spark, *rows):
    return spark.createDataFrame([(b, f, n, 1) for b, f, n in rows], FILES)


def test_listing_joins_records_by_stem(spark):
    files = manifest(
        spark, ("skip", "", "a_1.png"), ("skip", "", "a_1.json"), ("skip", "", "b.PNG"),
        ("output", "A", "invoice-1.pdf"), ("output", "A/deep", "x.pdf"), ("input", "", "in.pdf"),
    )
    records = spark.createDataFrame(
        [("skip", "", "a_1", '{"p":1}'), ("output", "A", "invoice-1", "{broken")],
        "bucket string, folder string, stem string, record string",
    )
    got = {r.name: (r.kind, r.file, r.record) for r in listings.bucket_listing(files, records).collect()}
    listed = listings.ordered_listing(listings.bucket_listing(files, records)).collect()
    assert [r.name for r in listed] == ["A/invoice-1", "a_1"]
    assert got == {
        "a_1": ("page", "a_1.png", '{"p":1}'),
        "A/invoice-1": ("document", "A/invoice-1.pdf", "{}"),
    }


def test_input_listing_takes_pdf_in_any_case(spark):
    files = manifest(spark, ("input", "", "a.pdf"), ("input", "", "b.PDF"), ("input", "", ".pdf"),
                     ("input", "", "c.txt"), ("input", "sub", "d.pdf"), ("output", "", "e.pdf"))
    assert sorted(r.name for r in listings.input_listing(files).collect()) == ["a.pdf", "b.PDF"]


def test_cost_sources(spark):
    rows = [
        ("output", "A", "r1", '{"x":1}'), ("output", "A", "r2", "{}"), ("output", "A", "r3", "[1]"),
        ("output", "", "r4", '{"x":1}'), ("review", "", "r5", '{"cost":null}'),
        ("review", "", "r6", '{"x":1}'), ("output", "A", "r7", "{oops"),
    ]
    df = spark.createDataFrame(rows, "bucket string, folder string, stem string, record string")
    assert sorted(r.stem for r in listings.cost_sources(df).collect()) == ["r1", "r5"]


def test_delete_and_survivors(spark):
    files = manifest(
        spark, ("input", "", "doc.pdf"), ("output", "F G", "invoice-1.pdf"), ("output", "F G", "invoice-1.json"),
        ("output", "F G/sub", "x.txt"), ("skip", "", "doc_1.png"), ("skip", "", "doc_1.json"), ("review", "", "doc_1.png"),
    )
    requests = spark.createDataFrame(
        [("input", "input", "doc.pdf"), ("input", "input", "gone.pdf"), ("document", "output", "F G"),
         ("document", "output", "Nope"), ("page", "skip", "doc_1"), ("input", "input", "../secret.txt")],
        "kind string, bucket string, target string",
    )
    got = {r.target: (r.status, r.files) for r in listings.delete_outcomes(files, requests).collect()}
    assert got == {
        "doc.pdf": ("deleted", 1), "gone.pdf": ("not_found", 0), "F G": ("deleted", 3),
        "Nope": ("not_found", 0), "doc_1": ("deleted", 2), "../secret.txt": ("invalid", 0),
    }
    left = listings.delete_survivors(files, requests).collect()
    assert [(r.bucket, r.name) for r in left] == [("review", "doc_1.png")]


def test_clear_counts(spark):
    files = manifest(
        spark, ("input", "", "a.pdf"), ("input", "", "b.PDF"), ("input", "", "notes.txt"),
        ("output", "A", "1.pdf"), ("output", "A", "1.json"), ("output", "B", "x"), ("output", "", "l.png"),
        ("output", "", "l.json"), ("output", "", "keep.txt"), ("skip", "", "p.png"), ("skip", "", "p.json"),
    )
    got = {r.bucket: r.removed for r in listings.clear_counts(files).collect()}
    assert got == {"input": 2, "output": 4, "skip": 2}


def test_uploads(spark):
    names = ["a.pdf", "dir/B.PDF", "..", "x.txt", "a/b.pdf/", None, "c.pdf/."]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    got = [(r.name, r.status) for r in listings.admit_uploads(df).collect()]
    assert got == [
        ("a.pdf", "saved"), ("B.PDF", "saved"), ("..", "invalid file name"), ("x.txt", "'x.txt' is not a PDF"),
        ("b.pdf", "saved"), ("", "'' is not a PDF"), ("c.pdf", "saved"),
    ]


def test_meta_and_field_rows(spark):
    df = spark.createDataFrame(
        [("d", 70.0, ["a", "b"], None, {"x": "1", "y": None}, {"x": 9})],
        "document string, quality_score double, models_used array<string>, error string, "
        "extracted_fields map<string,string>, field_confidence_scores map<string,int>",
    )
    meta = [(r.label, r.text) for r in listings.meta_rows(df, ["document"]).orderBy("position").collect()]
    assert meta == [("Document", "d"), ("Quality score", "70"), ("Models", "a, b")]
    got = [(r.name, r.value, r.confidence) for r in listings.field_rows(df, ["document"]).collect()]
    assert got == [("x", "1", 9), ("y", None, 0)]


def test_labels(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert [one(labels.usd_label(F.lit(v))) for v in (0.0, 0.00123456, 0.5, 12.345)] == [
        "$0", "$0.001235", "$0.5000", "$12.35"]
    assert [one(labels.bytes_label(F.lit(v))) for v in (5, 1536, 3 * 1024 * 1024)] == ["5 B", "1.5 KB", "3.0 MB"]
    assert one(labels.tokens_label(F.lit(1234567))) == "1,234,567"
    assert [one(labels.confidence_band(F.lit(v))) for v in (60, 59, 0)] == ["high", "low", "none"]
    assert one(labels.rate_label(F.lit(1.0), F.lit(1))) == "$1/1M" and one(labels.rate_label(F.lit(1.0), F.lit(2))) == "mixed"
    assert one(labels.tier_label(F.lit("x"))) == "Unknown" and one(labels.score_badge(F.lit(70.5))) == "q71"


def test_run_counts(spark):
    pages = spark.createDataFrame(
        [("a", "no", 1), ("a", "no", 2), ("a", "no", None), ("a", "yes", None), ("a", "unclear", None)],
        "document string, verdict string, document_index long",
    )
    row = summary.document_run_lines(pages).first()
    assert (row.pages, row.extracted, row.skipped, row.review, row.documents) == (5, 3, 1, 2, 2)
    inputs = spark.createDataFrame([("a",), ("b",)], "document string")
    got = summary.run_summary(inputs, summary.page_counts(pages)).first()
    assert (got.succeeded, got.failed, got.total_pages, got.exit_code) == (1, 1, 5, 1)
