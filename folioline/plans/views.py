"""The shared test tables seen as pages, words, calls, fields, replies and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioline.operators.numbering import KeySizes, key_sizes, number_rows
from folioline.operators.quality import quality_tier
from folioline.session import spread
from folioline.sources.files import ocr_words
from folioline.sources.tables import LARGE_MODEL, MEDIUM_MODEL, SMALL_MODEL

EXACT_MARKERS = ["licensed-under", "MIT license", "all rights reserved"]
# Spelled so that the texts come near them but do not hold them, the second apart.
FUZZY_MARKERS = ["licenced under", "MIT license", "all right reserved"]
TEMPLATE = ["status", "flag", "due_date"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a file whose texts are its pages; keys only, without the text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    numbered = number_rows(
        documents, ["source"], ["doc_id"], F.floor(F.col("doc_id") / 65536), "page", "page_count"
    )
    return numbered.select(
        "doc_id",
        F.concat("source", F.lit(".pdf")).alias("document"),
        F.col("source").alias("stem"),
        "page",
        "page_count",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_pages(spark, sf_dir).drop("doc_id")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words in long form, keyed by text id."""
    return ocr_words(word_arrays(spark, sf_dir))


def word_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words keyed by text id: the page number is looked up after they are counted."""
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("doc_id") * 37 % 101 - 20

    def conf(_: Column, position: Column) -> Column:
        number = position + 1
        value = (base + number * 17 % 41).cast("string")
        return F.when((F.col("doc_id") + number) % 97 == 0, "n/a").otherwise(value)

    arrays = texts.select(
        F.lit("").alias("document"),
        F.col("doc_id").alias("page"),
        F.split("text", "[ \t\r\n]+").alias("text"),
    ).withColumn("doc_id", F.col("page"))
    return arrays.withColumn("conf", F.transform("text", conf)).drop("doc_id")


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of ``words`` and ``page_text`` for every text."""
    return table(spark, sf_dir, "documents").select(
        F.lit("").alias("document"), F.col("doc_id").alias("page")
    )


def with_page_names(keyed: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace the text key by document, stem, page and page count."""
    names = _document_pages(spark, sf_dir)
    rest = [c for c in keyed.columns if c not in ("document", "page")]
    return keyed.drop("document").withColumnRenamed("page", "doc_id").join(names, "doc_id").select(
        "document", "stem", "page", "page_count", *rest
    )


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.lit("").alias("document"),
        F.col("doc_id").alias("page"),
        F.when(F.col("doc_id") % 53 == 0, " \n").otherwise(F.col("text")).alias("text"),
    )


def whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a page, as it is."""
    return table(spark, sf_dir, "documents").select(
        F.lit("").alias("document"), F.col("doc_id").alias("page"), "text"
    )


def passage_markers(spark: SparkSession, sf_dir: str, words: int | None = None) -> list[str]:
    """A template of the benchmark's sentences, or of the first words of its passages.

    Templates are lists that a user keeps, so they fit the driver.
    """
    passages = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").orderBy("item_id").collect()
    if words:
        return [" ".join(row["text"].split()[:words]) for row in passages]
    return [part.strip(" \t\r\n") for row in passages for part in row["text"].split(".")]


def call_model(quantity: Column, flag: Column) -> Column:
    return (
        F.when(quantity == 1, "")
        .when(quantity == 2, "unknown/model")
        .when(flag == "A", SMALL_MODEL)
        .when(flag == "N", MEDIUM_MODEL)
        .otherwise(LARGE_MODEL)
    )


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_lines(table(spark, sf_dir, "lineitem"))


def line_document() -> Column:
    return F.concat(F.col("l_orderkey").cast("string"), F.lit(".pdf"))


def _line_key(named: bool) -> Column:
    return (line_document() if named else F.col("l_orderkey")).alias("document")


def line_sizes(lines: DataFrame, named: bool = True) -> KeySizes:
    """How many pages there are, and which files have very many."""
    return key_sizes(lines.select(_line_key(named)), ["document"])


def number_lines(lines: DataFrame, sizes: KeySizes | None = None, named: bool = True) -> DataFrame:
    """Each order is a file whose lines are its pages, with all page-level columns.

    Rows of large tables come out dealt by document, so that steps by document need no other shuffle.
    Without ``named`` the document stays the order's number, half the size of its name in a shuffle.
    """
    order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ]
    block = F.col("l_linenumber").cast("bigint") * (1 << 32) + F.floor(F.col("l_partkey") / 4096)
    numbered = number_rows(
        lines.select(_line_key(named), *(["l_orderkey"] if named else []), *order),
        ["document"], order, block, "page", "page_count", sizes=sizes or line_sizes(lines, named),
    )
    quantity, flag = F.col("l_quantity"), F.col("l_returnflag")
    score = ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 1001).cast("double") / 10.0
    success = F.col("l_discount") > 0.02
    return numbered.select(
        "document",
        F.col("l_orderkey" if named else "document").cast("string").alias("stem"),
        "page",
        "page_count",
        score.alias("quality_score"),
        quality_tier(score).alias("quality_tier"),
        _raw_value(quantity, flag, F.col("l_tax")).alias("raw_value"),
        call_model(quantity, flag).alias("model"),
        F.col("l_partkey").alias("input_tokens"),
        F.col("l_suppkey").alias("output_tokens"),
        (quantity / 4).alias("processing_time"),
        success.alias("success"),
        F.when(~success, F.concat(F.lit("TimeoutError: part "), F.col("l_partkey").cast("string")))
        .alias("error"),
        F.when(quantity >= 8, flag).alias("flag"),
        F.when(quantity < 20, " ").otherwise(F.col("l_linestatus")).alias("status"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        (F.col("l_partkey") % 101).cast("int").alias("confidence"),
    )


def _raw_value(quantity: Column, flag: Column, tax: Column) -> Column:
    return (
        F.when(quantity < 8, F.lit(None).cast("string"))
        .when(quantity < 12, "  ")
        .when(tax > 0.04, F.concat(F.lit(" "), flag, F.lit(" ")))
        .otherwise(flag)
    )


#: What the fields of a line are made of, and what its call left.
FIELD_COLUMNS = ("flag", "status", "cents", "confidence")
CALL_COLUMNS = (
    "quality_score", "model", "input_tokens", "output_tokens", "processing_time", "success", "error",
)


def line_fields(lines: DataFrame) -> DataFrame:
    """Three fields per page: two texts, sometimes null or blank, and a number."""
    index = [c for c in ("document_index",) if c in lines.columns]
    return lines.select("document", "page", *index, "confidence", F.inline(_line_fields()))


def with_line_fields(lines: DataFrame) -> DataFrame:
    """The same fields as a list with their page."""
    fields = F.transform(_line_fields(), lambda f: f.withField("confidence", F.col("confidence")))
    return lines.withColumn("fields", fields).drop(*FIELD_COLUMNS)


def _line_fields() -> Column:
    def field(order: int, name: str, value: Column, kind: str) -> Column:
        return F.struct(
            F.lit(order).alias("ord"),
            F.lit(name).alias("name"),
            value.cast("string").alias("value"),
            F.when(value.isNull(), "VOID").otherwise(kind).alias("value_kind"),
        )

    return F.array(
        field(0, "flag", F.col("flag"), "STRING"),
        field(1, "status", F.col("status"), "STRING"),
        field(2, "cents", F.col("cents"), "BIGINT"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["event_id", "user_id", "event_type", "props"]
    return spread(table(spark, sf_dir, "events").select(*columns))


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("document"),
        key.alias("page"),
        F.when(key % 4 != 3, F.col("event_type")).alias("reply"),
        F.when(key % 5 != 0, F.col("user_id")).alias("prompt_tokens"),
        F.when(key % 3 != 0, key % 1000).alias("completion_tokens"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    key = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"user":{"value":'), F.col("user_id").cast("string"), F.lit(',"confidence":"90"},'),
        F.lit('"k":{"value":"'), k, F.lit('","confidence":'), (key % 103).cast("string"),
        F.lit('},"type":"'), F.col("event_type"), F.lit('","note":{"value":null,"confidence":true}}'),
    )
    reply = (
        F.when(key % 4 == 0, body)
        .when(key % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(key % 4 == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .otherwise("no object in this reply")
    )
    return events.select(
        F.col("user_id").cast("string").alias("document"), key.alias("page"), reply.alias("reply")
    )


EDGE_VALUES = ["12", "[1,{k}]", '{"x":{k}}', "null", '"   "', "true"]
EDGE_CONFIDENCES = [
    ',"confidence":85.7', ',"confidence":true', ',"confidence":"90"', ',"confidence":-1',
    ',"confidence":101', "", ',"confidence":null', ',"confidence":100',
]


def edge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with every kind of value and confidence, and a repeated key."""
    events = _events(spark, sf_dir)
    key = F.col("event_id")
    value = F.replace(
        F.get(F.array(*[F.lit(v) for v in EDGE_VALUES]), (key % 6).cast("int")),
        F.lit("{k}"),
        F.get_json_object("props", "$.k"),
    )
    conf = F.get(F.array(*[F.lit(c) for c in EDGE_CONFIDENCES]), (key % 8).cast("int"))
    reply = F.concat(
        F.lit('{"b":"first","a":{"value":'), value, conf, F.lit('},"plain":'), value,
        F.lit(',"b":{"other":1}}'),
    )
    return events.select(
        F.col("user_id").cast("string").alias("document"), key.alias("page"), reply.alias("reply")
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    key = F.col("event_id")
    x1, y1 = key % 100, key % 37
    return events.select(
        F.col("user_id").cast("string").alias("document"),
        (key % 3 + 1).alias("page"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + key * 7 % 300 - 20).alias("x2"),
        (y1 + key * 13 % 61 - 30).alias("y2"),
        (key % 3 * 400 + 900).alias("width"),
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 gray rasters."""
    gray = F.transform(
        "embedding",
        lambda v: F.floor(
            (F.greatest(F.lit(-0.5), F.least(F.lit(0.5), v.cast("double"))) + 0.5) * 255
        ).cast("smallint"),
    )
    return table(spark, sf_dir, "embeddings").select(
        F.lit("").alias("document"),
        F.col("vec_id").alias("page"),
        F.lit(8).alias("width"),
        gray.alias("gray"),
        "label",
    )


BUCKETS = ["input", "output", "skip", "review"]
SUFFIXES = [".pdf", ".PDF", ".png", ".png", ".txt"]


def _place() -> tuple[Column, Column, Column]:
    key = F.col("page_id")
    bucket = F.get(F.array(*[F.lit(b) for b in BUCKETS]), (key % 4).cast("int"))
    nested = (key % 4 != 0) & (F.floor(key / 4) % 2 == 0)
    deeper = F.when(key % 11 == 0, "/inner").otherwise("")
    folder = F.when(nested, F.concat(F.lit("d"), F.floor(key / 20).cast("string"), deeper)).otherwise("")
    return bucket, folder, F.concat(F.lit("p"), key.cast("string"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A main file per web page, and a record file for two of three."""
    key = F.col("page_id")
    bucket, folder, stem = _place()
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (key % 5).cast("int"))
    names = F.array_compact(
        F.array(F.concat(stem, suffix), F.when(key % 3 != 0, F.concat(stem, F.lit(".json"))))
    )
    return table(spark, sf_dir, "pages").select(
        bucket.alias("bucket"),
        folder.alias("folder"),
        F.explode(names).alias("name"),
        F.char_length("url").cast("bigint").alias("size"),
    )


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the record files: some corrupt, empty, not objects, or without a cost."""
    key = F.col("page_id")
    bucket, folder, stem = _place()
    number = key.cast("string")
    record = (
        F.when(key % 7 == 0, F.concat(F.lit('{"page":'), number))
        .when(key % 7 == 1, "{}")
        .when(key % 7 == 2, F.concat(F.lit("["), number, F.lit("]")))
        .when(key % 7 < 5, F.concat(F.lit('{"page":'), number, F.lit(',"cost":{"by_model":{}}}')))
        .otherwise(F.concat(F.lit('{"page":'), number, F.lit("}")))
    )
    return table(spark, sf_dir, "pages").filter(key % 3 != 0).select(
        bucket.alias("bucket"), folder.alias("folder"), stem.alias("stem"), record.alias("record")
    )


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    bucket, _, stem = _place()
    kind = (
        F.when(key % 6 < 2, "page").when(key % 6 == 2, "document").otherwise("input")
    )
    target = (
        F.when(key % 6 == 0, stem)
        .when(key % 6 == 1, F.concat(F.lit("gone"), key.cast("string")))
        .when(key % 6 == 2, F.concat(F.lit("d"), F.floor(key / 20).cast("string")))
        .when(key % 6 == 3, F.concat(F.lit("../"), stem))
        .otherwise(F.concat(stem, F.lit(".pdf")))
    )
    place = F.when(kind == "input", "input").otherwise(bucket)
    return (
        table(spark, sf_dir, "pages")
        .select(kind.alias("kind"), place.alias("bucket"), target.alias("target"))
        .distinct()
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    number = key.cast("string")
    name = (
        F.when(key % 6 == 0, F.concat(F.lit("scan/"), number, F.lit(".pdf")))
        .when(key % 6 == 1, F.concat(number, F.lit(".PDF")))
        .when(key % 12 == 2, "..")
        .when(key % 12 == 8, F.when(key % 24 == 8, ".").otherwise("./."))
        .when(key % 6 == 3, F.concat(number, F.lit(".txt")))
        .when(key % 6 == 4, F.concat(F.lit("a/b/"), number, F.lit(".pdf/")))
        .otherwise(F.concat(F.lit("a/../"), number))
    )
    return table(spark, sf_dir, "orders").select(key.alias("upload_id"), name.alias("filename"))


TEMPLATE_TEXTS = [
    '{"extracted_fields":{"{t}":"","z":"","  ":""},"no_need_page":{"{t}-note":""},'
    '"multiple-docs":{"same-words-every-pages":{"n{k}":"","":""}}}',
    '{"extracted_fields":["{t}","a"],"no_need_page":["x{k}"],'
    '"multiple-docs":{"same-words-every-pages":["{t}","n{k}"]}}',
    '{"{t}":"","b":""}',
    '{"extracted_fields":{"{t}":""',
    '{"extracted_fields":{"k{k}":1},"no_need_page":{}}',
    '["{t}","n{k}"]',
    '{"extracted_fields":{"c":""},"no_need_page":{"{t}":""},'
    '"multiple-docs":{"same-words-every-pages":["n{k}"," "]}}',
    "",
]


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template texts of every shape; the last is missing."""
    key = F.col("event_id")
    texts = F.array(*[F.lit(t) for t in TEMPLATE_TEXTS])
    text = F.get(texts, (key % len(TEMPLATE_TEXTS)).cast("int"))
    filled = F.replace(
        F.replace(text, F.lit("{t}"), F.col("event_type")),
        F.lit("{k}"),
        F.get_json_object("props", "$.k"),
    )
    return _events(spark, sf_dir).select(
        key.alias("template_id"), F.nullif(filled, F.lit("")).alias("template")
    )
