"""Readers of input folders, record files, templates and model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioline.functions.json import accept_repeated_keys, kind_of_text
from folioline.functions.names import file_stem, has_suffix, last_segment
from folioline.schemas import CALLS


def scan_input(spark: SparkSession, directory: str, suffix: str = "pdf") -> DataFrame:
    """``(path, name, stem, size)`` of the folder's files with a suffix in any case.

    The bytes are not read: the content column is pruned from the scan.
    """
    either_case = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*.{either_case}")
        .load(directory)
        .select("path", F.col("length").alias("size"))
    )
    named = input_files(found).select("path", "name", "stem", "size")
    return named.filter(has_suffix(F.col("name"), suffix))


def input_files(found: DataFrame) -> DataFrame:
    """Add the name and stem of each ``path``."""
    name = last_segment(F.col("path"))
    return found.withColumn("name", name).withColumn("stem", file_stem(F.col("name")))


def _below(path: Column, root: str) -> Column:
    """Part of a file's path below a folder."""
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    return F.substring_index(path, f"/{tail}/", -1)


def read_record_texts(spark: SparkSession, root: str, bucket: str) -> DataFrame:
    """JSON records below a bucket's folder as ``(bucket, folder, stem, record)`` texts."""
    files = (
        spark.read.text(
            root, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True
        )
        .select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("path"))
    )
    place = F.url_decode(_below(F.col("path"), root))
    name = last_segment(place)
    folder = F.when(place.contains("/"), F.regexp_replace(place, r"/[^/]*$", "")).otherwise("")
    return files.select(
        F.lit(bucket).alias("bucket"), folder.alias("folder"), file_stem(name).alias("stem"), "record"
    )


def read_records(
    spark: SparkSession, root: str, schema: str, one_per_file: bool = False
) -> DataFrame:
    """Records with a declared schema, from JSON lines or from one record per file.

    Unreadable texts and texts that are no object are dropped.
    """
    accept_repeated_keys(spark)
    texts = spark.read.text(
        root, wholetext=one_per_file, pathGlobFilter="*.json", recursiveFileLookup=True
    )
    return (
        texts.filter(kind_of_text(F.col("value")) == "OBJECT")
        .select(F.from_json("value", schema).alias("record"))
        .select("record.*")
    )


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Template files as ``(path, template)`` texts."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("template")
    )


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Model replies with their usage."""
    return ingest_calls(spark.read.schema(CALLS).json(path))


def ingest_calls(calls: DataFrame) -> DataFrame:
    """Missing reply text becomes '', missing token counts 0."""
    return (
        calls.withColumn("reply", F.coalesce("reply", F.lit("")))
        .withColumn("input_tokens", F.coalesce("prompt_tokens", F.lit(0)).cast("bigint"))
        .withColumn("output_tokens", F.coalesce("completion_tokens", F.lit(0)).cast("bigint"))
        .drop("prompt_tokens", "completion_tokens")
    )


def ocr_words(pages: DataFrame, text: str = "text", conf: str = "conf") -> DataFrame:
    """Parallel word and confidence arrays to ``(document, page, word_no, text, conf)``."""
    both = F.arrays_zip(F.col(text).alias("text"), F.col(conf).alias("conf"))
    return pages.select("document", "page", F.posexplode(both).alias("_pos", "_word")).select(
        "document",
        "page",
        (F.col("_pos") + 1).alias("word_no"),
        F.col("_word.text").alias("text"),
        F.col("_word.conf").alias("conf"),
    )
