"""Listings and housekeeping over the buckets' file manifest.

Manifest: ``(bucket, folder, name, size)``, one row per file; ``folder`` is '' at the top
of a bucket. Record files: ``(bucket, folder, stem, record)`` with the JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioline.functions.json import accept_repeated_keys, kind_of_text, parse_whole
from folioline.functions.names import file_stem, has_suffix
from folioline.operators.numbering import number_rows

PLACE = ["bucket", "folder", "stem"]


def input_listing(files: DataFrame) -> DataFrame:
    """Input documents with their size; sort at the sink."""
    top = (F.col("bucket") == "input") & (F.col("folder") == "")
    return files.filter(top & has_suffix(F.col("name"), "pdf")).select("name", "size")


def list_pages(files: DataFrame, image_format: str = "png") -> DataFrame:
    at_top = (F.col("bucket") != "input") & (F.col("folder") == "")
    image = F.col("name").endswith(f".{image_format}")
    return files.filter(at_top & image).select(
        "bucket",
        "folder",
        file_stem(F.col("name")).alias("stem"),
        F.lit("page").alias("kind"),
        file_stem(F.col("name")).alias("name"),
        F.col("name").alias("file"),
    )


def list_documents(files: DataFrame) -> DataFrame:
    """PDF files exactly one folder down."""
    nested = (F.col("bucket") != "input") & (F.col("folder") != "")
    one_down = ~F.col("folder").contains("/")
    stem = file_stem(F.col("name"))
    return files.filter(nested & one_down & F.col("name").endswith(".pdf")).select(
        "bucket",
        "folder",
        stem.alias("stem"),
        F.lit("document").alias("kind"),
        F.concat("folder", F.lit("/"), stem).alias("name"),
        F.concat("folder", F.lit("/"), "name").alias("file"),
    )


def bucket_listing(files: DataFrame, records: DataFrame, image_format: str = "png") -> DataFrame:
    """Pages and documents of a bucket with their record, ``{}`` when missing or corrupt."""
    items = list_pages(files, image_format).unionByName(list_documents(files))
    accept_repeated_keys(records.sparkSession)
    readable = records.filter(parse_whole(F.col("record")).isNotNull()).select(*PLACE, "record")
    return items.join(readable, PLACE, "left").select(
        "bucket", "kind", "name", "file", F.coalesce("record", F.lit("{}")).alias("record")
    )


def ordered_listing(listing: DataFrame) -> DataFrame:
    """Listing in display order: pages before documents, by file name. For the last step."""
    return listing.orderBy("bucket", F.desc("kind"), "file")


def ranked_listing(listing: DataFrame) -> DataFrame:
    """Each entry's ``position`` in its bucket's display order, without a sort of everything."""
    block = F.when(F.col("kind") == "page", 0).otherwise(1 << 24) + F.ascii("file")
    return number_rows(listing, ["bucket"], [F.desc("kind"), "file"], block, "position")


def cost_sources(records: DataFrame) -> DataFrame:
    """Records the cost tracker reads: output's one folder down, review's with a cost."""
    accept_repeated_keys(records.sparkSession)
    is_object = kind_of_text(F.col("record")) == "OBJECT"
    readable = records.filter(is_object & (F.size(F.json_object_keys("record")) > 0))
    one_down = (F.col("folder") != "") & ~F.col("folder").contains("/")
    output = readable.filter((F.col("bucket") == "output") & one_down)
    review = readable.filter(
        (F.col("bucket") == "review")
        & (F.col("folder") == "")
        & F.array_contains(F.json_object_keys("record"), "cost")
    )
    return output.unionByName(review)


def record_lookup(records: DataFrame, requests: DataFrame) -> DataFrame:
    """One record per request ``(bucket, stem)``; ``found`` is false when there is none.

    ``status`` tells a missing record from a name that is no bare file name.
    """
    top = records.filter(F.col("folder") == "").select("bucket", "stem", "record")
    safe = is_safe_name(F.col("stem"))
    looked_up = requests.join(top, ["bucket", "stem"], "left").withColumn(
        "record", F.when(safe, F.col("record"))
    )
    found = F.col("record").isNotNull()
    return looked_up.withColumn("found", found).withColumn(
        "status", F.when(~safe, "invalid").when(found, "found").otherwise("not_found")
    )


def is_safe_name(name: Column) -> Column:
    """A bare file name: no folder part, not the folder itself or its parent."""
    return ~name.contains("/") & ~name.isin(".", "..")


def _targets(files: DataFrame, image_format: str) -> DataFrame:
    """Every file with the delete requests that would remove it."""
    top = F.col("folder") == ""
    name = F.col("name")
    by_file = F.when(top & (F.col("bucket") == "input"), F.struct(F.lit("input").alias("kind"), name.alias("target")))
    top_folder = F.element_at(F.split("folder", "/"), 1)
    by_folder = F.when(~top, F.struct(F.lit("document").alias("kind"), top_folder.alias("target")))
    page_stem = F.when(
        top & (name.endswith(f".{image_format}") | name.endswith(".json")), file_stem(name)
    )
    by_page = F.when(
        page_stem.isNotNull(), F.struct(F.lit("page").alias("kind"), page_stem.alias("target"))
    )
    options = F.array_compact(F.array(by_file, by_folder, by_page))
    return files.withColumn("_t", F.explode(options)).select(*files.columns, "_t.kind", "_t.target")


def delete_outcomes(
    files: DataFrame, requests: DataFrame, image_format: str = "png"
) -> DataFrame:
    """Status per request ``(kind, bucket, target)``: deleted, not_found or invalid.

    Files are counted per target before the join, so a folder with very many files
    arrives as one row.
    """
    key = ["kind", "bucket", "target"]
    counts = _targets(files, image_format).groupBy(*key).agg(F.count(F.lit(1)).alias("files"))
    safe = is_safe_name(F.col("target"))
    return (
        requests.select(*key)
        .join(counts, key, "left")
        .withColumn("files", F.when(safe, F.coalesce("files", F.lit(0))).otherwise(0))
        .withColumn(
            "status",
            F.when(~safe, "invalid").when(F.col("files") > 0, "deleted").otherwise("not_found"),
        )
    )


def delete_survivors(
    files: DataFrame, requests: DataFrame, image_format: str = "png"
) -> DataFrame:
    """The manifest without the files that some request removes."""
    key = ["kind", "bucket", "target"]
    safe = requests.filter(is_safe_name(F.col("target"))).select(*key)
    place = ["bucket", "folder", "name"]
    gone = _targets(files, image_format).join(safe, key, "left_semi").select(*place)
    return files.join(gone, place, "left_anti")


def clearable(files: DataFrame, image_format: str = "png") -> DataFrame:
    """Files a clear removes: whole folders, and at the top the bucket's own kinds."""
    name = F.col("name")
    own = F.when(F.col("bucket") == "input", has_suffix(name, "pdf")).otherwise(
        has_suffix(name, image_format) | has_suffix(name, "json") | has_suffix(name, "pdf")
    )
    return files.filter((F.col("folder") != "") | own)


def clear_counts(files: DataFrame, image_format: str = "png") -> DataFrame:
    """Entries removed per cleared bucket; a folder counts once, however full."""
    top_folder = F.element_at(F.split("folder", "/"), 1)
    entry = F.when(F.col("folder") != "", F.concat(F.lit("d:"), top_folder)).otherwise(
        F.concat(F.lit("f:"), "name")
    )
    return (
        clearable(files, image_format)
        .select("bucket", entry.alias("entry"))
        .distinct()
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("removed"))
    )


def admit_uploads(uploads: DataFrame) -> DataFrame:
    """Bare name and status of each uploaded ``filename``; only PDF names are saved."""
    path = F.regexp_replace(F.coalesce("filename", F.lit("")), r"(/+\.?)+$", "")
    path = F.regexp_replace(path, r"^\.$", "")
    name = F.regexp_extract(path, r"(?s)([^/]*)$", 1)
    named = uploads.withColumn("name", name)
    # The wording of the refusals.
    return named.withColumn(
        "status",
        F.when(F.col("name").isin(".", ".."), "invalid file name")
        .when(~F.lower("name").endswith(".pdf"), F.concat(F.lit("'"), "name", F.lit("' is not a PDF")))
        .otherwise("saved"),
    )


# Record columns in display order with their labels.
META_LABELS = [
    ("document", "Document"),
    ("file", "File"),
    ("page", "Page"),
    ("page_count", "Page count"),
    ("quality_score", "Quality score"),
    ("quality_tier", "Quality tier"),
    ("model_used", "Model"),
    ("models_used", "Models"),
    ("confidence_score", "Overall confidence"),
    ("extraction_success", "Extraction success"),
    ("processing_time_seconds", "Processing time"),
    ("skip_reason", "Skip reason"),
    ("split_reply", "Split reply"),
    ("split_reason", "Split reason"),
    ("error", "Error"),
]


def meta_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """Record columns as ``(position, label, text)`` rows; absent values are left out.

    ``keys`` identify a record and are kept; lists are joined by a comma.
    """
    types = dict(records.dtypes)
    pairs = []
    for position, (column, label) in enumerate(META_LABELS, 1):
        if column not in types:
            continue
        text = (
            F.array_join(F.col(column).cast("array<string>"), ", ")
            if types[column].startswith("array")
            else _display(F.col(column), types[column])
        )
        pairs.append(
            F.struct(
                F.lit(position).alias("position"), F.lit(label).alias("label"), text.alias("text")
            )
        )
    named = records.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.explode(F.array(*pairs)).alias("_m"))
    return named.filter(F.col("_m.text").isNotNull()).select(
        *[F.col(f"_key_{k}").alias(f"record_{k}") for k in keys], "_m.position", "_m.label", "_m.text"
    )


def _display(value: Column, kind: str) -> Column:
    """Whole doubles without a fraction, as a browser shows them."""
    text = value.cast("string")
    return F.regexp_replace(text, r"\.0$", "") if kind == "double" else text


def field_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of each record with confidence, a missing one counted 0."""
    return records.select(
        *keys,
        F.posexplode("extracted_fields").alias("position", "name", "value"),
        "field_confidence_scores",
    ).select(
        *keys,
        "position",
        "name",
        "value",
        F.coalesce(F.try_element_at("field_confidence_scores", F.col("name")), F.lit(0)).alias(
            "confidence"
        ),
    )
