"""From raw documents to packed training sequences, in five stages.

Each stage is written as Parquet and read again as the next one's input. Until the last they
return the columns of ``documents``:

1. ``language_id``: documents whose text has no letters go.
2. ``near_duplicates``: of each group linked by five-word shingles with a Jaccard similarity of
   0.8 or more, the document with the smallest id stays; rows without id all stay.
3. ``substring_dedup``: word windows that occur more than once are cut out of the texts; a
   document of which nothing is left goes.
4. ``source_mixing``: each leaf of the domain-language-source tree keeps the documents of its
   token-prefix; none is repeated.
5. ``best_fit_packing``: the kept documents, tokenised and packed into sequences of 2048.

Defined results, for each stage: a null or empty text has no language and goes in stage 1 (where
no row names a language nothing can be learned, and all stay); equal texts with different ids are
near duplicates, of which the smallest id stays; repeated rows of one id are one document until the
mix, and pass it together; rows without id are never near duplicates of others; texts of any length are
read whole; ties go to the smaller id; further columns, whatever their names, pass through unchanged
until the last stage, which returns the columns of ``packing.pack``; no documents give no rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioline.llm import language_id, mixing, packing, queries, shingle_join, substring_dedup
from folioline.session import written

#: Nine tenths of the tokens, none twice.
MIX = replace(queries.MIX, share=(9, 10), max_epochs=1)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_first(docs, percent=80, width=5)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.cut_repeats(
        docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole")), width=35, keep_layout=True
    )
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("whole.n_chars")).cast(kind)
    return cut.where("n_words > n_removed").select(
        *[made.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns]
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = substring_dedup.row_key("text", "lang", "source").alias("doc_id")
    keyed = docs.select(F.struct(*docs.columns).alias("whole"), key, "text", "lang", "source")
    chosen = mixing.select_mix(mixing.with_domain(keyed.drop("whole")), MIX).select("doc_id").distinct()
    return keyed.select("whole", "doc_id").join(chosen, "doc_id", "left_semi").select("whole.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.TOKENIZER, ranks_path=queries.RANKS)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Tokenising, and the hashes behind the other stages, are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
