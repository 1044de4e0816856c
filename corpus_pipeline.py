"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Each stage takes all that its predecessor kept. All but the last return the columns of
``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm import language_id, line_dedup, ngram_join, packing, pii
from quarterdeck.llm.common import share_code
from quarterdeck.session import pin, scratch_path

#: The part of its bytes that a document must keep where lines go: the similarity of near duplicates is 0.8.
LEAST_LEFT = 0.2


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those whose text has none, or fits none, go.

    Where no document has a ``lang``, nothing can be judged and all stay. Null and empty texts have no
    language. Rows that repeat an id are judged by their own texts, and null ids are ids like any other.
    """
    model = language_id.fit_text(docs)
    if not model.langs:
        return docs
    body = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    records = language_id.records_of(docs).withColumn("body", F.xxhash64("text"))
    # the verdicts are settled before they are filtered, and the rejected written, so that the join knows how few they are
    judged = pin(language_id.identify(records, model).select("doc_id", "body", "accepted"), "judged")
    rejected = pin(judged.where("NOT accepted").select(F.col("doc_id").alias("gone"), F.col("body").alias("gone_body")).distinct(), "rejected")
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["gone"]) & (body == rejected["gone_body"]), "left_anti")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and documents that keep less than a fifth of their bytes.

    Those repeat what is kept elsewhere; what is left of them is too little for the next stage to tell. A
    null text becomes empty and stays. Rows that repeat an id are parts of one document.
    """
    return _counted(line_dedup.without_repeated_lines(docs, least_left=LEAST_LEFT))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays; texts without words, and null ids, stay."""
    found = ngram_join.near_duplicates(docs)
    gone = pin(found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; null and empty texts stay as they are."""
    return _counted(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents that are left; an empty one is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", keep_languages), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_duplicates),
          ("personal data", redact_personal_data), ("best-fit packing", pack_sequences)]

#: No SQL: the last stage holds the ids of a tokenizer. The tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    share_code(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
