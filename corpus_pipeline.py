"""A training corpus from `documents`: language ID, line dedup, near dedup, source mixing, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all rows its predecessor kept; its result is
written and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import langid
from termloom.llm.common import free_names, scratch, table
from termloom.llm.linededup import drop_common_lines
from termloom.llm.mixing import mixed_documents
from termloom.llm.neardup import keep_one_of_each
from termloom.llm.packing import pack_documents
from termloom.llm.queries import MIN_LINE_DOCS, public_file
from termloom.tables import forget, new_path

#: A document is rejected where no language of the model reaches this posterior.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or of no clear language, go. Repeated rows fare alike; an empty table stays empty."""
    model = langid.train(docs, langid.vocabulary(public_file("piece_bpe_32k.model")))
    lang, score = free_names(docs, "lang_pred", "score")
    found = langid.identify(docs, model, (lang, score))
    clear = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)
    return found.filter(clear).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; n_chars follows the text. A document of such lines alone, or without text, stays with an empty text."""
    cleaned = drop_common_lines(docs, min_docs=MIN_LINE_DOCS, names=tuple(free_names(docs, "n_lines", "n_dropped")))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id; documents without words all stay. See keep_one_of_each for odd rows."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its slots; those without words stay once. See mixed_documents for odd rows."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces (doc_id, piece, start, length, ids_crc32) and their places in sequences of 1024 tokens; a text of null or nothing is its end token."""
    return pack_documents(docs, public_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the language model nor the plan of the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage writes on its way is deleted after it, and its result once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
