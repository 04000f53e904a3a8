"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import langid, mixing, ngram_join, packing, suffix, warc
from fleetlens.llm.queries import tokenizer_path
from fleetlens.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without text or without a letter go."""
    model = langid.fit(docs, ~langid.held_out())
    return langid.predict_rows(docs.select(*COLUMNS), model).where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that links of Jaccard similarity 0.8 connect."""
    first = ngram_join.group(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi").select(*COLUMNS)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 100 bytes; n_chars follows the text."""
    out = suffix.remove_repeats(docs, as_text=True, keep=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "rest.lang", "rest.source", F.char_length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that repeat a doc_id are each taken as often as the one
    that the mix takes most."""
    taken = mixing.mix(docs, mixing.word_count(F.col("text"))).groupBy(F.col("doc_id").alias("of")).agg(F.max("copies").alias("copies"))
    joined = docs.join(taken.where("copies > 0"), F.col("doc_id").eqNullSafe(F.col("of")))
    return mixing.emit(joined).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.best_fit(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", drop_repeated_strings),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Tokens, the model and the packing are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. What a stage keeps is a table in the shared folder, which goes
    when its follower is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            warc.remove_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
