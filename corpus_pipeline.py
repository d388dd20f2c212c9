"""A corpus pipeline of five stages over `documents`, each calling one operator of tessella.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the
shared folder, and the next stage works on what was read back. All but the last return the columns
of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, langid, ngram_join, packing, span_dedup
from tessella.llm.common import materialize, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of a text's n-grams that its language has; below it a text looks like no language.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; those without a letter (null and empty texts among them), or
    that look like no language learned, go. Without any labelled document all are kept. Rows that
    repeat are judged alike; columns other than those of documents are dropped, whatever their names."""
    prepare(spark)
    model = langid.fit(docs)
    if not model.langs:
        return docs.select(COLUMNS)
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (word 5-grams, Jaccard of 0.8 or more) the smallest doc_id
    stays. Rows without a doc_id stay; rows that repeat a doc_id are one document and stay together."""
    prepare(spark)
    found = ngram_join.jaccard_components(docs, size=5, num=80, den=100)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated spans go from all but the document with the smallest doc_id (ties: the
    earlier place in it); n_chars follows the text. Null texts stay null with n_chars 0, rows without a
    doc_id stay as they are, rows that repeat a doc_id are cut alike. Every row stays, also with an
    empty text. An n_removed or _spans column of the input gives way."""
    prepare(spark)
    found = span_dedup.remove_repeats(docs)
    return found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go; null and empty texts hold none, so they stay,
    as all do where the benchmark is empty. Rows that repeat go or stay together. Columns of the input
    named items or coverage give way."""
    prepare(spark)
    found = decontamination.flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("items") == 0).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 1024 ids. Null and empty texts are their
    end id; rows that repeat a doc_id, or have none, are packed each on its own; texts of one size are
    ranked by doc_id. No documents, no rows."""
    prepare(spark)
    return packing.pack(docs, capacity=1024, end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", drop_repeated_spans),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Tokenisation and column generation have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
