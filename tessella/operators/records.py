"""Corpus records: cleaning, enrichment and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import taxonomy
from tessella.functions import numbers, text, web


def project(records: DataFrame) -> DataFrame:
    """id, text and metadata; absent metadata is an empty map."""
    return records.select("id", "text", F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")).alias("metadata"))


def drop_reason(body: Column, min_words: int = 0, min_tokens: int = 0) -> Column:
    """Why a record goes: blank, short_words, short_tokens; null if it stays."""
    words = text.word_count(body)
    out = F.when(text.is_blank(body), "blank").when(words < min_words, "short_words")
    return out.when(numbers.tokens_rounded(words) < min_tokens, "short_tokens") if min_tokens else out


def clean(records: DataFrame, min_words: int = 0, min_tokens: int = 0) -> DataFrame:
    return records.where(drop_reason(F.col("text"), min_words, min_tokens).isNull())


def drop_counts(records: DataFrame, min_words: int = 0, min_tokens: int = 0) -> DataFrame:
    """How many records go, by reason, and stay (kept)."""
    reason = F.coalesce(drop_reason(F.col("text"), min_words, min_tokens), F.lit("kept"))
    return records.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def min_token_words(min_tokens: int) -> int:
    """Words that pass a token minimum: truncated, so that 512 tokens need 379 words."""
    return int(min_tokens / numbers.TOKENS_PER_WORD)


def coverage(records: DataFrame, group: str, min_tokens: int = 512) -> DataFrame:
    """Records of each group before and after the token minimum."""
    passes = text.word_count(F.col("text")) >= min_token_words(min_tokens)
    return records.groupBy(group).agg(F.count("*").alias("n_before"), F.count_if(passes).alias("n_after"))


def bin_id(topic: Column, format_: Column) -> Column:
    """1 .. 576, or null for an unknown label."""
    i = text.lookup({t: str(k) for k, t in enumerate(taxonomy.TOPICS)}, topic).cast("int")
    j = text.lookup({f: str(k) for k, f in enumerate(taxonomy.FORMATS)}, format_).cast("int")
    return i * len(taxonomy.FORMATS) + j + 1


def enrich(records: DataFrame) -> DataFrame:
    """Adds word count, token estimate, length and host to records (text, url, warc_url, source_url)."""
    words = text.word_count(F.col("text"))
    url = web.first_text(F.col("warc_url"), F.col("url"), F.col("source_url"))
    return records.withColumns({"original_word_count": words, "token_count_est": numbers.tokens_rounded(words), "char_length": F.length("text"), "domain": web.domain(url)})


def manifest(records: DataFrame) -> DataFrame:
    """The corpus manifest of records (id, text, shard_path, topic, format, lang, warc_date, url)."""
    words = text.word_count(F.col("text"))
    topic, form = text.normalize_topic(text.strip_label_prefix(F.col("topic"))), text.strip_label_prefix(F.col("format"))
    return records.select(
        F.col("id").alias("doc_id"),
        "shard_path",
        web.source_category(F.col("shard_path")).alias("source_family"),
        topic.alias("topic"),
        form.alias("format"),
        bin_id(topic, form).alias("bin_id"),
        numbers.tokens_ceiled(words).alias("estimated_token_count"),
        numbers.tokens_approximate(F.col("text")).alias("token_count"),
        F.length("text").alias("document_length_chars"),
        words.alias("original_word_count"),
        F.col("lang").alias("language"),
        web.year(F.col("warc_date")).alias("year"),
        web.domain(F.col("url"), strip_www=True).alias("url_domain"),
    )


def strip_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw JSON lines with only id and text; a line that isn't JSON passes as it is."""
    parsed = F.from_json(column, "id string, text string", {"mode": "PERMISSIVE"})
    kept = F.when(F.col(column).rlike(r"^\s*\{") & parsed["id"].isNotNull(), F.to_json(F.struct(parsed["id"].alias("id"), parsed["text"].alias("text"))))
    return lines.withColumn(column, F.coalesce(kept, F.col(column)))


def require_labels(frame: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Fails, when it runs, on a label that isn't allowed."""
    known = F.col(column).isin(allowed)
    return frame.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null"))))))


def sampleable(frame: DataFrame, required: list[str]) -> DataFrame:
    return frame.na.drop(subset=required)


def first_column(frame: DataFrame, *candidates: str) -> str:
    """The first of the columns that is there."""
    for name in candidates:
        if name in frame.columns:
            return name
    raise ValueError(f"none of {candidates} in {frame.columns}")


def keep_first(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in order. The order is explicit, as rows have none of their own."""
    from pyspark.sql import Window

    return frame.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
