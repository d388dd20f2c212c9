"""Lexical profiles: punctuation, text statistics, lexicon and tense counts, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import word_count

#: Our own small open word lists of closed classes.
LEXICON = {
    "pronoun": "i me my we us our you your he him his she her it its they them their".split(),
    "article": "a an the".split(),
    "preposition": "of in to for with on at by from as about into over after".split(),
    "conjunction": "and or but nor so yet because although if while".split(),
    "negation": "no not never none nobody nothing".split(),
    "cognition": "think know believe because reason understand consider".split(),
    "informal": "ok yeah hey wow lol gonna wanna".split(),
}
#: Formats of each interactional group, and whether a format counts as interactive.
GROUPS = {
    "dialogue": ["q_a_forum", "comment_section", "customer_support", "faq"],
    "narrative": ["creative_writing", "personal_blog", "nonfiction_writing", "audio_transcript"],
    "instruction": ["tutorial", "documentation", "listicle"],
    "reference": ["academic_writing", "knowledge_article", "structured_data", "content_listing"],
    "commercial": ["product_page", "user_review", "spam_ads"],
    "institutional": ["about_org", "about_pers", "legal_notices", "news_article", "news_org", "truncated"],
}


def punctuation(text: Column) -> dict[str, Column]:
    def n(pattern: str) -> Column:
        return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))

    known = {"period": r"\.", "comma": ",", "question": r"\?", "exclamation": "!", "apostrophe": "'"}
    out = {name: n(p) for name, p in known.items()}
    return {"all_punctuation": n(r"[!-/:-@\[-`{-~]")} | out | {"other_punctuation": n(r"[\"-&(-+\-/:->@\[-`{-~]")}


def statistics(text: Column) -> dict[str, Column]:
    """Words, words a sentence and the share of words with more than six letters."""
    words = word_count(text)
    sentences = F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(0)))
    long = F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z]{7,}")), F.lit(0))
    return {"word_count": words, "words_per_sentence": words / sentences, "long_word_share": F.try_divide(long, words)}


def tenses(text: Column) -> dict[str, Column]:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    known = {"past": "was|were|had|did|[a-z]+ed", "present": "is|are|am|has|have|does|do", "future": "will|shall|gonna"}
    return {name: _count_like(words, pattern) for name, pattern in known.items()}


def _count_like(words: Column, pattern: str) -> Column:
    return F.greatest(F.size(F.filter(words, lambda w: w.rlike(f"^(?:{pattern})$"))), F.lit(0))


def lexicon_counts(docs: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, category, n): words of each category. The lexicon is a small table, broadcast."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(w, c) for c, words in (lexicon or LEXICON).items() for w in words], "word string, category string")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), 0)).alias("word"))
    return words.join(F.broadcast(table), "word").groupBy("doc_id", "category").agg(F.count("*").alias("n"))


def dimension_counts(counts: DataFrame, crosswalk: dict[str, list[str]]) -> DataFrame:
    """Sums of the categories that make up each dimension."""
    table = counts.sparkSession.createDataFrame([(d, c) for d, cs in crosswalk.items() for c in cs], "dimension string, category string")
    return counts.join(F.broadcast(table), "category").groupBy("doc_id", "dimension").agg(F.sum("n").alias("n"))


def densities(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """Counts by a thousand words."""
    words = docs.select("doc_id", word_count(F.col("text")).alias("words"))
    return counts.join(words, "doc_id").withColumn("per_1k", F.try_divide(F.col("n") * 1000.0, "words"))


def composite(features: DataFrame, columns: list[str], name: str = "composite") -> DataFrame:
    """Mean z-score of the features (sample deviation; without spread 0)."""
    moments = features.agg(*[f(c).alias(f"_{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp))])  # one row
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{i}"), F.nullif(F.col(f"_s{i}"), F.lit(0.0))), F.lit(0.0)) for i, c in enumerate(columns)]
    return features.join(F.broadcast(moments)).withColumn(name, sum(z[1:], z[0]) / len(z)).drop(*moments.columns)


def format_group(format_: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, formats in GROUPS.items():
        out = F.when(format_.isin(formats), name).otherwise(out)
    return out


def interactive(format_: Column) -> Column:
    """Dialogue or not; null for institutional formats."""
    group = format_group(format_)
    return F.when(group == "institutional", F.lit(None)).otherwise(group == "dialogue")
