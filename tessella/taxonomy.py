"""The 24 x 24 taxonomy of topics and formats, its aliases, and its dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Labels in their order, which numbers the bins, and aliases.
TOPICS = [
    "software", "software_development", "electronics_and_hardware", "science_math_and_technology", "entertainment", "games", "literature",
    "art_and_design", "fashion_and_beauty", "food_and_dining", "home_and_hobbies", "sports_and_fitness", "social_life", "education_and_jobs", "religion",
    "politics", "finance_and_business", "industrial", "transportation", "health", "travel_and_tourism", "history_and_geography", "crime_and_law",
    "adult_content",
]
FORMATS = [
    "academic_writing", "nonfiction_writing", "creative_writing", "personal_blog", "news_article", "news_org", "audio_transcript", "knowledge_article",
    "faq", "q_a_forum", "tutorial", "documentation", "structured_data", "content_listing", "listicle", "product_page", "user_review", "customer_support",
    "spam_ads", "about_org", "about_pers", "legal_notices", "comment_section", "truncated",
]
TOPIC_ALIASES = {
    "adult": "adult_content", "art_design": "art_and_design", "crime_law": "crime_and_law", "education_jobs": "education_and_jobs",
    "hardware": "electronics_and_hardware", "fashion_beauty": "fashion_and_beauty", "finance_business": "finance_and_business", "food_dining": "food_and_dining",
    "history": "history_and_geography", "home_hobbies": "home_and_hobbies", "science_tech": "science_math_and_technology", "software_dev": "software_development",
    "sports_fitness": "sports_and_fitness", "travel": "travel_and_tourism",
}
LABEL_PREFIX = "__label__"
TYPOS = {"__label__electronics_and_hardare": "__label__electronics_and_hardware"}
DISPLAY = {"faq": "FAQ", "q a forum": "Q&A Forum", "about org": "About Org", "about pers": "About Person", "news org": "News Org"}
# The compared benchmarks, their labels and groups.
BENCHMARKS = [
    ("socialiqa", "SocialIQA", "social_reasoning"), ("mmlu_social_science", "MMLU-Social", "knowledge_recall"), ("arc_challenge", "ARC-Challenge", "knowledge_recall"),
    ("mmlu_stem", "MMLU-STEM", "knowledge_recall"), ("bbh_snarks_instruct", "BBH Snarks", "commonsense_reasoning"),
    ("bbh_causal_judgement_instruct", "BBH Causal-Judgement", "commonsense_reasoning"), ("bbh_sports_understanding_instruct", "BBH Sports-Understanding", "commonsense_reasoning"),
]


def dim_benchmark(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BENCHMARKS, "benchmark string, label string, benchmark_group string")


def dim_topic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TOPICS)), "topic_idx int, topic string")


def dim_format(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FORMATS)), "format_idx int, format string")


def dim_bin(spark: SparkSession) -> DataFrame:
    """All 576 bins; bin_id counts from 1."""
    rows = [(i * len(FORMATS) + j + 1, t, f) for i, t in enumerate(TOPICS) for j, f in enumerate(FORMATS)]
    return spark.createDataFrame(rows, "bin_id int, topic string, format string")
