"""Bin analytics: from document scores to topic-by-format bins, and what is read off them.

The bin map may be as large as the corpus: it is joined by Spark's own choice of join, never by a
forced broadcast. What has a row a bin (576 at most) is small by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import taxonomy
from tessella.functions import numbers


def document_means(scores: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Mean score of each document over its queries, in double precision."""
    return scores.groupBy(*keys).agg(F.avg(F.col("score").cast("double")).alias("score"))


def attach_bins(docs: DataFrame, bins: DataFrame) -> DataFrame:
    """Left join on doc_id; a document without a bin keeps nulls, to be counted."""
    return docs.join(bins, "doc_id", "left")


def match_counts(docs: DataFrame, bins: DataFrame) -> DataFrame:
    """Documents with and without a bin."""
    return attach_bins(docs, bins).agg(F.count("*").alias("n_docs"), F.count_if(F.col("topic").isNull()).alias("n_missed"))


def finalize(binned: DataFrame, keys: tuple[str, ...] = ("topic", "format")) -> DataFrame:
    """Mean, mean magnitude, population deviation (0 for one row) and count of each bin."""
    x = F.col("score").cast("double")
    return binned.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.avg(x).alias("mean_score"), F.avg(F.abs(x)).alias("abs_mean_score"), F.stddev_pop(x).alias("std_score"), F.count("*").alias("doc_count"))


def score_bins(scores: DataFrame, bins: DataFrame) -> DataFrame:
    return finalize(attach_bins(document_means(scores), bins))


def split_bins(scores: DataFrame, correct: DataFrame, bins: DataFrame) -> DataFrame:
    """Bins by whether the query was answered correctly (query_id, is_correct; null is false)."""
    held = scores.join(correct.select("query_id", F.coalesce("is_correct", F.lit(False)).alias("is_correct")), "query_id")
    return finalize(attach_bins(document_means(held, ("doc_id", "is_correct")), bins), ("is_correct", "topic", "format"))


def per_query_bins(scores: DataFrame, bins: DataFrame) -> DataFrame:
    """Quantiles over queries of the mean score of each bin: exact, with linear interpolation."""
    x = F.col("score").cast("double")
    each = scores.join(bins, "doc_id").groupBy("topic", "format", "query_id").agg(F.avg(x).alias("m"), F.avg(F.abs(x)).alias("a"), F.count("*").alias("n"))
    return each.groupBy("topic", "format").agg(
        F.percentile("m", F.lit(0.5)).alias("median_influence"),
        F.avg("m").alias("mean_influence"),
        F.percentile("m", F.lit(0.25)).alias("p25_influence"),
        F.percentile("m", F.lit(0.75)).alias("p75_influence"),
        F.stddev_pop("m").alias("std_influence"),
        F.percentile("a", F.lit(0.5)).alias("median_abs_influence"),
        F.avg("a").alias("mean_abs_influence"),
        F.max("n").alias("doc_count"),
    )


def axis_order(grid: DataFrame, axis: str, known: tuple[str, ...], value: str = "abs_mean_score") -> DataFrame:
    """Known labels of an axis with their totals and place, the largest first (ties by label)."""
    totals = grid.where(F.col(axis).isin(*known)).groupBy(F.col(axis).alias("label")).agg(F.sum(value).alias("total"))
    return totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "label")))  # 24 labels


def z_scores(grid: DataFrame, value: str = "mean_score", by: tuple[str, ...] = (), zero_sigma: str = "null") -> DataFrame:
    """Adds zscore over each grid by the sample deviation; without spread null, or 0 if
    ``zero_sigma`` is "zero". Null and NaN values don't count and go."""
    w = Window.partitionBy(*by)
    sigma = F.stddev_samp(value).over(w)
    z = F.when(sigma > 0, (F.col(value) - F.avg(value).over(w)) / sigma)
    rows = grid.where(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.withColumn("zscore", F.coalesce(z, F.lit(0.0)) if zero_sigma == "zero" else z)


def bin_statistics(manifest: DataFrame, dim: DataFrame, target: int = 100_000) -> DataFrame:
    """Counts and token statistics of all bins of ``dim``, with their class."""
    stats = manifest.groupBy("topic", "format").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"), F.avg("token_count").alias("a"), F.median("token_count").alias("m"))
    n = F.coalesce("n", F.lit(0))
    kind = F.when(n == 0, "empty").when(n < 1000, "sparse").when(n < target, "partial").otherwise("full")
    return F.broadcast(dim).join(stats, ["topic", "format"], "left").select(
        "bin_id", "topic", "format", n.alias("doc_count"), F.coalesce("t", F.lit(0)).alias("token_count"),
        F.coalesce(numbers.half_even(F.col("a"), 1), F.lit(0.0)).alias("mean_tokens"), F.coalesce(numbers.half_even(F.col("m"), 1), F.lit(0.0)).alias("median_tokens"), kind.alias("classification"),
    )


def composition(manifest: DataFrame) -> DataFrame:
    """Documents and tokens of each pair of labels; null labels are groups."""
    return manifest.groupBy("topic", "format").agg(F.count("*").alias("doc_count"), F.sum("token_count").alias("token_count"), F.sum("estimated_token_count").alias("estimated_token_count"))


def marginals(manifest: DataFrame) -> DataFrame:
    """Topics, formats and pairs in one pass; word sums are tokens over 1.35, truncated."""
    words = F.floor(F.sum("token_count") / numbers.TOKENS_PER_WORD).cast("bigint")
    grouped = manifest.groupingSets([["topic"], ["format"], ["topic", "format"]], "topic", "format")
    return grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("doc_count"), words.alias("word_count_sum"))


def complete(grid: DataFrame, dim: DataFrame, values: list[str]) -> DataFrame:
    """All bins; what the grid lacks is 0."""
    return dim.join(grid, ["topic", "format"], "left").fillna(0, subset=values)


def contrast(a: DataFrame, b: DataFrame, value: str = "zscore") -> DataFrame:
    """Difference of two grids by full outer join; a bin that one lacks is 0 there."""
    left, right = a.select("topic", "format", F.col(value).alias("value_a")), b.select("topic", "format", F.col(value).alias("value_b"))
    return left.join(right, ["topic", "format"], "full_outer").fillna(0.0, subset=["value_a", "value_b"]).withColumn("diff", F.col("value_a") - F.col("value_b"))


def top(frame: DataFrame, order: Column, k: int, *ties: str) -> DataFrame:
    """The k largest, ties by label."""
    return frame.orderBy(order.desc(), *ties).limit(k)


def top_and_bottom(grid: DataFrame, value: str, n: int) -> DataFrame:
    """The n best and worst bins with rank, share and side; the worst stay in rank order."""
    w = Window.orderBy(F.desc(value), "topic", "format")  # 576 rows at most
    ranked = grid.withColumns({"rank": F.row_number().over(w), "share": F.col(value) / F.sum(value).over(Window.partitionBy()), "_n": F.count("*").over(Window.partitionBy())})
    side = F.when(F.col("rank") <= n, "top").when(F.col("rank") > F.col("_n") - n, "bottom")
    return ranked.withColumn("side", side).where("side is not null").drop("_n")


def gini(values: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Gini coefficient; 0 without values or where they sum to 0."""
    w = Window.partitionBy(*by).orderBy(column)
    x, n = F.col(column).cast("double"), F.count("*")
    rows = values.withColumn("_i", F.row_number().over(w))
    total = F.sum(x)
    return rows.groupBy(*by).agg(F.coalesce(F.when(total != 0, 2 * F.sum(F.col("_i") * x) / (n * total) - (n + 1) / n), F.lit(0.0)).alias("gini"))


def effective_bins(values: DataFrame, column: str) -> DataFrame:
    """exp of the entropy of the positive shares; 0 without any."""
    rows = values.where(F.col(column) > 0).withColumn("_p", F.col(column).cast("double") / F.sum(column).over(Window.partitionBy()))
    return rows.agg(F.coalesce(F.exp(-F.sum(F.col("_p") * F.ln("_p"))), F.lit(0.0)).alias("effective_bins"))


def concentration(grid: DataFrame, docs: str = "doc_count", tokens: str = "token_count") -> DataFrame:
    """One row: totals, (near-)empty bins, Gini, effective bins and top shares of a grid."""
    d, t = F.col(docs).cast("double"), F.col(tokens).cast("double")
    all_rows = Window.partitionBy()
    ranked = grid.select(
        d.alias("d"), t.alias("t"),
        F.row_number().over(Window.orderBy(d)).alias("id"), F.row_number().over(Window.orderBy(t)).alias("it"), F.row_number().over(Window.orderBy(t.desc())).alias("r"),
        F.when(d > 0, d / F.sum(d).over(all_rows)).alias("pd"), F.when(t > 0, t / F.sum(t).over(all_rows)).alias("pt"),
    )
    n = F.count("*")

    def unequal(i: str, x: str) -> Column:
        total = F.sum(x)
        return F.coalesce(F.when(total != 0, 2 * F.sum(F.col(i) * F.col(x)) / (n * total) - (n + 1) / n), F.lit(0.0))

    def share(k: int) -> Column:
        return F.when(n >= k, F.sum(F.when(F.col("r") <= k, F.col("t"))) / F.nullif(F.sum("t"), F.lit(0.0))).otherwise(1.0)

    return ranked.agg(
        n.alias("total_bins"), F.count_if(F.col("d") == 0).alias("empty_bins"), F.count_if((F.col("d") > 0) & (F.col("d") < 100)).alias("near_empty_100"), F.count_if((F.col("d") > 0) & (F.col("d") < 1000)).alias("near_empty_1000"),
        unequal("id", "d").alias("gini_doc"), unequal("it", "t").alias("gini_token"),
        F.coalesce(F.exp(-F.sum(F.col("pd") * F.ln("pd"))), F.lit(0.0)).alias("effective_bins_doc"), F.coalesce(F.exp(-F.sum(F.col("pt") * F.ln("pt"))), F.lit(0.0)).alias("effective_bins_token"),
        share(10).alias("top_10_share"), share(50).alias("top_50_share"), share(100).alias("top_100_share"),
    )


def share_ratio(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """log2 of the ratio of two grids' shares of each bin."""
    def shares(g: DataFrame, name: str) -> DataFrame:
        total = F.sum(value).over(Window.partitionBy())
        return g.select("topic", "format", (F.col(value) / F.when(total > 0, total).otherwise(F.raise_error(F.lit("a grid's total is 0")))).alias(name))

    both = shares(a, "share_a").join(shares(b, "share_b"), ["topic", "format"], "full_outer").fillna(0.0, subset=["share_a", "share_b"])
    return both.withColumn("log2_ratio", numbers.log_share_ratio(F.col("share_a"), F.col("share_b")))


def pivot(grid: DataFrame, value: str, formats: list[str] | None = None) -> DataFrame:
    """A row a topic, a column a format."""
    return grid.groupBy("topic").pivot("format", formats or taxonomy.FORMATS).agg(F.first(value))


def marginal_means(grid: DataFrame, label: str) -> DataFrame:
    """Unweighted mean of bin means, and documents, of each label."""
    return grid.groupBy(label).agg(F.avg("mean_score").alias("mean_score"), F.sum("doc_count").alias("doc_count"))


def merge_labels(marginal: DataFrame, mend: dict[str, str]) -> DataFrame:
    """Rows of mended labels merged: sums added up, means worked out anew."""
    label = F.col("label")
    for wrong, right in mend.items():
        label = F.when(F.col("label") == wrong, right).otherwise(label)
    out = marginal.groupBy(label.alias("label")).agg(*[F.sum(c).alias(c) for c in ("doc_count", "score_sum", "word_count_sum", "word_count_docs")])
    return out.withColumns({"word_count_mean": F.try_divide("word_count_sum", "word_count_docs"), "score_mean": F.try_divide("score_sum", "doc_count")})


def score_statistics(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, sum, smallest, largest and mean score; nulls without rows."""
    x = F.col("score").cast("double")
    return scores.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.min(x).alias("lowest"), F.max(x).alias("highest"), F.avg(x).alias("mean"))


def nonzero_fraction(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(F.coalesce(F.try_divide(F.count_if(F.col("score") != 0), F.count("*")), F.lit(0.0)).alias("nonzero_fraction"))


def mismatched_shards(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """Shards whose scores and ids differ in number."""
    a, b = scores.groupBy("shard").agg(F.count("*").alias("n_scores")), ids.groupBy("shard").agg(F.count("*").alias("n_ids"))
    return a.join(b, "shard", "full_outer").fillna(0).where("n_scores != n_ids")


def significant(grid: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Marks the bins whose mean differs from 0 (normal approximation), by Benjamini-Hochberg."""
    se = F.col("std_score") / F.sqrt("doc_count")
    rows = grid.withColumn("p_value", F.when(se > 0, numbers.two_sided_normal(F.col("mean_score") / se)))
    w = Window.orderBy(F.col("p_value").asc_nulls_last(), "topic", "format")
    ranked = rows.withColumns({"_i": F.row_number().over(w), "_n": F.count("p_value").over(Window.partitionBy())})
    passing = F.max(F.when(F.col("p_value") <= alpha * F.col("_i") / F.col("_n"), F.col("_i"))).over(Window.partitionBy())
    return ranked.withColumn("significant", F.coalesce(F.col("_i") <= passing, F.lit(False)) & F.col("p_value").isNotNull()).drop("_i", "_n")


def positive_range(grid: DataFrame, column: str) -> DataFrame:
    """Smallest and largest positive value; nulls without any."""
    x = F.when(F.col(column) > 0, F.col(column))
    return grid.agg(F.min(x).alias("lowest"), F.max(x).alias("highest"))


def column_summary(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest, largest, mean and sample deviation of each column, in one pass."""
    one = frame.agg(*[F.struct(F.min(c).alias("lowest"), F.max(c).alias("highest"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns])
    return one.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column", "s")).select("column", "s.*")


def robust_limit(frame: DataFrame, column: str, q: float = 0.95) -> DataFrame:
    """The q quantile of the finite magnitudes, 1e-8 at least: a symmetric colour limit."""
    x = F.abs(F.col(column).cast("double"))
    return frame.where(~F.isnan(x) & (x < float("inf"))).agg(F.greatest(F.coalesce(F.percentile(x, F.lit(q)), F.lit(0.0)), F.lit(1e-8)).alias("limit"))


def bin_draws(grid: DataFrame, most: int = 200, seed: int = 42) -> DataFrame:
    """Up to ``most`` normal draws of each bin by its mean and deviation, for histograms."""
    n = F.least(F.col("doc_count"), F.lit(most)).cast("int")
    each = grid.where("doc_count > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), n)))
    return each.select("topic", "format", "draw", (F.col("mean_score") + F.col("std_score") * F.randn(seed)).alias("value"))
