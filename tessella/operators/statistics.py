"""Paired statistics over small result tables (a row a condition, topic, seed and benchmark)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import numbers


def paired_cells(gamma: DataFrame, a: str, b: str) -> DataFrame:
    """Cells (topic, target, seed) that both conditions have: a's value on its own target, b's on the
    same benchmark, and their difference d. A cell is one row: the mean of a condition's rows for it."""
    cell = ["topic", "target", "seed"]
    left = gamma.where((F.col("condition") == a) & (F.col("target") == F.col("eval_benchmark"))).groupBy(*cell).agg(F.avg("gamma").alias("gamma_a"))
    right = gamma.where(F.col("condition") == b).groupBy("topic", F.col("eval_benchmark").alias("target"), "seed").agg(F.avg("gamma").alias("gamma_b"))
    return left.join(right, cell).withColumn("d", F.col("gamma_a") - F.col("gamma_b"))


def describe(cells: DataFrame) -> DataFrame:
    """Counts, signs, median and d_z of the differences of each target."""
    d = F.col("d")
    return cells.groupBy("target").agg(
        F.count("*").alias("n_cells"), F.count_distinct("seed").alias("n_seeds"), F.count_distinct("topic").alias("n_topics"),
        F.count_if(d < 0).alias("n_neg"), F.count_if(d > 0).alias("n_pos"), F.count_if(d == 0).alias("n_zero"),
        F.median("d").alias("median_diff"), F.try_divide(F.avg("d"), F.nullif(F.stddev_samp("d"), F.lit(0.0))).alias("cohens_dz"),
    )


def topic_means(cells: DataFrame) -> DataFrame:
    return cells.groupBy("target", "topic").agg(F.avg("d").alias("d"))


def bh_adjust(frame: DataFrame, p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds p_bh: p n / rank, made monotone from the largest down, at most 1. Null p-values stay null."""
    up = Window.partitionBy(*by).orderBy(p)
    known = frame.where(F.col(p).isNotNull())
    ranked = known.withColumns({"_r": F.row_number().over(up), "_n": F.count("*").over(Window.partitionBy(*by))})
    down = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    done = ranked.withColumn("p_bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down))).drop("_r", "_n")
    return done.unionByName(frame.where(F.col(p).isNull()).withColumn("p_bh", F.lit(None).cast("double")))


def wilcoxon(d: np.ndarray) -> tuple[float, float]:
    """(W+, one-sided p for greater): zeros dropped, mean ranks; exact for up to 50 values without
    ties or zeros, else the normal approximation with the ties' correction."""
    nonzero = d[d != 0]
    n = len(nonzero)
    if len(d) < 2 or n == 0:
        return math.nan, math.nan
    ranks = pd.Series(np.abs(nonzero)).rank().to_numpy()
    w = float(ranks[nonzero > 0].sum())
    _, ties = np.unique(np.abs(nonzero), return_counts=True)
    if n <= 50 and n == len(d) and ties.max() == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r].copy()
        return w, float(ways[int(w) :].sum() / ways.sum())
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - float((ties**3 - ties).sum()) / 48
    return w, 0.5 * math.erfc((w - mean) / math.sqrt(var) / math.sqrt(2)) if var > 0 else math.nan


def t_greater(t: float, df: int) -> float:
    """P(T > t) of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d, out = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
        out = d
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + step * d or 1e-300), 1 + step / c or 1e-300
                out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return out

    if x >= 1:
        tail = 1.0
    elif x < (a + 1) / (a + b + 2):
        tail = front * fraction(x, a, b) / a
    else:
        tail = 1 - front * fraction(1 - x, b, a) / b
    return tail / 2 if t > 0 else 1 - tail / 2


#: Values that the bootstrap draws at once.
STRIP = 1 << 20


def bootstrap_median(d: np.ndarray, rounds: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    d = d[~np.isnan(d)]
    if not len(d):
        return math.nan, math.nan
    rng, strip = np.random.default_rng(seed), max(1, STRIP // len(d))
    medians = np.concatenate([np.median(rng.choice(d, (min(strip, rounds - k), len(d))), axis=1) for k in range(0, rounds, strip)])
    return float(np.quantile(medians, alpha / 2)), float(np.quantile(medians, 1 - alpha / 2))


_TESTS = "target string, test string, n_cells bigint, median_diff double, ci95_low double, ci95_high double, statistic double, p_uncorrected double"


def _tests(rows: pd.DataFrame) -> pd.DataFrame:
    target, d = rows["target"].iloc[0], rows["d"].to_numpy(float)
    means = rows.groupby("topic")["d"].mean().to_numpy()
    out = [(target, "wilcoxon_pooled", len(d), float(np.median(d)), *bootstrap_median(d), *wilcoxon(d))]
    sd = float(np.std(means, ddof=1)) if len(means) > 1 else 0.0
    t = float(means.mean() / (sd / math.sqrt(len(means)))) if sd > 0 else math.nan
    out.append((target, "t_topic_means", len(means), float(np.median(means)), *bootstrap_median(means), t, t_greater(t, len(means) - 1) if sd > 0 else math.nan))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _TESTS.split(", ")])


def analyze(cells: DataFrame) -> DataFrame:
    """Wilcoxon over the cells and a t-test over topic means of each target, p-values adjusted as one
    family. A target's cells (topics x seeds) fit one task by design."""
    found = cells.select("target", "topic", "d").groupBy("target").applyInPandas(_tests, _TESTS)
    nan_free = found.withColumns({c: F.nullif(F.nanvl(c, F.lit(-1e308)), F.lit(-1e308)) for c in ("ci95_low", "ci95_high", "statistic", "p_uncorrected")})
    return bh_adjust(nan_free, "p_uncorrected")


def selectivity(gamma: DataFrame, keys: list[str], target: str = "target", benchmark: str = "eval_benchmark") -> DataFrame:
    """|value on the target| over the mean magnitude elsewhere, of each key."""
    on = F.col(benchmark) == F.col(target)
    sums = gamma.groupBy(*keys, target).agg(F.coalesce(F.max(F.when(on, F.abs("gamma"))), F.lit(0.0)).alias("on_target"), F.avg(F.when(~on, F.abs("gamma"))).alias("off_target"))
    return sums.withColumn("selectivity", numbers.selectivity(F.col("on_target"), F.col("off_target")))


def best_topic(grid: DataFrame, by: str = "benchmark") -> DataFrame:
    """The topic of the first largest z-score of each benchmark (ties by label)."""
    w = Window.partitionBy(by).orderBy(F.desc("zscore"), "topic", "format")
    return grid.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(by, "topic", "zscore")


def factorial(influence_topic: DataFrame, random_topic: DataFrame, influence_only: DataFrame, neither: DataFrame) -> DataFrame:
    """The 2 x 2 of selectivities by target, with the effects of influence and of topic (ratios)."""
    out = influence_topic.select("target", F.col("selectivity").alias("sel_a"))
    for name, part in (("sel_1", random_topic), ("sel_c", influence_only), ("sel_3", neither)):
        out = out.join(part.select("target", F.col("selectivity").alias(name)), "target", "left")
    return out.withColumns({"influence_effect": F.try_divide("sel_a", F.nullif("sel_1", F.lit(0.0))), "topic_effect": F.try_divide("sel_a", F.nullif("sel_c", F.lit(0.0)))})


def collateral(gamma: DataFrame, topic_of: DataFrame, primary: list[str], other: list[str]) -> DataFrame:
    """For each condition, and each target at its best topic (target, topic; a row a target): the effect on
    the target, the mean magnitude on the other primary benchmarks, and mean and largest magnitude on
    the held-out ones."""
    rows = gamma.join(F.broadcast(topic_of), ["target", "topic"])
    b, size = F.col("eval_benchmark"), F.abs("gamma")
    return rows.groupBy("target", "topic", "condition").agg(
        F.max(F.when(b == F.col("target"), F.col("gamma"))).alias("on_target"), F.avg(F.when(b.isin(primary) & (b != F.col("target")), size)).alias("primary_collateral"),
        F.avg(F.when(b.isin(other), size)).alias("other_collateral"), F.max(F.when(b.isin(other), size)).alias("other_largest"), F.count_distinct(F.when(b.isin(other), b)).alias("n_other"),
    )
