"""Readers of report grids (a row a bin), one file a benchmark."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import bins
from tessella.sources.records import union_all

# Columns of per-query grids, whose median stands for the mean score.
PER_QUERY = {"median_influence": "mean_score", "median_abs_influence": "abs_mean_score", "std_influence": "std_score"}
_NUMBERS = ("mean_score", "abs_mean_score", "std_score", "zscore")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_grid(spark: SparkSession, path: str, z_score: bool = True) -> DataFrame:
    """A CSV grid with normalised labels; per-query columns become the standard ones; with ``z_score``
    a column zscore, 0 where all bins are alike."""
    rows = spark.read.option("header", "true").csv(path)
    rows = rows.withColumnsRenamed({a: b for a, b in PER_QUERY.items() if a in rows.columns and b not in rows.columns})
    rows = rows.withColumnsRenamed({"topic_label": "topic", "format_label": "format"})
    rows = rows.withColumns({c: text.normalize_taxonomy_label(F.col(c)) for c in ("topic", "format")})
    rows = rows.withColumns({c: F.col(c).cast("double") for c in _NUMBERS if c in rows.columns}).withColumn("doc_count", F.col("doc_count").cast("bigint"))
    return bins.z_scores(rows, zero_sigma="zero") if z_score else rows


def read_grids(spark: SparkSession, folder: str, benchmarks: list[str], z_score: bool = True) -> DataFrame:
    """The grids of all benchmarks with a column benchmark: of each the per-query file (<name>_perquery.csv)
    or else <name>.csv. One that has neither is passed over with a warning."""
    parts = []
    for name in benchmarks:
        found = next((p for p in (f"{folder}/{name}_perquery.csv", f"{folder}/{name}.csv") if exists(spark, p)), None)
        if found is None:
            warnings.warn(f"no grid of {name}", stacklevel=2)
            continue
        rows = read_grid(spark, found, z_score)
        parts.append(rows.select(F.lit(name).alias("benchmark"), "topic", "format", "mean_score", "doc_count", *(["zscore"] if z_score else [])))
    if not parts:
        raise ValueError(f"no grids in {folder}")
    return union_all(parts)
