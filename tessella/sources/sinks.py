"""Writers. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_json_lines(frame: DataFrame, path: str, compression: str | None = "gzip", lines_per_file: int = 10_000_000, overwrite: bool = False) -> None:
    """JSON lines in files of so many lines at most. An existing folder is an error by default."""
    out = frame.write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", lines_per_file)
    (out.option("compression", compression) if compression else out).json(path)


def write_parquet(frame: DataFrame, path: str, by: list[str] | None = None, overwrite: bool = False) -> None:
    out = frame.write.mode("overwrite" if overwrite else "errorifexists")
    (out.partitionBy(*by) if by else out).parquet(path)


def write_small_csv(frame: DataFrame, path: str, sep: str = ",") -> None:
    """One CSV file, of a frame of report size."""
    frame.coalesce(1).write.mode("errorifexists").option("header", "true").option("sep", sep).csv(path)


def write_shards(frame: DataFrame, path: str, shard: str = "shard") -> None:
    """A folder a shard; shards without rows have none."""
    frame.write.mode("errorifexists").partitionBy(shard).json(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write there has ended (its _SUCCESS file)."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def write_unless_complete(frame: DataFrame, path: str) -> bool:
    """Writes Parquet unless it is there already; whether it wrote."""
    if is_complete(frame.sparkSession, path):
        return False
    write_parquet(frame, path, overwrite=True)
    return True


def write_with_counts(frame: DataFrame, path: str, **counts) -> dict[str, int]:
    """Writes JSON lines and returns aggregates observed on the way, without another pass."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]).write.mode("errorifexists").json(path)
    return seen.get
