"""Readers: JSON lines, Parquet, CSV and numpy shards, all through Spark's own file access."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id string, text string, metadata map<string,string>"


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str = RECORD, tolerant: bool = False) -> DataFrame:
    """JSON lines, plain, .gz or .zst. Lines end at LF alone: other line marks inside strings are data.
    ``tolerant`` passes over lines and files that can't be read."""
    reader = spark.read.option("lineSep", "\n")
    if not tolerant:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    lines = reader.option("ignoreCorruptFiles", "true").text(path).where("trim(value) != ''")
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where("r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: parquet, csv, tsv, or JSON lines."""
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".csv", ".tsv")):
        reader = spark.read.option("header", "true").option("sep", "\t" if name.endswith(".tsv") else ",")
        return (reader.schema(schema) if schema else reader).csv(path)
    return read_json_lines(spark, path, schema or RECORD)


def manifest_path(spark: SparkSession, path: str) -> str:
    """A Parquet file itself; of a folder, data/ where it has one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/data")
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return f"{path.rstrip('/')}/data" if there and not path.endswith(".parquet") else path


def read_manifest(spark: SparkSession, path: str, columns: list[str] | None = None, recursive: bool = False) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.parquet")
    rows = reader.parquet(manifest_path(spark, path))
    return rows.select(*columns) if columns else rows


def read_required_csv(spark: SparkSession, path: str, required: list[str], sep: str = ",") -> DataFrame:
    rows = spark.read.option("header", "true").option("sep", sep).csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return rows


def read_score_shards(spark: SparkSession, path: str) -> DataFrame:
    """.npy matrices (documents x queries) as (shard, row, query, score), shard from the file name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scores = np.load(io.BytesIO(raw), allow_pickle=False)
                scores = scores[:, None] if scores.ndim == 1 else scores
                n, q = scores.shape
                shard = name.rsplit("/", 1)[-1].removesuffix(".npy")
                for lo in range(0, n, 4096):
                    part = scores[lo : lo + 4096].astype(np.float64)
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * (m * q)), pa.array(np.repeat(np.arange(lo, lo + m), q)), pa.array(np.tile(np.arange(q), m)), pa.array(part.ravel())], ["shard", "row", "query", "score"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(run, "shard string, row bigint, query bigint, score double")


def read_structured_scores(spark: SparkSession, path: str, dtype: list[tuple[str, str]], field: str = "score_0") -> DataFrame:
    """scores.bin files of records of a numpy dtype: (path, row, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(raw, np.dtype(dtype))[field].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(np.arange(len(values))), pa.array(values)], ["path", "row", "score"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row bigint, score double")


def read_shard_ids(spark: SparkSession, path: str) -> DataFrame:
    """ids of JSON-line shards by position: (shard, row, doc_id). Blank lines don't count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = [str(json.loads(line)["id"]) for line in raw.decode().split("\n") if line.strip()]
                shard = name.rsplit("/", 1)[-1].split(".")[0]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.string())], ["shard", "row", "doc_id"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).select("path", "content")
    return files.mapInArrow(run, "shard string, row bigint, doc_id string")


def attach_ids(scores: DataFrame, ids: DataFrame, strict: bool = True) -> DataFrame:
    """Scores with their document ids by position. Shards whose lengths differ fail, or go if not strict;
    shards without ids go."""
    sizes = scores.groupBy("shard").agg((F.max("row") + 1).alias("_n")).join(ids.groupBy("shard").agg(F.count("*").alias("_m")), "shard")
    same = F.col("_n") == F.col("_m")
    ok = sizes.withColumn("_ok", F.when(same, True).otherwise(F.raise_error(F.lit("shard and ids differ in length"))) if strict else same).where("_ok").select("shard")
    return scores.join(F.broadcast(ok), "shard").join(ids, ["shard", "row"])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors (id, vec) of Parquet, JSON lines or .npy files (id is the file name, a row a vector)."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").endswith((".json", ".jsonl", ".jsonl.zst")):
        return read_json_lines(spark, path, "id string, vec array<float>")
    rows = read_score_shards(spark, path)
    each = rows.groupBy("shard", "row").agg(F.array_sort(F.collect_list(F.struct("query", "score"))).alias("v"))
    return each.select(F.concat_ws(":", "shard", "row").alias("id"), F.col("v.score").cast("array<float>").alias("vec"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def consolidate(sources: dict[str, DataFrame]) -> DataFrame:
    """id, text and the source's name of several sources; blank texts of lines go."""
    return union_all([f.select("id", "text").withColumn("source", F.lit(name)) for name, f in sorted(sources.items())])
