"""Folders of indexes and scores: what lies where, and ids, masks and metadata kept beside them.

Folders are listed through Hadoop's file systems, so they can be in any store that Spark reads. A listing is
a name a folder and stays on the driver; contents are read by tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.records import attach_ids, read_score_shards, read_shard_ids


def _entries(spark: SparkSession, path: str) -> list[tuple[str, bool]] | None:
    """(name, whether it is a folder) of what lies in a folder, sorted; None if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    return sorted((x.getPath().getName(), x.isDirectory()) for x in system.listStatus(where))


def query_folders(spark: SparkSession, path: str, prefix: str = "queries_") -> list[str]:
    """Names of the query folders in ``path``; none is an error."""
    found = [name for name, folder in _entries(spark, path) or () if folder and name.startswith(prefix)]
    if not found:
        raise FileNotFoundError(f"no {prefix} folders in {path}")
    return found


def score_shards(spark: SparkSession, path: str) -> DataFrame:
    """(query, source, shard, path) of the folders query/source/shard in ``path``; other entries are
    passed over, and none at all is an error."""
    rows = []
    for query in query_folders(spark, path):
        for source, folder in _entries(spark, f"{path}/{query}") or ():
            held = _entries(spark, f"{path}/{query}/{source}") if folder else ()
            rows += [(query, source, shard, f"{path}/{query}/{source}/{shard}") for shard, inner in held or () if inner]
    if not rows:
        raise FileNotFoundError(f"no score shards in {path}")
    return spark.createDataFrame(rows, "query string, source string, shard string, path string")


def query_scores(spark: SparkSession, path: str, query: str, ids: str) -> DataFrame:
    """(doc_id, score) of one query: the .npy files in its source/shard folders, with the ids in the JSON
    lines ``ids``/<shard>.jsonl. A missing folder, or a shard of another length than its ids, is an error."""
    folders = [r["path"] for r in score_shards(spark, path).where(F.col("query") == query).collect()]
    if not folders:
        raise FileNotFoundError(f"no scores of {query} in {path}")
    parts = None
    for folder in folders:
        part = read_score_shards(spark, folder).withColumn("shard", F.lit(folder.rsplit("/", 1)[-1]))
        parts = part if parts is None else parts.unionByName(part)
    known = read_shard_ids(spark, ids)
    missing = parts.select("shard").distinct().join(known.select("shard").distinct(), "shard", "left_anti").collect()
    if missing:
        raise FileNotFoundError(f"no ids of {sorted(r[0] for r in missing)} in {ids}")
    return attach_ids(parts, known).select("doc_id", "score")


def read_arrow_column(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(file, row, value) of one column, as text, of the Arrow stream files of a saved data set; files
    without the column give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = 0
                for part in pa.ipc.open_stream(raw):
                    if field in part.schema.names:
                        values = part.column(part.schema.names.index(field)).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(values)), pa.array(range(row, row + len(values)), pa.int64()), values], ["file", "row", "value"])
                    row += part.num_rows

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, row bigint, value string")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value) of the lines that aren't blank; ``at`` grows in the order of the file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value").where("trim(value) != ''")


def id_field(spark: SparkSession, path: str, field: str) -> DataFrame | None:
    """(at, value) of an index's ids in order: from its saved data set ``data.hf``, else from the JSON
    lines that ``index_config.json`` names (data.dataset; beside it if relative). None where neither
    has the field in every row."""
    if _entries(spark, f"{path}/data.hf") is not None:
        found = read_arrow_column(spark, f"{path}/data.hf", field)
        if not found.isEmpty():
            return found.select(F.struct("file", "row").alias("at"), "value")
    if _entries(spark, f"{path}/index_config.json") is None:
        return None
    try:
        named = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/index_config.json").collect()))["data"]["dataset"]
    except (ValueError, KeyError, TypeError):
        return None
    if not isinstance(named, str) or not named.lower().endswith(".jsonl"):
        return None
    named = named if named.startswith("/") or "://" in named else f"{path}/{named}"
    if _entries(spark, named) is None:
        return None
    found = _lines(spark, named).select("at", F.get_json_object("value", f"$.{field}").alias("value"))
    return None if found.isEmpty() or not found.where("value is null").isEmpty() else found


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(at, is_correct) of JSON lines in order; a line that doesn't say it is false."""
    return _lines(spark, path).select("at", F.coalesce(F.get_json_object("value", "$.is_correct").cast("boolean"), F.lit(False)).alias("is_correct"))


def read_metadata(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """A row a key of Parquet or JSON lines; rows without a key go, and of several the last wins."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path)
    kept = rows.withColumn("_at", F.monotonically_increasing_id()).where(F.col(key).isNotNull())
    last = kept.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "_at").alias("_m"))
    return last.select(key, "_m.*")
