"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where neither the session nor the context names one, one is set: a folder in the warehouse,
    or, where driver and executor are one process (tests), a temporary folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        one = context.master.split("[")[0] == "local"
        found = tempfile.mkdtemp(prefix="tessella-") if one else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessella-shared"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete what was written to ``path`` when the application ends: results are read until then."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table there: computed once, for several readers, and whole if an executor goes."""
    path = f"{shared_dir(df.sparkSession)}/tessella-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
