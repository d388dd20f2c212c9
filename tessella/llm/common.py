"""Helpers shared by the training-data operators: shared tables, skew-safe joins, components."""

from __future__ import annotations

import contextlib
import ctypes
import math
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.shared import delete_at_end, shared_dir
from tessella.ship import ship

#: Rows of a key from which `salted_join` splits it, and such keys at most.
SPLIT_ROWS, HOT_KEYS = 64, 4096
#: Rows of an Arrow batch at most.
TEXTS_PER_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


_open = threading.local()


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, and keep Arrow batches of whole texts small: a batch is held
    by the JVM and by a Python worker at once. A smaller setting of the session stays."""
    ship(spark)
    if int(spark.conf.get(_BATCH)) > TEXTS_PER_BATCH:
        spark.conf.set(_BATCH, TEXTS_PER_BATCH)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without extra columns that would clash with an operator's own (in any case)."""
    return df.select([f"`{c}`" for c in df.columns if c.lower() not in names])


def schema_with(df: DataFrame, added: str) -> StructType:
    """The columns of ``df``, then those that ``added`` declares."""
    return StructType(df.schema.fields + StructType.fromDDL(added).fields)


def trimmed(run):
    """A mapInArrow function that gives freed memory back to the system when its task ends: a worker
    lives on through later stages."""

    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return inner


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there,
    the copy outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    if made := getattr(_open, "made", None):
        made[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


@contextlib.contextmanager
def scratch():
    """Collects the paths of tables that are made inside, for `release`."""
    made = _open.__dict__.setdefault("made", [])
    made.append([])
    try:
        yield made[-1]
    finally:
        made.pop()


def release(spark: SparkSession, made: list[str], *keep: DataFrame) -> None:
    """Delete tables that no result reads any more: all that were made but those to keep."""
    kept = {df._table for df in keep}
    for path in [p for p in made if p not in kept]:
        made.remove(path)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``unique`` (one row a key), hot keys split. ``how``: inner, left or left_semi.

    Rows are counted by key first (``counts``, of columns keys and c, says it where that is known). Of
    the keys with more than `SPLIT_ROWS` rows the `HOT_KEYS` most frequent, a table that is always small,
    are broadcast to both sides: their rows are dealt to more tasks the more there are, each with a
    copy of the key's row. Any other key has less than one in `HOT_KEYS` of the rows. Rows with a
    null in the key, which match nothing, are dealt to all tasks.
    """
    most = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("c"))
    many = F.least(F.ceil(F.col("c") / SPLIT_ROWS), F.lit(most)).cast("int").alias("_many")
    hot = F.broadcast(counts.where(F.col("c") > SPLIT_ROWS).orderBy(F.desc("c"), *keys).limit(HOT_KEYS).select(*keys, many))
    spread_by = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])
    nowhere = F.expr(" or ".join(f"`{k}` is null" for k in keys))
    salt = F.when(nowhere, F.pmod(spread_by, F.lit(most))).when(F.col("_many").isNotNull(), F.pmod(spread_by, F.col("_many"))).otherwise(0)
    salted = rows.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_many")
    spread = unique.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_many", F.lit(1)) - 1))).drop("_many")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def hot_join(rows: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """The same for many narrow ``rows`` without nulls and a small row a key in ``unique`` (both are read
    twice, so give tables): rows of the `HOT_KEYS` most frequent keys meet theirs by a broadcast and are
    not shuffled at all. ``how``: inner or left_semi."""
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("c"))
    top = F.broadcast(counts.where(F.col("c") > SPLIT_ROWS).orderBy(F.desc("c"), *keys).limit(HOT_KEYS).select(*keys))
    near = rows.join(F.broadcast(unique.join(top, keys, "left_semi")), keys, how)
    return near.unionByName(rows.join(top, keys, "left_anti").join(unique, keys, how))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    Returns (node, root): every node with an edge, and the smallest node it can reach. Each round
    ends in a table in the shared folder; only two numbers a round reach the driver.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("s"), F.least(a, b).alias("t")).distinct()
    spark = edges.sparkSession
    with scratch() as made:
        e = _settled(spark, materialize(e), made)
    if outer := getattr(_open, "made", None):
        outer[-1].append(e._table)
    return e.select(F.col("s").alias("node"), F.col("t").alias("root")).unionByName(e.select(F.col("t").alias("node"), F.col("t").alias("root")).distinct())


def _with_lowest(edges: DataFrame, salts: int) -> DataFrame:
    """Edges (s, t) with m, the lowest t of each s. A hub's edges are dealt to ``salts`` tasks; what meets in
    one task is their minima. A node has no more of them than edges, so nodes of few edges cost no copies."""
    dealt = edges.withColumn("_salt", F.pmod(F.xxhash64("t"), F.lit(salts)))
    low = dealt.groupBy("s", "_salt").agg(F.min("t").alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("s")))
    return dealt.join(low, ["s", "_salt"]).drop("_salt")


def _settled(spark: SparkSession, e: DataFrame, made: list[str]) -> DataFrame:
    """Rounds of large and small stars until nothing changes; only the last round's table stays. With the
    square root of all edges as salts, a hub has about as many edges in a task, and no more minima."""
    before, edges = None, e.count()
    while True:
        salts = math.isqrt(edges) + 1
        both = e.unionByName(e.select(F.col("t").alias("s"), F.col("s").alias("t")))
        large = _with_lowest(both, salts).where("t > s").select(F.col("t").alias("s"), F.least("s", "m").alias("t")).distinct()
        small = _with_lowest(large, salts).select(F.explode(F.array(F.struct(F.col("s"), F.col("m").alias("t")), F.struct(F.col("t").alias("s"), F.col("m").alias("t")))).alias("e"))
        e = materialize(small.select("e.s", "e.t").where("s != t").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("s", "t").cast("decimal(38,0)"))).first()
        release(spark, made, e)
        if now == before:
            return e
        before, edges = now, now[0]
