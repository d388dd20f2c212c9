"""Reproducible samples. The order of a sample is that of md5(id:seed), so any engine draws the same.

Row numbers and running sums over a whole table come from ranges and their totals (`numbered`, `prefix`): no
task holds the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.shared import written


def draw_key(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}")))


def _ranked(frame: DataFrame, by: list[str], seed: int, id_: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(draw_key(F.col(id_), seed), id_)
    return frame.withColumn("_rank", F.row_number().over(w))


def per_group(frame: DataFrame, by: list[str], n: int, seed: int, id_: str = "doc_id") -> DataFrame:
    """n rows of each group; all of a smaller one."""
    return _ranked(frame, by, seed, id_).where(F.col("_rank") <= n).drop("_rank")


def stratified(manifest: DataFrame, n: int, token_floor: int, seed: int = 42) -> DataFrame:
    """n documents a bin, and as many more where the first n hold fewer tokens than the floor; all
    of a bin with fewer than n."""
    by = ["topic", "format"]
    rows = _ranked(manifest.where("topic is not null and format is not null"), by, seed).where(F.col("_rank") <= 2 * n)
    first = F.sum(F.when(F.col("_rank") <= n, F.col("token_count"))).over(Window.partitionBy(*by))
    rows = rows.withColumn("_first", first)
    return rows.where((F.col("_rank") <= n) | (F.col("_first") < token_floor)).drop("_rank", "_first")


def representative(manifest: DataFrame, taken: DataFrame, token_target: int, seed: int = 42) -> DataFrame:
    """From what isn't taken, each bin's share of the token target (truncated), in drawn order up to
    the document that would exceed it. Running sums are cut into blocks of rank, so that no bin is
    one task's work alone: see `prefix`. Tokens are counted once, in a table."""
    rest = manifest.join(taken.select("doc_id"), "doc_id", "left_anti").where("topic is not null and format is not null")
    rest = written(rest.withColumn("_key", draw_key(F.col("doc_id"), seed)))
    totals = rest.groupBy("topic", "format").agg(F.sum("token_count").alias("_bin"))
    all_tokens = totals.agg(F.sum("_bin").alias("_all"))
    goals = totals.join(F.broadcast(all_tokens)).select("topic", "format", F.floor(F.lit(token_target) * (F.col("_bin") / F.col("_all"))).alias("_goal"))
    rows = prefix(rest, ["topic", "format"], ["_key", "doc_id"], "token_count", "_sum")
    return rows.join(F.broadcast(goals), ["topic", "format"]).where("_sum <= _goal").drop("_key", "_sum", "_goal")


def prefix(frame: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` in each group. The rows of a group are dealt by the first characters
    of the order key (md5 text): sums within a part, plus the sums of the parts before it."""
    part = F.substring(order[0], 1, 2)
    rows = frame.withColumn("_part", part)
    sums = rows.groupBy(*by, "_part").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(before, [*by, "_part"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


#: Rows that a range of `numbered` holds, about.
RANGE_ROWS = 1_000_000


def numbered(frame: DataFrame, order: list[str], value: str | None = None) -> DataFrame:
    """``frame`` with ``_i``, the number of each row in order from 0, and, with a ``value``, ``_sum``, its
    running sum. Rows are dealt to ranges of the order, more of them the more rows there are; numbers
    and sums within a range, plus those of the ranges before it, which are a row a range. A range
    takes whole ties of ``order``, so give one that is unique, or nearly."""
    spark = frame.sparkSession
    ranges = max(frame.count() // RANGE_ROWS + 1, min(8, spark.sparkContext.defaultParallelism))
    rows = frame.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    rows = written(rows)
    sums = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.sum(value or F.lit(0)).alias("_s"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = sums.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = {"_i": F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1} | ({"_sum": F.sum(value).over(inside)} if value else {})
    out = rows.withColumns(made).join(F.broadcast(before), "_p").withColumn("_i", F.col("_i") + F.col("_n0"))
    return (out.withColumn("_sum", F.col("_sum") + F.col("_s0")) if value else out).drop("_p", "_n0", "_s0")


def budget(frame: DataFrame, order: list[str], value: str, limit: int, by: list[str] | None = None) -> DataFrame:
    """Rows in order until the budget is reached; the row that reaches it is in."""
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = frame.withColumn("_sum", F.sum(value).over(w))
    else:
        rows = numbered(frame, order, value).drop("_i")
    return rows.where(F.col("_sum") - F.col(value) < limit).drop("_sum")


def forget(records: DataFrame, topics: list[str], n: int, seed: int, topic: str = "topic") -> DataFrame:
    """n documents in all, as many of each topic; id and text stay together, blank texts go after."""
    from tessella.functions.text import is_blank

    held = per_group(records.where(F.col(topic).isin(topics)), [topic], n // len(topics), seed)
    return held.where(~is_blank(F.col("text")))


def retain(records: DataFrame, topics: list[str], per_bin: int, seed: int, forgotten: DataFrame | None = None, by: tuple[str, ...] = ("topic", "format")) -> DataFrame:
    """Documents of each bin from all other topics, without those forgotten."""
    others = records.where(~F.col(by[0]).isin(topics))
    if forgotten is not None:
        others = others.join(forgotten.select("doc_id"), "doc_id", "left_anti")
    return per_group(others, list(by), per_bin, seed)


def resampled(records: DataFrame, topics: list[str], per_bin: int, seed: int, step: int) -> DataFrame:
    """The retained documents of a step: drawn anew with seed + step."""
    return retain(records, topics, per_bin, seed + step)


def null_split(records: DataFrame, n_forget: int, n_retain: int, seed: int) -> DataFrame:
    """Two disjoint slices of one shuffle, marked in ``split``."""
    drawn = records.withColumn("_key", draw_key(F.col("doc_id"), seed)).orderBy("_key", "doc_id").limit(n_forget + n_retain)
    w = Window.orderBy("_key", "doc_id")  # of the limited rows alone
    rank = F.row_number().over(w)
    return drawn.withColumn("split", F.when(rank <= n_forget, "forget").otherwise("retain")).drop("_key")


def train_rows(forgotten: DataFrame, retained: DataFrame) -> DataFrame:
    return forgotten.withColumn("split", F.lit("forget")).unionByName(retained.withColumn("split", F.lit("retain")))


def paired(forgotten: DataFrame, retained: DataFrame, order: str = "doc_id") -> DataFrame:
    """Row i of the one with row i mod n of the other."""
    b = numbered(retained.select(F.col(order), F.col("doc_id").alias("retain_id")), [order]).select("retain_id", F.col("_i").alias("j"))
    n = b.count()
    if not n:
        raise ValueError("nothing to pair with")
    a = numbered(forgotten.select(F.col(order), F.col("doc_id").alias("forget_id")), [order]).select("forget_id", F.col("_i").alias("i"), (F.col("_i") % n).alias("j"))
    return a.join(b, "j").select("i", "forget_id", "retain_id")


def round_robin(frame: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Row i goes to shard i mod ``shards``, in order."""
    return numbered(frame, order).withColumn("shard", (F.col("_i") % shards).cast("int")).drop("_i")


def greedy_stratified(rows: DataFrame, order: list[str], strata: list[str], n: int, token_limit: int | None = None) -> DataFrame:
    """The sequential sampler: in order, a row is in if its stratum has fewer than ceil(n / strata
    seen so far); stops at the token limit or at n. It needs all rows in one task by definition;
    `per_group` with n / strata is the variant that scales."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        taken = tokens = 0
        for batch in batches:
            keep = []
            for k, row in enumerate(batch.select([*strata, "token_count"]).to_pylist()):
                if (token_limit is not None and tokens >= token_limit) or taken >= n:
                    break
                key = tuple(row[s] for s in strata)
                seen.setdefault(key, 0)
                if seen[key] < -(-n // len(seen)):
                    seen[key] += 1
                    taken += 1
                    tokens += row["token_count"] or 0
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, schema)


def manifest_slice(frame: DataFrame, order: list[str], conditions: list[str] | None = None, labels: list[str] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of the wanted conditions and labels, in order, from an offset on. A wanted label that no
    row has is an error."""
    if conditions:
        frame = frame.where(F.col("condition").isin(conditions))
    if labels:
        found = {r[0] for r in frame.where(F.col("label").isin(labels)).select("label").distinct().collect()}
        if missing := sorted(set(labels) - found):
            raise ValueError(f"no rows of {missing}")
        frame = frame.where(F.col("label").isin(labels))
    out = frame.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def synthetic_manifest(spark, n: int, seed: int = 42) -> DataFrame:
    """Documents with random bins (uneven) and lognormal token counts, from a seed."""
    from tessella import taxonomy

    topics, formats = (F.array(*[F.lit(x) for x in xs]) for xs in (taxonomy.TOPICS, taxonomy.FORMATS))
    pick = lambda s: (F.pow(F.rand(s), 2) * 24).cast("int") + 1
    rows = spark.range(n).select(F.concat(F.lit("doc_"), "id").alias("doc_id"), F.element_at(topics, pick(seed)).alias("topic"), F.element_at(formats, pick(seed + 1)).alias("format"), F.greatest(F.lit(1), F.exp(6 + F.randn(seed + 2))).cast("bigint").alias("token_count"))
    return rows


def worker_budgets(frame: DataFrame, worker: str, order: list[str], value: str, limit: int) -> DataFrame:
    """The budgeted sample of each worker's shards."""
    return budget(frame, order, value, limit, [worker])
