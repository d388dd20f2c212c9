"""Language-model scoring by prediction by partial matching (PPM).

A byte-context trie up to `ORDER` bytes deep holds, for every context, how often each byte followed
it in the training texts (lower-cased A-Z, with `ORDER` zero bytes before a text and one after it as
its end). A byte costs, from its longest known context down: where the context has seen it, its share
among the counts not excluded so far; else the escape, estimated from the bytes that the context has
seen once (method X: (once + 1) / (counts + once + 1)), and the bytes of that context are excluded
below it. Below the empty context every byte left is equally likely. The trie holds every context of all
training texts, as a table: no task and no driver holds the whole of it.

A trained model is static, so a byte's cost is a function of the byte and the `ORDER` bytes before
it, an n-gram. Costs of the `HOT` most frequent n-grams are broadcast; the others of a text are joined
with the table of costs by a shuffle. An n-gram that
training has costs its share in its own context; the escapes and exclusions of one that it lacks are
worked out once from the contexts that it ends in. `adaptive` is the same model learning as it reads.

The unigram base needs the count of every word of every text. Words that make up a least share of
all tokens are few by definition and are broadcast; the others are joined by a shuffle, where none
of them can be hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import text as T
from tessella.llm.common import materialize, schema_with, trimmed, without

ORDER = 5
#: Least share of all training tokens that a word has whose count is broadcast.
COMMON = 1 / 65536
#: N-grams at most whose costs are broadcast, 16 bytes each: those that training has most often.
HOT = 2_000_000


# The trie as tables. A code is k << 48 | context << 8 | byte: how often the byte followed a context of
# k bytes (a big-endian number); code >> 8 names the context.


class Model:
    """``levels`` (code, n): all counts; ``contexts`` (context, total, once, inner, inner_once): their
    sum, how many are one, and both for the bytes of the context in the one a byte shorter;
    ``grams`` (key, n, cost): log10 of the probability of each byte after `ORDER` known ones;
    ``hot``: n-grams counted more often are `HOT` at most; ``seen``: distinct bytes."""

    def __init__(self, grams: DataFrame):
        low = [(k << 48, (1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)]
        each = F.explode(F.array(*[F.col("key").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(head)) for head, mask in low]))
        self.levels = materialize(grams.select(each.alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n")))
        depth = F.shiftright("code", 48).cast("int")
        mask = F.element_at(F.array(*[F.lit(m) for _, m in low]), depth)  # of one byte less; nothing is less than the root
        longer = self.levels.where(depth > 0).select(F.col("code").alias("of"), (F.col("code").bitwiseAND(mask) + (depth - 1).cast("bigint") * (1 << 48)).alias("code"))
        inner = longer.join(self.levels, "code").select(F.col("of").alias("code"), F.col("n").alias("i"))
        one = lambda c: F.sum(F.when(F.col(c) == 1, 1).otherwise(0))
        held = self.levels.join(inner, "code", "left").groupBy(F.shiftright("code", 8).alias("context"))
        self.contexts = materialize(held.agg(F.sum("n").alias("total"), one("n").alias("once"), F.sum("i").alias("inner"), one("i").alias("inner_once")))
        known = self.levels.where(depth == ORDER).withColumn("context", F.shiftright("code", 8)).join(self.contexts, "context")
        self.grams = materialize(known.select(F.col("code").bitwiseAND(F.lit(low[-1][1])).alias("key"), "n", F.log10(F.col("n") / (F.col("total") + F.col("once") + 1)).alias("cost")))
        sizes = self.grams.groupBy("n").count().toArrow().sort_by([("n", "descending")])  # distinct counts are few
        n, many = (sizes.column(c).to_numpy().astype(np.int64) for c in ("n", "count"))
        self.hot = int(np.append(n, 0)[np.searchsorted(np.cumsum(many), HOT, side="right")])
        self.seen = self.levels.where(depth == 0).count()

    def unknown(self, keys: DataFrame) -> DataFrame:
        """(key, cost) of n-grams (key, distinct) that training lacks: the escapes of the known contexts
        without the byte, each without the bytes of the context a byte longer, and its share there."""
        low = [F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).bitwiseOR(F.lit(k << 48)) for k in range(ORDER + 1)]
        steps = [F.struct(F.lit(k).alias("k"), low[k].alias("code"), F.shiftright(low[k], 8).alias("context"), (F.shiftright(low[k + 1], 8) if k < ORDER else F.lit(-1).cast("bigint")).alias("longer")) for k in range(ORDER + 1)]
        x = keys.select("key", F.explode(F.array(*steps)).alias("x")).select("key", "x.*")
        longer = self.contexts.select(F.col("context").alias("longer"), "inner", "inner_once")
        x = x.join(self.contexts.select("context", "total", "once"), "context", "left").join(longer, "longer", "left").join(self.levels, "code", "left")
        held, once = (F.col(a) - F.coalesce(b, F.lit(0)) for a, b in (("total", "inner"), ("once", "inner_once")))
        whole = held + once + 1
        escape = F.when(F.col("n").isNull() & (held > 0), F.log10((once + 1) / whole))
        share = F.max_by(F.when(F.col("n").isNotNull(), F.log10(F.col("n") / whole)), F.when(F.col("n").isNotNull(), F.col("k")))
        uniform = F.lit(-math.log10(max(1, 256 - self.seen)))
        return x.groupBy("key").agg((F.coalesce(F.sum(escape), F.lit(0.0)) + F.coalesce(share, uniform)).alias("cost"))


def adaptive(text: str, order: int = ORDER) -> float:
    """log10 of the probability of one text by a model that has seen nothing before it and learns
    each byte once it is scored; null is empty. Plain, for small texts and tests."""
    data = bytes(T.LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]) + b"\0"
    seen: dict[bytes, dict[int, int]] = {}
    past, total = b"\0" * order, 0.0
    for byte in data:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            held = {b: n for b, n in seen.get(past[order - k :], {}).items() if b not in excluded}
            if not held:
                continue
            once = sum(n == 1 for n in held.values())
            whole = sum(held.values()) + once + 1
            if byte in held:
                total += math.log10(held[byte] / whole)
                break
            total += math.log10((once + 1) / whole)
            excluded |= held.keys()
        else:
            total -= math.log10(256 - len(excluded))
        for k in range(order + 1):
            at = seen.setdefault(past[order - k :], {})
            at[byte] = at.get(byte, 0) + 1
        past = (past + bytes([byte]))[1:]
    return total


# Counting.


def _held(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte of each text and its end, with the `ORDER` bytes before it, as a number."""
    rows = len(offsets) - 1
    laid = np.zeros(len(data) + rows * (ORDER + 1), np.uint64)
    laid[np.repeat(np.arange(rows) * (ORDER + 1) + ORDER, np.diff(offsets)) + np.arange(len(data))] = T.LOWER[data]
    code = np.zeros(max(len(laid) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(8)) | laid[k : k + len(code)]
    real = np.ones(len(laid), bool)  # not where the byte is one of those before a text
    for k in range(ORDER):
        real[offsets[:-1] + np.arange(rows) * (ORDER + 1) + k] = False
    return code[real[ORDER:]]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): byte n-grams of ORDER + 1 (kind 0) and words (kind 1) of a task, and texts (2)."""
    grams, words, size, texts = [], [], 0, 0

    def flush():
        for kind, parts in ((0, grams), (1, words)):
            if parts:
                keys, counts = _held(parts)
                for lo in range(0, len(keys), 1 << 17):
                    k = keys[lo : lo + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(counts[lo : lo + len(k)].astype(np.int64))], ["kind", "key", "n"])
                parts.clear()

    for batch in batches:
        texts += batch.num_rows
        for _, _, data, offsets in T.chunks(batch.column(0), 1 << 21):
            starts, ends, _ = T.words(data, offsets)
            words.append(np.unique(T.span_hashes(data, starts, ends), return_counts=True))
            grams.append(np.unique(_grams(data, offsets), return_counts=True))
            size += len(words[-1][0]) + len(grams[-1][0])
            if size > 1 << 22:
                yield from flush()
                size = 0
    yield from flush()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "n"])


def fit(train: DataFrame) -> tuple[Model, DataFrame, dict[str, int]]:
    """The model of the texts in ``train``, the count of each of its words (key, n; a hash for the
    word), and how many tokens, distinct tokens and texts it has. Null texts are empty. Every row is
    learned from, with a doc_id or without. A byte 0 in a text counts as the end symbol does."""
    counts = train.select("text").mapInArrow(trimmed(_count_rows), "kind byte, key bigint, n bigint")
    counts = materialize(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counts.where("kind = 1").select("key", "n")
    texts = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return Model(counts.where("kind = 0").select("key", "n")), words, {"tokens": tokens + texts, "distinct": distinct + (texts > 0), "texts": texts}


# Scoring.


def _score_rows(shared, columns: int):
    """Each text's score by hot n-grams, its other n-grams, its tokens, the sum of its common words, and
    its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, costs, keys, logs, end = shared.value
        for batch in batches:
            for lo, hi, data, offsets in T.chunks(batch.column(columns)):
                rows = hi - lo
                starts, ends, where = T.words(data, offsets)
                h = T.span_hashes(data, starts, ends).view(np.int64)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                common = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                base = np.bincount(where[common], logs[at[common]], rows)[:rows] if len(h) else np.zeros(rows)
                known = np.bincount(where[common], minlength=rows)[:rows]
                tokens = np.bincount(where, minlength=rows)[:rows] + 1
                h, where = h[~common], where[~common]
                bounds = np.searchsorted(where, np.arange(rows + 1)).astype(np.int32)
                grams, of = _grams(data, offsets).view(np.int64), np.repeat(np.arange(rows), np.diff(offsets) + 1)
                order = np.argsort(grams)  # neighbours are looked up together
                at = np.empty(len(grams), np.int64)
                at[order] = np.minimum(np.searchsorted(hot, grams[order]), max(len(hot) - 1, 0))
                held = hot[at] == grams if len(hot) else np.zeros(len(grams), bool)
                total = np.bincount(of[held], costs[at[held]], rows)[:rows]
                grams, of = grams[~held], of[~held]
                rest = np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(lo, rows) for c in batch.columns[:columns]),
                        pa.array(total.astype(np.float64)),
                        pa.ListArray.from_arrays(rest, grams),
                        pa.array(tokens),
                        pa.array(base + end[0]),
                        pa.array(known + end[1]),
                        pa.ListArray.from_arrays(bounds, h),
                    ],
                    [*batch.schema.names[:columns], "_score", "_rest", "n_tokens", "_base", "_known", "_rare"],
                )

    return run


def score(docs: DataFrame, model: Model, words: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``docs`` (doc_id, text, further columns) without the text, with n_tokens, n_known (tokens that
    training has), train_tokens, base_score (log10 of the unigram probability, add-one) and score
    (log10 of the model's probability of the text).

    Null texts are empty: they have the end token alone. Rows that repeat a doc_id are scored each
    on its own. An empty table gives no rows; with nothing to learn from, every byte is as likely
    as any other. Further columns are kept, but give way to new ones
    of the same name (and to _uid, _score, _rest, _base, _known and _rare).
    """
    spark: SparkSession = docs.sparkSession
    n, v = sizes["tokens"], sizes["distinct"]
    below = math.log10(n + v + 1)
    often = words.where(F.col("n") >= max(1.0, COMMON * n)).toArrow().sort_by("key")  # 1 / COMMON words at most
    keys, logs = often.column("key").to_numpy().astype(np.int64), np.log10(often.column("n").to_numpy().astype(np.float64) + 1) - below
    end = (math.log10(sizes["texts"] + 1) - below, int(sizes["texts"] > 0))
    hot = model.grams.where(F.col("n") > model.hot).select("key", "cost").toArrow().sort_by("key")
    shared = spark.sparkContext.broadcast((*(hot.column(c).to_numpy() for c in ("key", "cost")), keys, logs, end))
    rest = without(docs, "text", "n_tokens", "n_known", "train_tokens", "base_score", "score", "_uid", "_score", "_rest", "_base", "_known", "_rare")
    kept = [f"`{c}`" for c in rest.columns]
    numbered = docs.select(*kept, F.monotonically_increasing_id().alias("_uid"), "text")
    rows = materialize(numbered.mapInArrow(trimmed(_score_rows(shared, len(kept) + 1)), schema_with(rest, "_uid bigint, _score double, _rest array<bigint>, n_tokens bigint, _base double, _known bigint, _rare array<bigint>")))
    # Words that aren't common: a row each, with how often the text has it.
    rare = rows.select("_uid", F.explode("_rare").alias("key")).join(words.where(F.col("n") < max(1.0, COMMON * n)), "key")
    rare = rare.groupBy("_uid").agg(F.sum(F.log10(F.col("n") + 1)).alias("logs"), F.count("*").alias("known_rare"))
    # N-grams that aren't hot likewise, among them those that training lacks.
    rest, cool = rows.select("_uid", F.explode("_rest").alias("key")), model.grams.where(F.col("n") <= model.hot).select("key", "cost")
    costs = cool.unionByName(materialize(model.unknown(rest.select("key").distinct().join(cool, "key", "left_anti"))))
    rest = rest.join(costs, "key").groupBy("_uid").agg(F.sum("cost").alias("costs"))
    out = rows.select(*kept, "_uid", "_score", "n_tokens", "_base", "_known", F.size("_rare").alias("_rare")).join(rare, "_uid", "left").join(rest, "_uid", "left")
    return out.select(
        *kept,
        "n_tokens",
        (F.col("_known") + F.coalesce("known_rare", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("_base") + F.coalesce("logs", F.lit(0.0)) - F.col("_rare") * F.lit(below)).alias("base_score"),
        (F.col("_score") + F.coalesce("costs", F.lit(0.0))).alias("score"),
    )
