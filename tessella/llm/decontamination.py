"""Benchmark decontamination by greedy string tiling.

Texts and items are token sequences (runs of letters and digits, A-Z lower-cased, as 64-bit hashes).
Runs of `MIN_MATCH` tokens are seeds, found by a rolling (Karp-Rabin) hash. A seed that a text shares with
an item begins a match if the tokens before it differ; only those are joined, and how far each goes is
found by bisection on rolling hashes of whole runs. So a match is one row however long it is, and
repeated words don't multiply. An item whose matches in a text cover less than the threshold needs
no more work. For the others tiling runs: the longest match is marked in both texts (its tokens are
compared first), what it leaves of the other matches is cut to its free parts, again and again until
none of `MIN_MATCH` tokens is left. The share of the item's tokens that tiles cover decides, so a passage
is caught also when its parts come in another order, and a token counts once.

The items are a query set that is broadcast in blocks of `BLOCK_BYTES` at most; a larger benchmark
takes a pass over the texts for each block, from which only hits come back. Texts are never moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import text as T
from tessella.llm.common import materialize, trimmed, without

#: Tokens of a match; items of fewer say too little to be searched for.
MIN_MATCH = 5
#: Share of an item's tokens that tiles of a contaminated text cover.
COVERAGE = 0.6
#: Text of the items that are broadcast at once.
BLOCK_BYTES = 32 << 20
_BITS = 22
_NONE = np.uint64(0)


def _lengths(a: T.Rolling, i: np.ndarray, b: T.Rolling, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many values from i on in a equal those from j on in b, ``most`` at most."""
    low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
    while len(on := np.flatnonzero(low < high)):
        mid = (low[on] + high[on] + 1) // 2
        same = a.of(i[on], i[on] + mid) == b.of(j[on], j[on] + mid)
        low[on], high[on] = np.where(same, mid, low[on]), np.where(same, high[on], mid - 1)
    return low


def tile(i: np.ndarray, j: np.ndarray, size: np.ndarray, n: int, equal=None) -> int:
    """Tokens of an item that greedy tiling covers, from its longest matches: the ``size`` tokens from i on
    in the item are those from j on in the text. ``equal`` (i, j, size) says whether they truly are."""
    covered = 0
    while len(size):
        best = np.flatnonzero(size == size.max())
        k = best[np.lexsort((i[best], j[best]))[0]]
        a, b, long = int(i[k]), int(j[k]), int(size[k])
        if equal is not None and not equal(a, b, long):  # two runs of one hash
            i, j, size = (np.delete(x, k) for x in (i, j, size))
            continue
        covered += long
        # What is marked of each match, as two spans of its own tokens, and the three parts beside them.
        spans = [(np.clip(x - y, 0, size), np.clip(x + long - y, 0, size)) for x, y in ((a, i), (b, j))]
        first = spans[0][0] <= spans[1][0]
        (lo1, hi1), (lo2, hi2) = ([np.where(first, p[e], q[e]) for e in (0, 1)] for p, q in (spans, spans[::-1]))
        begin = np.concatenate([np.zeros(len(size), np.int64), hi1, np.maximum(hi1, hi2)])
        end = np.concatenate([lo1, lo2, size])
        i, j = (np.tile(x, 3) + begin for x in (i, j))
        keep = end - begin >= n
        i, j, size = i[keep], j[keep], (end - begin)[keep]
    return covered


class Items:
    """Seeds of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None], min_match: int = MIN_MATCH):
        self.n, held, at = min_match, [], 0
        self.ids, starts, sizes = [], [], []
        for x, (_, _, data, offsets) in ((x, c) for x, t in zip(ids, texts, strict=True) for c in T.chunks(pa.array([t or ""], pa.string()))):
            begin, end, _ = T.words(data, offsets, T.IS_ALNUM)
            if len(begin) >= min_match:
                held.append(T.span_hashes(data, begin, end))
                self.ids.append(x)
                starts.append(at)
                sizes.append(len(begin))
                at += len(begin)
        self.starts, self.sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
        self.h = np.concatenate(held) if held else np.zeros(0, np.uint64)
        self.rolling = T.Rolling(self.h)
        place = np.concatenate([np.arange(a, a + n - min_match + 1) for a, n in zip(starts, sizes, strict=True)]) if held else np.zeros(0, np.int64)
        self.of = np.searchsorted(self.starts, place, side="right") - 1
        seed = self.rolling.of(place, place + min_match)
        before = np.where(np.isin(place, self.starts), _NONE, self.h[np.maximum(place - 1, 0)]) if held else seed
        order = np.lexsort((before, seed))
        #: sorted by seed, then by the token before it
        self.seed, self.place, self.of = seed[order], place[order], self.of[order]
        self.both = T.mix(seed[order] + T.mix(before[order]))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(seed & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        # Where each (seed, token before) begins and ends, found by a hash of the two.
        cuts = np.flatnonzero(np.append(True, self.both[1:] != self.both[:-1])) if held else np.zeros(0, np.int64)
        by = np.argsort(self.both[cuts], kind="stable")
        self.pair, self.pair_from, self.pair_to = self.both[cuts][by], cuts[by], np.append(cuts[1:], len(seed))[by] if held else cuts

    def matches(self, column: pa.Array, coverage: float = COVERAGE) -> Iterator[tuple[int, int, float]]:
        """(row, item's number, share of its tokens) for each item that a text covers enough of."""
        n = self.n
        if not len(self.seed):
            return
        for lo, _, data, offsets in T.chunks(column):
            starts, ends, rows = T.words(data, offsets, T.IS_ALNUM)
            h = T.span_hashes(data, starts, ends)
            if len(h) < n:
                continue
            rolling, stop = T.Rolling(h), np.searchsorted(rows, rows, side="right")
            seed = rolling.of(np.arange(len(h) - n + 1), np.arange(n, len(h) + 1))
            k = np.flatnonzero(self.maybe[(seed & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            k = k[rows[k] == rows[k + n - 1]]
            a, b = np.searchsorted(self.seed, seed[k], side="left"), np.searchsorted(self.seed, seed[k], side="right")
            k, a, b = (x[b > a] for x in (k, a, b))
            # Items' seeds but those after the same token: their match began before.
            before = np.where((k > 0) & (rows[np.maximum(k - 1, 0)] == rows[k]), h[np.maximum(k - 1, 0)], _NONE)
            both = T.mix(seed[k] + T.mix(before))
            at = np.minimum(np.searchsorted(self.pair, both), len(self.pair) - 1)
            same = (self.pair[at] == both) & (before != _NONE)
            c, d = np.where(same, self.pair_from[at], a), np.where(same, self.pair_to[at], a)
            many = (c - a) + (b - d)
            where = np.repeat(np.arange(len(k)), many)
            within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            entry = np.where(within < (c - a)[where], a[where] + within, d[where] + within - (c - a)[where])
            i, j, what = self.place[entry], k[where], self.of[entry]
            size = _lengths(self.rolling, i, rolling, j, np.minimum(self.starts[what] + self.sizes[what] - i, stop[j] - j))
            row = rows[j]
            order = np.lexsort((i, what, row))
            i, j, size, row, what = (x[order] for x in (i, j, size, row, what))
            cuts = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(what) != 0))) if len(row) else np.zeros(0, np.int64)
            for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(row)).tolist(), strict=True) if len(row) else ():
                whole = int(self.sizes[what[x]])
                marks, first = np.zeros(whole + 1, np.int64), self.starts[what[x]]
                np.add.at(marks, i[x:y] - first, 1)
                np.add.at(marks, i[x:y] - first + size[x:y], -1)
                if (np.cumsum(marks)[:whole] > 0).sum() < coverage * whole:  # no tiling covers more
                    continue
                covered = tile(i[x:y], j[x:y], size[x:y], n, lambda p, q, z: np.array_equal(self.h[p : p + z], h[q : q + z]))
                if covered >= coverage * whole:
                    yield lo + int(row[x]), int(what[x]), covered / whole


def _flag_rows(shared, names: list[str], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            found = batch.column(names.index("items")).to_pylist()
            best = batch.column(names.index("coverage")).to_pylist()
            for row, item, share in items.matches(batch.column(names.index("text")), coverage):
                found[row] = [*found[row], items.ids[item]]
                best[row] = max(best[row], share)
            cols = [pa.array([sorted(x) for x in found], pa.list_(pa.int64())) if c == "items" else pa.array(best, pa.float64()) if c == "coverage" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _hit_rows(shared, coverage: float):
    """(_uid, item, share) of each hit in rows (_uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(shared.value.matches(batch.column(1), coverage))
            uid = batch.column(0).take(pa.array([x[0] for x in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays([uid, pa.array([shared.value.ids[x[1]] for x in hits], pa.int64()), pa.array([x[2] for x in hits], pa.float64())], ["_uid", "item", "share"])

    return run


def flag(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """``docs`` (text, further columns) with items (ids of the benchmark items that the text covers
    enough of, ascending) and coverage (the largest share; 0 without items).

    ``benchmark`` has item_id and text; null ids, and texts of fewer than ``min_match`` tokens, are
    passed over. Null and empty texts have no items. Rows that repeat are flagged alike; an item that
    repeats under one id is listed once a row of the benchmark. Empty tables give no rows, or no
    items. An extra column named items, coverage or _uid gives way.
    """
    spark = docs.sparkSession
    benchmark = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text")
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(1.5 * size / BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    docs = without(docs, "items", "coverage", "_uid")

    def block(k: int):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        return spark.sparkContext.broadcast(Items(part.column("item_id").to_pylist(), part.column("text").to_pylist(), min_match))

    if blocks == 1:
        out = docs.withColumns({"items": F.expr("cast(array() as array<bigint>)"), "coverage": F.lit(0.0)})
        return out.mapInArrow(trimmed(_flag_rows(block(0), out.columns, coverage)), out.schema)
    docs, hits = materialize(docs.withColumn("_uid", F.monotonically_increasing_id())), None
    for k in range(blocks):
        shared = block(k)
        found = materialize(docs.select("_uid", "text").mapInArrow(trimmed(_hit_rows(shared, coverage)), "_uid bigint, item bigint, share double"))
        hits = found if hits is None else hits.unionByName(found)
        shared.destroy()
    hits = hits.groupBy("_uid").agg(F.sort_array(F.collect_list("item")).alias("items"), F.max("share").alias("coverage"))
    out = docs.join(hits, "_uid", "left").drop("_uid")
    return out.withColumns({"items": F.coalesce("items", F.expr("cast(array() as array<bigint>)")), "coverage": F.coalesce("coverage", F.lit(0.0))})
