"""Packing by cutting-stock column generation.

A text's ids are cut into full sequences and a rest shorter than one; a text that fits one sequence is
all rest. The rests' length histogram (``capacity`` numbers, however large the corpus) is a
cutting-stock problem: a linear program over patterns (multisets of lengths that fit one sequence).
It starts from first-fit-decreasing patterns, one for each length that they use up, and goes on with
columns that an unbounded knapsack by dynamic programming prices, until Farley's bound shows that the
program can't fall by more than a share of `GAP`, or after `ROUNDS`. Pattern counts are rounded down; what
that leaves is packed by best fit, at most a few pieces a length. Within its length a text's rank
decides which copy of which pattern it fills, so placing needs no search: ranks come from a range
partitioning by (size, doc_id), and small arrays turn them into sequence and offset.

What room patterns leave is filled too: as many sequences as that room is worth (those that are least
full) are taken back, and their rests lie end to end in the room, cut where it ends, then in further
sequences, the last of which is cut into powers of two. Only those rests are cut.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.llm.common import materialize, trimmed

#: Rounds of pricing at most, and the share of the optimum within which pricing stops.
ROUNDS, GAP = 600, 1e-4


def price(values: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern (count of each length from 0) of the largest value within ``capacity``."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    flipped = values[::-1].copy()  # values of lengths capacity .. 0
    for c in range(1, capacity + 1):
        gain = flipped[capacity - c : capacity] + best[:c]  # lengths c .. 1 onto 0 .. c - 1
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], last[c] = gain[k], c - k
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if last[c]:
            pattern[last[c]] += 1
            c -= last[c]
        else:
            c -= 1
    return pattern


def _first_fit(need: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each): a basis of the program. Each pattern takes the longest
    lengths that are left and fit, as often as it takes to use one of them up, whose column it is."""
    m = len(lengths)
    left, alive, basis, x = need.copy(), np.ones(m, bool), np.zeros((m, m)), np.zeros(m)
    for _ in range(m):
        room, column, on = capacity, np.zeros(m), np.flatnonzero(alive)[::-1]
        for k in on:
            n = min(room // lengths[k], max(1, math.ceil(left[k])))
            column[k] = n
            room -= n * lengths[k]
            if room < lengths[on[-1]]:
                break
        used = np.flatnonzero(column)
        times = left[used] / column[used]
        k, step = used[times.argmin()], times.min()
        left = np.maximum(left - step * column, 0)
        left[k], alive[k], x[k] = 0, False, step
        basis[:, k] = column
    return basis, x


def _best_fit(pieces: list[int], capacity: int) -> list[list[int]]:
    """The pieces, longest first, each in the fullest sequence that has room for it."""
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, bool)
    for size in sorted(pieces, reverse=True):
        ahead = open_rooms[size:]
        k = int(ahead.argmax())
        if ahead[k]:
            held = rooms[size + k].pop()
            open_rooms[size + k] = bool(rooms[size + k])
        else:
            held, k = [], capacity - size
        held.append(size)
        rooms[k].append(held)
        open_rooms[k] = True
    return [x for room in rooms for x in room]


def cutting_stock(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often each): patterns[p, L] pieces of length L, all ``counts[L]`` of each length
    from 1 to ``capacity`` together. Revised simplex, then rounding."""
    lengths = np.flatnonzero(counts[: capacity + 1])
    lengths = lengths[lengths > 0]
    m = len(lengths)
    if not m:
        return np.zeros((0, capacity + 1), np.int64), np.zeros(0, np.int64)
    need = counts[lengths].astype(float)
    basis, x = _first_fit(need, lengths, capacity)
    inverse, values, low = np.linalg.inv(basis), np.zeros(capacity + 1), need @ lengths / capacity
    for _ in range(rounds):
        duals = np.maximum(inverse.sum(axis=0), 0)
        values[lengths] = duals
        column = price(values, capacity)
        worth = values @ column
        low = max(low, duals @ need / worth)
        if worth <= 1 + 1e-7 or x.sum() - low <= gap * low:
            break
        column = column[lengths].astype(float)
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        basis[:, r] = column
        step = ratio[r]
        x -= step * d
        x[r] = step
        np.maximum(x, 0, out=x)
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
    basis, left = basis.astype(np.int64), counts[lengths].astype(np.int64)
    times = np.zeros(m, np.int64)
    for k in np.argsort(-x).tolist():  # rounded down, and never more pieces than there are
        on = basis[:, k] > 0
        times[k] = min(int(x[k] + 1e-9), int((left[on] // basis[on, k]).min()))
        left -= times[k] * basis[:, k]
    used = np.zeros((m, capacity + 1), np.int64)
    used[:, lengths] = basis.T
    rest = Counter(tuple(x) for x in _best_fit(np.repeat(lengths, left).tolist(), capacity))
    extra = np.zeros((len(rest), capacity + 1), np.int64)
    for k, sizes in enumerate(rest):
        np.add.at(extra[k], list(sizes), 1)
    used, times = np.concatenate([used, extra]), np.append(times, np.fromiter(rest.values(), np.int64, len(rest)))
    return used[times > 0], times[times > 0]


class Plan:
    """Where the rest of a text goes, by its size and its rank among rests of that size."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        counts = np.append(counts[:capacity], 0).astype(np.int64)
        counts[0] = 0
        sizes = np.arange(capacity + 1)
        patterns, times = cutting_stock(counts, capacity)
        room = capacity - patterns @ sizes
        # Sequences that are taken back: each frees its ids, and its room needs no more filling.
        back = -(-int(room @ times) // capacity)
        order = np.argsort(-room, kind="stable")
        gone = np.minimum(times[order], np.maximum(0, back - (np.cumsum(times[order]) - times[order])))
        times[order] -= gone
        self.sequences = int(times.sum())
        first = np.cumsum(times) - times
        self.taken = patterns.T @ times
        self.slots: dict[int, tuple[np.ndarray, ...]] = {}
        for size in np.flatnonzero(self.taken).tolist():
            on = np.flatnonzero((patterns[:, size] > 0) & (times > 0))
            each = patterns[on, size]
            self.slots[size] = np.cumsum(each * times[on]), each, first[on], patterns[on, :size] @ sizes[:size]
        left = (counts - self.taken) * sizes
        self.from_ = np.cumsum(left) - left
        # What lies end to end goes to runs of equal rooms: (where they begin, length, first sequence, offset).
        runs, at, total = [], 0, int(left.sum())
        for p in np.flatnonzero((room > 0) & (times > 0)).tolist():
            runs.append((at, int(room[p]), int(first[p]), capacity - int(room[p])))
            at += int(room[p] * times[p])
        whole = max(0, total - at) // capacity
        if whole:
            runs.append((at, capacity, self.sequences, 0))
        at, seq, tail = at + whole * capacity, self.sequences + whole, max(0, total - at) % capacity
        for bit in reversed(range(capacity.bit_length())):
            if tail >> bit & 1:
                runs.append((at, 1 << bit, seq, 0))
                at, seq = at + (1 << bit), seq + 1
        self.runs = np.array(runs or [(0, capacity, 0, 0)], np.int64)
        self.full_from = seq

    def patterned(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of rests that patterns take."""
        ends, each, first, offset = self.slots[size]
        p = np.searchsorted(ends, ranks, side="right")
        k = ranks - np.append(0, ends)[p]
        return first[p] + k // each[p], offset[p] + k % each[p] * size

    def laid(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset and room of positions in what lies end to end."""
        begin, length, first, offset = self.runs[np.searchsorted(self.runs[:, 0], at, side="right") - 1].T
        k, within = (at - begin) // length, (at - begin) % length
        return first + k, offset + within, length - within


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut_rows(path: str, end_id: int, capacity: int):
    """A document's full sequences (checksums), and its rest (ids and checksum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid = tokens.encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, crcs, crc, rests = [], [], [], []
                for ids in encoder.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    full = len(ids) // capacity
                    rest = ids[full * capacity :]
                    n.append(len(ids))
                    crcs.append([_crc(ids[k * capacity : (k + 1) * capacity]) for k in range(full)])
                    crc.append(_crc(rest))
                    rests.append((rest.astype("<u2") if rest.max(initial=0) < 1 << 16 else rest).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(uid, uid + len(n))), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(crc, pa.int64()), pa.array(rests, pa.binary())],
                    ["doc_id", "uid", "n", "crcs", "crc", "rest"],
                )
                uid += len(n)

    return run


def _rank_rows(capacity: int):
    """Rank of each rest within its size and task, and full sequences before it in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, size, rank, before = TaskContext.get().partitionId(), -1, 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            sizes, full, ranks = n % capacity, n // capacity, np.zeros(len(n), np.int64)
            starts = np.append(0, np.flatnonzero(np.diff(sizes)) + 1) if len(n) else np.zeros(0, np.int64)
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(n)).tolist()[: len(starts)], strict=True):
                if sizes[a] != size:
                    size, rank = sizes[a], 0
                ranks[a:b] = rank + np.arange(b - a)
                rank += b - a
            fulls = before + np.cumsum(full) - full
            before += int(full.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), task, np.int64)), pa.array(sizes), pa.array(ranks), pa.array(fulls)], [*batch.schema.names, "task", "size", "rank", "before"])

    return run


_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def _place_rows(plan: Plan, rank_at: dict, full_at: dict):
    """Every piece; one that crosses the end of a sequence comes whole, without checksum, its
    position in what lies end to end as its sequence, and with its document's uid."""
    capacity = plan.capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(on, start, length, crc, seq, offset, uid=None):
            made = [start, length, crc, n[on], seq, offset]
            made = [pa.array(np.broadcast_to(x, len(on)), pa.int64()) if x is not None else pa.nulls(len(on), pa.int64()) for x in (*made, uid)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(on)), *made], [*_NAMES, "uid"])

        for batch in batches:
            ids = batch.column("doc_id")
            uid, n, crc, task, size, rank, before = (batch.column(k).to_numpy() for k in ("uid", "n", "crc", "task", "size", "rank", "before"))
            full = n // capacity
            each = np.repeat(np.arange(len(n)), full)
            if len(each):
                k = np.arange(len(each)) - np.repeat(np.cumsum(full) - full, full)
                base = np.array([full_at[t] for t in task.tolist()], np.int64) + plan.full_from + before
                yield rows(each, k * capacity, capacity, batch.column("crcs").flatten().to_numpy(), base[each] + k, 0)
            rank = rank + np.array([rank_at[x] for x in zip(task.tolist(), size.tolist(), strict=True)], np.int64)
            inside, start = rank < plan.taken[size], full * capacity
            for c in np.unique(size[inside]).tolist():
                on = np.flatnonzero(inside & (size == c))
                yield rows(on, start[on], c, crc[on], *plan.patterned(c, rank[on]))
            on = np.flatnonzero((size > 0) & ~inside)
            at = plan.from_[size[on]] + (rank[on] - plan.taken[size[on]]) * size[on]
            seq, offset, room = plan.laid(at)
            fits = size[on] <= room
            a, b = on[fits], on[~fits]
            yield rows(a, start[a], size[a], crc[a], seq[fits], offset[fits])
            yield rows(b, start[b], size[b], None, at[~fits], 0, uid[b])

    return run


def _split_rows(plan: Plan):
    """Pieces that cross the end of a sequence, cut there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, start, length, n, at, rest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "rest")), strict=True):
                size = n % plan.capacity
                ids, done = np.frombuffer(rest, "<u2" if len(rest) == 2 * size else "<u4")[start - (n - size) :], 0
                while done < length:
                    seq, offset, room = (int(x) for x in plan.laid(np.int64(at + done)))
                    k = min(length - done, room)
                    out.append((doc_id, start + done, k, _crc(ids[done : done + k]), n, seq, offset))
                    done += k
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * len(_NAMES))], _NAMES)

    return run


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row a piece (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for the
    whole texts of ``docs`` (doc_id, text; further columns are ignored).

    A null or empty text is its end id alone. Rows that repeat a doc_id, or have none, are packed
    each on its own. An empty table gives no rows. No sequence has padding, as the last few have powers
    of two for lengths.
    """
    path = tokenizer or tokens.default_path()
    rest = "doc_id bigint, uid bigint, n bigint, crcs array<bigint>, crc bigint"
    cut = materialize(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(trimmed(_cut_rows(path, end_id, capacity)), rest + ", rest binary"))
    size = F.col("n") % capacity
    counts = np.zeros(capacity, np.int64)
    for k, n in cut.groupBy(size.alias("size")).count().collect():  # `capacity` rows at most
        counts[k] = n
    plan = Plan(counts, capacity)

    spread = cut.drop("rest").repartitionByRange(size, "doc_id", "uid").sortWithinPartitions(size, "doc_id", "uid")
    ranked = materialize(spread.mapInArrow(trimmed(_rank_rows(capacity)), rest + ", task bigint, size bigint, rank bigint, before bigint"))
    # Tasks are ranges of (size, doc_id): these rows are at most as many as tasks and sizes together.
    rank_at, full_at, seen, fulls = {}, {}, {}, 0
    sums = ranked.groupBy("task", "size").agg(F.count("*"), F.sum((F.col("n") - F.col("size")) / capacity).cast("bigint")).collect()
    for task, at, n, full in sorted(map(tuple, sums)):
        full_at.setdefault(task, fulls)
        rank_at[task, at] = seen.get(at, 0)
        seen[at] = seen.get(at, 0) + n
        fulls += full
    placed = ranked.mapInArrow(trimmed(_place_rows(plan, rank_at, full_at)), _PIECE + ", uid bigint")
    crossing = placed.where("ids_crc32 is null").join(cut.select("uid", "rest"), "uid").mapInArrow(trimmed(_split_rows(plan)), _PIECE)
    return placed.where("ids_crc32 is not null").drop("uid").unionByName(crossing)
