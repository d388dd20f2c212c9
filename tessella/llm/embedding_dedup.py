"""Embedding near-dedup by int8 tile products with rigorous bounds.

Equal vectors are one class from the start. Classes are ordered by (dimension, nearest pivot, angle to
it), where pivots are vectors drawn by a hash, and cut into tiles of one cell each; some neighbouring
tiles are a strip. Strips, tiles and what may be near them are known by a cap (centre and radius) and by
the least and largest angle to every pivot. By the triangle inequality, two of them hold no link if
their centres are further apart than the threshold's angle and both radii, or if their angles to any
pivot are. A tile travels once to each strip that may hold a link with it (of two strips, one gets
the tiles of the other), as int8 rows with a scale a vector, and is multiplied there with the tiles that
it may link to; products of integers of at most 127 in up to 1000 dimensions are exact in
float32. With u = s q + e, |e| <= E,

    |u.v - s t (q.r)| <= E_u + E_v + E_u E_v,

since |u| = |v| = 1 up to rounding, for which both errors have an allowance. Pairs that the bound
puts below the threshold are done. For the others the rest e, which travels as 16-bit integers, gives a
second bound of the same form, some 1e-7 wide; pairs that even this can't decide are recomputed from the
double precision vectors, joined for them alone.

A strip returns no pairs but, per tile, how many vectors each class links to, and the first class of
its component there. Components are joined from these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import components, materialize, salted_join, trimmed

#: Pivots of a dimension at most; vectors of a cell on average, at least.
CELLS, IN_CELL = 256, 512
#: Vectors that the pivots are drawn from, about.
PIVOT_SAMPLE = 4096
#: Bytes of a tile's rows at most (3 a component), and strips at most, whose caps are broadcast.
TILE_BYTES, STRIPS = 1 << 16, 1 << 14


def quantise(unit: np.ndarray, top: int = 127) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of integers of at most ``top``, scales, error bounds): |unit - scale * row| <= error, in
    the Euclidean norm."""
    scale = np.abs(unit).max(axis=1, initial=0) / top
    scale[scale == 0] = 1
    rows = np.rint(unit / scale[:, None]).astype(np.int8 if top < 128 else np.int16)
    return rows, scale, np.linalg.norm(unit - rows * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12


class Tile:
    """Vectors as integers: ``rows`` (int8 values, as float32 for the product), ``scale`` and
    ``error``; ``fine`` (with the 16-bit rest) and ``fine_error``."""

    def __init__(self, rows: np.ndarray, rest: np.ndarray, measures: np.ndarray):
        self.scale, self.error, step, self.fine_error = measures
        self.rows = rows.astype(np.float32)
        self.fine = rows * self.scale[:, None] + rest * step[:, None]

    @staticmethod
    def of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a tile of these vectors is made of."""
        rows, scale, error = quantise(unit)
        rest, step, fine = quantise(unit - rows * scale[:, None], 32767)
        return rows, rest, np.stack([scale, error, step, fine + 1e-12])


def tile_links(a: Tile, b: Tile | None, threshold: float, strip: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Index pairs (i in a, j in b) with a cosine of at least ``threshold``, then those that the
    bounds can't tell; within a for b None, with i < j. ``strip`` products at a time."""
    other, found = b or a, []
    n, many = len(a.rows), max(1, strip // max(1, len(other.rows)))
    widest, worst = other.scale.max(initial=0), other.error.max(initial=0)
    for lo in range(0, n if len(other.rows) else 0, many):
        part = slice(lo, lo + many)
        product = a.rows[part] @ other.rows.T
        # A row's bound with the other tile's largest scale and error: one comparison for all pairs.
        bound = (threshold - a.error[part] - worst - a.error[part] * worst - 1e-9) / (a.scale[part] * widest)
        i, j = np.nonzero(product >= np.floor(bound).astype(np.float32)[:, None])
        near = product[i, j].astype(np.float64) * a.scale[lo + i] * other.scale[j]
        i += lo
        ok = near + a.error[i] + other.error[j] + a.error[i] * other.error[j] + 1e-9 >= threshold
        if b is None:
            ok &= i < j
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 65536):
            x, y = i[k : k + 65536], j[k : k + 65536]
            near, slack = np.einsum("ij,ij->i", a.fine[x], other.fine[y]), a.fine_error[x] + other.fine_error[y] + a.fine_error[x] * other.fine_error[y] + 1e-12
            sure, open_ = near - slack >= threshold, np.abs(near - threshold) < slack
            found.append((x[sure], y[sure], x[open_ & ~sure], y[open_ & ~sure]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, j, low[i])
        np.minimum.at(low, i, low[j])
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low, before):
            return low


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, unit vector as bytes, or null for one that links with nothing)."""
    for batch in batches:
        column = batch.column(1)
        sizes = np.asarray(column.value_lengths().fill_null(0))
        flat, out = column.flatten(), [None] * len(sizes)
        holes = np.asarray(flat.is_null())
        values = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
        ends = np.cumsum(sizes)
        for size in np.unique(sizes[sizes > 0]).tolist():
            on = np.flatnonzero(sizes == size)
            at = (ends[on] - size)[:, None] + np.arange(size)
            rows = values[at]
            top = np.abs(rows).max(axis=1)
            ok = np.isfinite(rows).all(axis=1) & ~holes[at].any(axis=1) & (top > 0)
            rows = rows[ok] / top[ok, None]  # large or tiny components don't overflow
            rows /= np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
            for k, x in zip(on[ok].tolist(), rows + 0.0, strict=True):
                out[k] = x.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])


def _cells(pivots: dict[int, np.ndarray]):
    """Adds the cell (nearest pivot of the same dimension), and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("unit").to_pylist()
            dims = np.array([len(x) // 8 for x in raw], np.int64)
            cell, angle = np.zeros(len(raw), np.int64), np.zeros(len(raw))
            for d in np.unique(dims).tolist():
                on = np.flatnonzero(dims == d)
                cos = np.frombuffer(b"".join(raw[k] for k in on), np.float64).reshape(-1, d) @ pivots[d].T
                cell[on] = cos.argmax(axis=1)
                angle[on] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell), pa.array(angle)], [*batch.schema.names, "dim", "cell", "angle"])

    return run


class Cap:
    """Where vectors lie: within ``radius`` of ``centre``, and from ``least`` to ``most`` off each pivot."""

    def __init__(self, centre: np.ndarray, radius: float, least: np.ndarray, most: np.ndarray):
        self.centre, self.radius, self.least, self.most = centre, radius, least, most

    @staticmethod
    def of(unit: np.ndarray, pivots: np.ndarray) -> Cap:
        centre = unit.mean(axis=0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 1e-9 else unit[0]
        off = np.arccos(np.clip(unit @ pivots.T, -1, 1))
        return Cap(centre, float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) + 1e-7, off.min(axis=0) - 1e-7, off.max(axis=0) + 1e-7)

    @staticmethod
    def around(caps: list[Cap]) -> Cap:
        centre = np.mean([c.centre for c in caps], axis=0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 1e-9 else caps[0].centre
        radius = max(math.acos(max(-1.0, min(1.0, float(c.centre @ centre)))) + c.radius for c in caps) + 1e-7
        return Cap(centre, radius, np.min([c.least for c in caps], axis=0), np.max([c.most for c in caps], axis=0))

    def pack(self) -> bytes:
        return np.concatenate([[self.radius], self.centre, self.least, self.most]).tobytes()

    @staticmethod
    def unpack(raw: bytes, d: int) -> Cap:
        x = np.frombuffer(raw, np.float64)
        many = (len(x) - 1 - d) // 2
        return Cap(x[1 : 1 + d], float(x[0]), x[1 + d : 1 + d + many], x[1 + d + many :])


class Caps:
    """Many caps of one dimension, to be compared with one at once."""

    def __init__(self, caps: list[Cap]):
        self.centre, self.radius, self.least, self.most = (np.array([getattr(c, k) for c in caps]) for k in ("centre", "radius", "least", "most"))

    def near(self, cap: Cap, limit: float) -> np.ndarray:
        """Which of them may hold a vector within the angle ``limit`` of one in ``cap``."""
        apart = np.arccos(np.clip(self.centre @ cap.centre, -1, 1)) - self.radius - cap.radius
        return (apart <= limit + 1e-6) & (np.maximum(self.least - cap.most, cap.least - self.most) <= limit + 1e-6).all(axis=1)


_TILE = "strip bigint, tile bigint, dim bigint, cap binary, ids binary, copies binary, rows binary, rest binary, measures binary"
_TILE_NAMES = [x.split()[0] for x in _TILE.split(", ")]
_TILE_TYPES = [pa.int64()] * 3 + [pa.binary()] * 6


def _tile_rows(pivots: dict[int, np.ndarray], tile_bytes: int, strip_tiles: int):
    """Tiles of rows in order, a row each; after the last of a strip a row for the strip, without ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, tile, at, held, caps = TaskContext.get().partitionId() << 32, 0, None, [], []

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TILE_TYPES, strict=True)], _TILE_NAMES)

        def flush():
            nonlocal tile
            if held:
                d = at[0]
                unit = np.frombuffer(b"".join(x[2] for x in held), np.float64).reshape(-1, d)
                caps.append(Cap.of(unit, pivots[d]))
                rows, rest, measures = Tile.of(unit)
                ids, copies = (np.array([x[k] for x in held], np.int64).tobytes() for k in (0, 1))
                yield row(strip, tile, d, caps[-1].pack(), ids, copies, rows.tobytes(), rest.tobytes(), measures.tobytes())
                tile += 1
                held.clear()

        def end():
            nonlocal strip
            if caps:
                yield row(strip, -1, at[0], Cap.around(caps).pack(), None, None, None, None, None)
                strip += 1
                caps.clear()

        for batch in batches:
            for cid, copies, unit, d, cell in zip(*(batch.column(k).to_pylist() for k in ("cid", "copies", "unit", "dim", "cell")), strict=True):
                if at != (d, cell) or len(held) >= max(16, tile_bytes // (3 * d)):
                    yield from flush()
                    if at and at[0] != d or len(caps) >= strip_tiles:
                        yield from end()
                    at = (d, cell)
                held.append((cid, copies, unit))
        yield from flush()
        yield from end()

    return run


def _sent(strips: dict[int, tuple[np.ndarray, Caps]], limit: float):
    """Adds the numbers of the strips that a tile goes to: its own, and of others that may hold a
    link with it those whose turn it is (of two strips, one gets the tiles of the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, own = [], []
            for strip, d, cap in zip(*(batch.column(k).to_pylist() for k in ("strip", "dim", "cap")), strict=True):
                names, numbers, caps = strips[d]
                me = int(numbers[np.searchsorted(names, strip)])
                turn = ((numbers + me) % 2 == 0) == (numbers < me)
                out.append([me, *numbers[caps.near(Cap.unpack(cap, d), limit) & turn & (numbers != me)].tolist()])
                own.append(me)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32())), pa.array(own, pa.int32())], [*batch.schema.names, "to", "own"])

    return run


_FOUND = "kind int, a bigint, b bigint, n bigint, m bigint"
#: Kinds of rows of `_multiply`: a links to n vectors; b is the first class of a's component in a tile pair; the bounds
#: can't tell whether a (of n vectors) and b (of m) link; n pairs of classes were multiplied and m were not.
LINKS, FIRST, OPEN, WORK = range(4)


def _multiply(threshold: float, limit: float):
    def out(kind, a, b=None, n=None, m=None):
        cols = [pa.array(np.broadcast_to(x, len(a)), pa.int64()) if x is not None else pa.nulls(len(a), pa.int64()) for x in (a, b, n, m)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *cols], ["kind", "a", "b", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, mine, compared, skipped = None, [], 0, 0

        def done():
            for x in mine:
                on = np.flatnonzero(x[3])
                if len(on):
                    yield out(LINKS, x[1][on], n=x[3][on])
            mine.clear()

        def pair(x, y):
            """Links of x, one of the strip's own tiles, with y, or within x."""
            nonlocal compared
            tile, ids, copies, total = x
            same = y[1] is ids
            i, j, p, q = tile_links(tile, None if same else y[0], threshold)
            compared += len(ids) * (len(ids) - 1) // 2 if same else len(ids) * len(y[1])
            if len(i):
                total += np.bincount(i, y[2][j], len(ids)).astype(np.int64)
                y[3][:] += np.bincount(j, copies[i], len(y[1])).astype(np.int64)
                both = ids if same else np.append(ids, y[1])
                low = labels(i, j + (0 if same else len(ids)), len(both))
                joined = np.flatnonzero(low != np.arange(len(both)))
                yield out(FIRST, both[joined], both[low[joined]])
            if len(p):
                yield out(OPEN, ids[p], y[1][q], copies[p], y[2][q])

        for batch in batches:
            for r in batch.to_pylist():
                if r["to"] != strip:
                    yield from done()
                    strip, caps = r["to"], None
                d = r["dim"]
                ids, copies = (np.frombuffer(r[k], np.int64) for k in ("ids", "copies"))
                tile = Tile(np.frombuffer(r["rows"], np.int8).reshape(-1, d), np.frombuffer(r["rest"], np.int16).reshape(-1, d), np.frombuffer(r["measures"], np.float64).reshape(4, -1))
                y, cap = (tile, ids, copies, np.zeros(len(ids), np.int64)), Cap.unpack(r["cap"], d)
                if r["own"] == strip:
                    near = [*(Caps([c]).near(cap, limit)[0] for *_, c in mine), True]
                    mine.append((*y, cap))
                    caps = None
                else:
                    caps = caps or Caps([c for *_, c in mine])
                    near = caps.near(cap, limit)
                for x, close in zip(mine, near, strict=True):
                    if close:
                        yield from pair(x[:4], y)
                    else:
                        skipped += len(ids) * len(x[1])
                if r["own"] != strip and y[3].any():
                    on = np.flatnonzero(y[3])
                    yield out(LINKS, ids[on], n=y[3][on])
        yield from done()
        yield out(WORK, np.zeros(1, np.int64), n=compared, m=skipped)

    return run


def _exact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cosine of each pair in double precision."""
    for batch in batches:
        a, b = (batch.column(k).to_pylist() for k in ("ua", "ub"))
        cos = [float(np.einsum("ij,ij->i", np.frombuffer(x, np.float64)[None], np.frombuffer(y, np.float64)[None])[0]) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("a", "b", "n", "m")), pa.array(cos, pa.float64())], ["a", "b", "n", "m", "cos"])


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, unit), and classes (cid, rep, copies, unit) of equal unit vectors, as tables."""
    rows = materialize(vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(trimmed(_unit_rows), "vec_id bigint, unit binary"))
    classes = rows.where("unit is not null").withColumn("cid", F.xxhash64("unit", F.lit(7)))
    return rows, materialize(classes.groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")))


def compare(classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (kind, a, b, n, m) of all pairs of classes (cid, copies, unit), as a table."""
    spark = classes.sparkSession
    total, widest = classes.agg(F.count("*"), F.max(F.length("unit"))).first()
    draw = F.pmod(F.xxhash64("cid", F.lit("pivot")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, PIVOT_SAMPLE / max(total, 1)))
    drawn = classes.where(draw).select("cid", "unit").orderBy(F.length("unit"), "cid").limit(2 * PIVOT_SAMPLE).collect()
    many = max(1, min(CELLS, total // IN_CELL))
    pivots: dict[int, np.ndarray] = {}
    for d in {r[0] for r in classes.select((F.length("unit") / 8).cast("int")).distinct().collect()}:
        raw = [bytes(r["unit"]) for r in drawn if len(r["unit"]) == 8 * d]
        raw = raw[:: max(1, len(raw) // many)][:many]
        pivots[d] = np.frombuffer(b"".join(raw), np.float64).reshape(-1, d) if raw else np.eye(1, d)
    placed = classes.mapInArrow(trimmed(_cells(pivots)), "cid bigint, rep bigint, copies bigint, unit binary, dim bigint, cell bigint, angle double")
    # Strips: as long as two for each core leave them, and no more than can be broadcast.
    tiles = math.ceil(total / max(16, TILE_BYTES // (3 * max(1, (widest or 8) // 8)))) + many
    strip = max(1, min(64, tiles // (2 * spark.sparkContext.defaultParallelism)), math.ceil(tiles / STRIPS))
    ordered = placed.select("cid", "copies", "unit", "dim", "cell", "angle").repartitionByRange("dim", "cell", "angle", "cid").sortWithinPartitions("dim", "cell", "angle", "cid")
    made = materialize(ordered.mapInArrow(trimmed(_tile_rows(pivots, TILE_BYTES, strip)), _TILE))
    heads = sorted((r["dim"], r["strip"], bytes(r["cap"])) for r in made.where("tile < 0").select("dim", "strip", "cap").collect())  # STRIPS, and one a task, at most
    strips = {}
    for d in {h[0] for h in heads}:
        on = [k for k, h in enumerate(heads) if h[0] == d]
        strips[d] = np.array([heads[k][1] for k in on]), np.array(on), Caps([Cap.unpack(heads[k][2], d) for k in on])
        order = np.argsort(strips[d][0])
        strips[d] = strips[d][0][order], strips[d][1][order], strips[d][2]
    limit = math.acos(max(-1.0, min(1.0, threshold)))
    sent = made.where("tile >= 0").mapInArrow(trimmed(_sent(strips, limit)), _TILE + ", to array<int>, own int").withColumn("to", F.explode("to"))
    sent = sent.repartitionById(max(1, len(heads)), "to").sortWithinPartitions("to", F.col("own") != F.col("to"), "strip", "tile")
    return materialize(sent.mapInArrow(trimmed(_multiply(threshold, limit)), _FOUND))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding;
    further columns, such as labels, are ignored).

    Null, empty and zero vectors and those with null or non-finite components link with nothing, nor
    do vectors of different dimensions with each other. Rows without a vec_id count as vectors that
    others link to, but have no component of their own. Rows that repeat a vec_id are vectors of
    their own: each has its row. An empty table gives no rows.
    """
    rows, classes = _classes(vectors)
    found = compare(classes, threshold)
    exact = found.where(f"kind = {OPEN}").select("a", "b", "n", "m")
    for k in "ab" if not exact.isEmpty() else "":
        exact = salted_join(exact, classes.select(F.col("cid").alias(k), F.col("unit").alias(f"u{k}")), [k])
    exact = exact.limit(0) if "ua" not in exact.columns else materialize(exact.mapInArrow(trimmed(_exact_rows), "a bigint, b bigint, n bigint, m bigint, cos double").where(F.col("cos") >= threshold))

    counts = found.where(f"kind = {LINKS}").select(F.col("a").alias("cid"), "n")
    counts = counts.unionByName(exact.select(F.col("a").alias("cid"), F.col("m").alias("n"))).unionByName(exact.select(F.col("b").alias("cid"), "n")).groupBy("cid").agg(F.sum("n").alias("n"))
    groups = components(found.where(f"kind = {FIRST}").select("a", "b").unionByName(exact.select("a", "b")))
    named = groups.withColumnRenamed("node", "cid").join(classes.select("cid", "rep"), "cid")
    named = salted_join(named, named.groupBy("root").agg(F.min("rep").alias("component_id")), ["root"]).select("cid", "component_id")
    lookup = classes.select("cid", "rep", "copies").join(counts, "cid", "left").join(named, "cid", "left").where("copies > 1 or n is not null")
    lookup = materialize(lookup.select("cid", F.expr("coalesce(n, 0) + copies - 1").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")))
    out = salted_join(rows.select("vec_id", F.when(F.col("unit").isNotNull(), F.xxhash64("unit", F.lit(7))).alias("cid")), lookup, ["cid"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
