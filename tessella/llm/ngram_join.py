"""Exact n-gram Jaccard join by adaptive multi-match prefixes, reported as components.

Texts become sets of word shingles (64-bit hashes; `text.shingle_sets`). Two texts link when
``den * |x & y| >= num * |x | y|``. Equal sets are one class from the start, so copies cost a row
each and no pair. The rest is the l-prefix scheme: under any fixed order of shingles, two sets with
an overlap of at least T share at least l shingles among their first ``size - T + l``.

1. Screening, in hash order: each class gives a prefix long enough to ask for 5 % of its shingles
   to be shared by somebody. Classes below that have no partner and go no further; a common line or
   passage doesn't get a text past this step.
2. Among the rest, shingles are ordered by their exact document frequency. Each class lengthens its
   own prefix (l = 1 .. `MOST_MATCHES`) while the estimated cost falls: postings to scan, plus
   ``postings / l`` candidates to verify. A pair has to share ``min(l_x, l_y)`` prefix shingles,
   counted only where the sizes of that pair allow (length and position filters; shingles that
   nobody else has can't be in an overlap).
3. Candidates that a component can do without are never made: posting lists are first verified
   against their most central member (a star, linear in the list), and the links become components.
   Then only pairs of *different* components become candidates: in short lists by shared prefix
   shingles as above, in long lists by shared differences from the pivot (`_by_difference`). So
   large groups of near copies don't cost a row a pair, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import text as T
from tessella.llm.common import components, hot_join, materialize, release, salted_join, scratch, trimmed

#: Most prefix shingles that a pair may be asked to share.
MOST_MATCHES = 8
#: Pivots of short lists that a class is verified against; the step after it is exact.
PIVOTS = 3
#: Members beyond which a posting list is long.
LONG = 64
#: Classes left by the screening (16 bytes each) whose ids are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Share of its shingles that the screening asks a class to have in common with others.
SCREEN = 0.05


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def _set_id(s: np.ndarray) -> np.int64:
    """A hash of the whole set."""
    return T.mix(np.array([T.mix(s + np.uint64(len(s))).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0]


def _screen_rows(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, prefixes, rows = [], [], [], batch.num_rows
            for _, s in T.shingle_sets(batch.column(1), size):
                n.append(len(s))
                ids.append(_set_id(s) if len(s) else 0)
                least = _ceil_div(num * len(s), den)
                prefixes.append(s[: len(s) - least + 1 + min(int(SCREEN * len(s)), max(least - 1, 0))].view(np.int64))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            assert len(n) == rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "n", "cid", "pre"])

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sets = [], []
            for (_, s), want in zip(T.shingle_sets(batch.column(0), size), batch.column(1).to_pylist(), strict=True):
                if len(s) and _set_id(s) == want:
                    cids.append(want)
                    sets.append(s.view(np.int64))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["cid", "n", "sh"])

    return run


def choose_matches(n: int, unique: int, df: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """(l, shared shingles in the l-prefix) at the least estimated cost, for a set of ``n``
    shingles, ``unique`` of which nobody shares, and the ascending frequencies of the others."""
    least = _ceil_div(num * n, den)
    first = n - least + 1 - unique
    if first <= 0:
        return 1, 0
    scanned = np.concatenate([[0], np.cumsum(df - 1)])
    best = (float("inf"), 1, 0)
    for l in range(1, min(MOST_MATCHES, least) + 1):
        k = min(first + l - 1, len(df))
        cost = scanned[k] + scanned[k] / l * (n / 8)
        if cost < best[0]:
            best = (cost, l, k)
    return best[1], best[2]


def _prefix_rows(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cid, n, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                df, tok = (ts.values.field(k).to_numpy() for k in (0, 1))
                unique = n - len(tok)
                l, k = choose_matches(n, unique, df, num, den)
                if k:
                    m = np.ones(k, np.int64)
                    out.append((tok[:k], unique + np.arange(k), m * cid, m * n, m * unique, m * l))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["tok", "pos", "cid", "n", "u", "l"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, long) with both sizes, the overlap and, if long, the symmetric difference."""
    pairs = materialize(pairs)
    per = pairs.groupBy("b").agg(F.count("*").alias("c"))  # many members of a large group have one pivot
    pairs = salted_join(pairs, sets.select(F.col("cid").alias("a"), F.col("sh").alias("sa")), ["a"])
    pairs = salted_join(pairs, sets.select(F.col("cid").alias("b"), F.col("sh").alias("sb")), ["b"], counts=per)
    diff = F.when(F.col("long"), F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")))
    return pairs.select("a", "b", "long", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"), diff.alias("diff"))


def _by_difference(star: DataFrame, comps: DataFrame, num: int, den: int) -> DataFrame:
    """Linked pairs (a, b) of different components among the members of each pivot.

    With E the symmetric difference from the pivot, x and y differ in |E(x)| + |E(y)| - 2 k
    shingles, k being those that E(x) and E(y) share. They link when that is at most
    ``(|x| + |y|) (den - num) / (den + num)``. If the first two terms are within it, both link with
    the pivot and are in one component already; so only members that share a difference are left,
    and k alone decides.
    """
    member = star.select(F.col("b").alias("p"), F.col("a").alias("cid"), F.col("na").alias("n"), F.size("diff").alias("e"), "diff").join(comps, "cid")
    item = materialize(member.select("p", "cid", "n", "e", "comp", F.explode("diff").alias("el")))
    mixed = item.groupBy("p", "el").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("p", "el")
    main = member.groupBy("p", "comp").agg(F.count("*").alias("c")).groupBy("p").agg(F.max(F.struct("c", "comp")).alias("m")).select("p", F.col("m.comp").alias("main"))
    per = item.groupBy("p").agg(F.count("*").alias("c"))
    item = salted_join(salted_join(item, mixed, ["p", "el"], "left_semi"), main, ["p"], counts=per)
    item = materialize(item.withColumn("r", F.count("*").over(Window.partitionBy("p", "cid"))))
    x, y = item.where("comp != main").alias("x"), item.alias("y")
    over = f"(x.e + y.e) * {den + num} - (x.n + y.n) * {den - num}"
    pair = x.join(y, F.expr(f"""x.p = y.p and x.el = y.el and x.comp != y.comp and (y.comp = y.main or x.cid < y.cid)
        and {over} <= least(x.r, y.r) * {2 * (den + num)}"""))
    pair = pair.groupBy(F.expr("x.p").alias("p"), F.expr("x.cid").alias("a"), F.expr("y.cid").alias("b"), F.expr(over).alias("over")).agg(F.count("*").alias("k"))
    return pair.where(f"over <= k * {2 * (den + num)}").select("a", "b").distinct()


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; further
    columns are ignored).

    Null, empty and blank texts have no shingles and are linked with nothing. Rows with a null
    doc_id are linked with nothing and have a null component_id. Rows that repeat a text, under the
    same doc_id or another, are in one component. An empty table gives no rows.
    """
    with scratch() as made:
        rows, lookup = _joined(docs.select(F.col("doc_id").cast("bigint"), "text"), size, num, den, made)
        release(docs.sparkSession, made, rows, lookup)
    out = salted_join(rows, lookup, ["cid"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _joined(docs: DataFrame, size: int, num: int, den: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, cid) and the component_id of each cid that isn't a row's alone, as tables."""
    screened = materialize(docs.mapInArrow(trimmed(_screen_rows(size, num, den)), "doc_id bigint, n bigint, cid bigint, pre array<bigint>"))
    usable = screened.where("n > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.count_distinct("doc_id").alias("ids")))

    # 1. Screening. Copies have one cid, so a shingle that only they hold isn't shared.
    tokens = usable.select("cid", F.explode("pre").alias("tok"))
    shared = tokens.groupBy("tok").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("c")).where("lo != hi").select("tok", "c")
    shared = materialize(shared)
    need = classes.select("cid", "rep", F.expr(f"copies * (1 + least(int({SCREEN} * n), greatest(ceil({num} * n / {den}) - 1, 0)))").alias("need"))
    found = hot_join(tokens, shared.select("tok"), ["tok"], "left_semi", shared).groupBy("cid").agg(F.count("*").alias("k"))
    active = materialize(found.join(need, "cid").where("k >= need").select("cid", F.col("rep").alias("doc_id")))
    named_rows = materialize(screened.select("doc_id", "n", F.when(F.expr("n > 0 and doc_id is not null"), F.col("cid")).alias("cid")))
    release(docs.sparkSession, made, classes, active, named_rows)  # prefixes aren't read again

    # 2. Exact frequencies and prefixes of the classes that are left.
    few = active.count() <= BROADCAST_ROWS
    sets = docs.join(F.broadcast(active) if few else active, "doc_id").select("text", "cid").mapInArrow(trimmed(_set_rows(size)), "cid bigint, n bigint, sh array<bigint>")
    if not classes.where("copies > ids").isEmpty():  # a row that repeats text and doc_id would give its set twice
        sets = sets.dropDuplicates(["cid"])
    sets = materialize(sets)
    rows = sets.select("cid", F.explode("sh").alias("tok"))
    df = materialize(rows.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"))
    lists = hot_join(rows, df, ["tok"], counts=df.withColumnRenamed("df", "c")).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("ts")).join(sets.select("cid", "n"), "cid")
    prefix = materialize(lists.select("cid", "n", "ts").mapInArrow(trimmed(_prefix_rows(num, den)), "tok bigint, pos bigint, cid bigint, n bigint, u bigint, l bigint"))

    # 3. Stars. In long lists every member is compared with the pivot, and keeps its difference.
    pivot = prefix.groupBy("tok").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("r"), F.col("cid").alias("b"), F.col("n").alias("bn"))).alias("p"), F.count("*").alias("size"))
    pivot = materialize(pivot.select("tok", "p.b", "p.bn", (F.col("size") > LONG).alias("long"), F.col("size").alias("c")))
    per = pivot.select("tok", "c")
    votes = salted_join(prefix.select("tok", F.col("cid").alias("a"), "n"), pivot.drop("c"), ["tok"], counts=per).where(f"a != b and (long or {den} * least(n, bn) >= {num} * greatest(n, bn))")
    votes = votes.groupBy("a", "b").agg(F.count("*").alias("v"), F.max("long").alias("long"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("v"), "b"))).where(f"long or r <= {PIVOTS}")
    star = materialize(_compared(best.select("a", "b", "long"), sets))
    linked = f"{den} * both >= {num} * (na + nb - both)"
    links = star.where(linked).select("a", "b")
    groups = components(links)

    # 4. What links different components: from short lists by shared prefix shingles,
    placed = materialize(prefix.join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root"))
    short = salted_join(placed, pivot.where("not long").select("tok"), ["tok"], "left_semi", per)
    mixed = short.groupBy("tok", "comp").agg(F.count("*").alias("c")).groupBy("tok").agg(F.count("*").alias("k"), F.max(F.struct("c", "comp")).alias("m")).where("k > 1")
    short = materialize(salted_join(short, mixed.select("tok", F.col("m.comp").alias("main")), ["tok"], counts=per))
    x, y = short.where("comp != main").alias("x"), short.alias("y")
    least = f"ceil({num} * (x.n + y.n) / {den + num})"
    near = x.join(y, F.expr(f"""x.tok = y.tok and x.comp != y.comp and (y.comp = y.main or x.cid < y.cid)
        and {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)
        and x.n - x.u >= {least} and y.n - y.u >= {least}
        and x.pos < x.n - {least} + least(x.l, y.l) and y.pos < y.n - {least} + least(x.l, y.l)"""))
    near = near.groupBy(F.expr("least(x.cid, y.cid)").alias("a"), F.expr("greatest(x.cid, y.cid)").alias("b"), F.expr("least(x.l, y.l)").alias("l")).agg(F.count("*").alias("k")).where("k >= l")
    more = _compared(near.select("a", "b", F.lit(False).alias("long")), sets).where(linked).select("a", "b")
    # and from long lists by shared differences from the pivot.
    more = materialize(more.unionByName(_by_difference(star.where("long"), placed.select("cid", "comp").distinct(), num, den)))
    if not more.isEmpty():
        groups = components(links.unionByName(more))

    # 5. From classes back to rows; classes of one row that nothing links keep their own id.
    named = groups.withColumnRenamed("node", "cid").join(classes.select("cid", "rep"), "cid")
    named = salted_join(named, named.groupBy("root").agg(F.min("rep").alias("component_id")), ["root"]).select("cid", "component_id")
    lookup = classes.select("cid", "rep", "copies").join(named, "cid", "left").where("copies > 1 or component_id is not null")
    lookup = materialize(lookup.select("cid", F.coalesce("component_id", "rep").alias("component_id")))
    return named_rows, lookup
