"""Language identification by bit-sliced Bloom filters over character n-grams.

A filter position holds a bit for each language, so one lookup tells every language that has an
n-gram: the bits of all its positions, and-ed. Per language the hits of a text are counted
(popcounts of each slice), corrected for that slice's share of false positives, and the language
with the most wins. The score is the corrected share of the text's n-grams that the language has.

N-grams are three and four characters of lower-cased words, with a space at each end. A language's
n-grams are those in a least share of its labelled texts (`MIN_SHARE`) whose share is not far below
that of another language (`PURITY`); so the filters have a size that doesn't grow with the corpus.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import schema_with, trimmed, without
from tessella.llm.text import mix

#: Labelled texts of each language that a filter is fitted on, about (drawn by a hash of the id).
FIT_TEXTS = 4000
MIN_SHARE = 0.002
PURITY = 0.1
#: Filter positions of an n-gram; and positions there are for each n-gram of the largest language.
HASHES, ROOM = 2, 16
_CHARS = 1 << 19
_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text after the last, the text of each n-gram, its hash, texts with a letter)."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < _CHARS):
            size += len(texts[hi])
            hi += 1
        low = [t.lower() for t in texts[lo:hi]]
        chars = np.frombuffer((" " + " ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in low])
        word = _letters()[chars]
        code = np.where(word, chars, 32).astype(np.uint64)
        doc = np.searchsorted(ends, np.arange(len(chars)) - 1, side="right")
        where, found = [], []
        for n in (3, 4):
            m = len(chars) - n + 1
            ok = word[1 : m + 1].copy()
            for k in range(2, n - 1):
                ok &= word[k : m + k]
            at = np.flatnonzero(ok)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h += code[at + k] * _SEED[k]
            where.append(doc[at + 1])
            found.append(mix(h))
        has = np.bincount(doc[word], minlength=hi - lo)[: hi - lo] > 0
        yield lo, hi, np.concatenate(where), np.concatenate(found), has
        lo = hi


def _gram_rows(langs: list[str]):
    """How many texts of each language have an n-gram, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = {x: k for k, x in enumerate(langs)}, [[] for _ in langs], 0

        def counts():
            for k, parts in enumerate(held):
                if parts:
                    g, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
                    parts.clear()

        for batch in batches:
            lang = batch.column(1).to_pylist()
            for lo, hi, doc, h, _ in grams([t or "" for t in batch.column(0).to_pylist()]):
                order = np.argsort(doc, kind="stable")
                bounds = np.searchsorted(doc[order], np.arange(hi - lo + 1))
                h = h[order]
                for k in range(hi - lo):
                    g = np.unique(h[bounds[k] : bounds[k + 1]])
                    held[number[lang[lo + k]]].append(g)
                    size += len(g)
                if size > 1 << 22:
                    yield from counts()
                    size = 0
        yield from counts()

    return run


class Model:
    """Languages by name, and the bit slices: ``slices[b, position]`` holds eight languages a byte."""

    def __init__(self, langs: list[str], texts: np.ndarray, lang: np.ndarray, gram: np.ndarray):
        self.langs, self.texts = langs, texts
        most = int(np.bincount(lang, minlength=1).max()) if len(lang) else 1
        self.size = 1 << max(10, int(most * ROOM - 1).bit_length())
        self.slices = np.zeros((max(1, -(-len(langs) // 8)), self.size), np.uint8)
        for at in self.positions(gram):
            np.bitwise_or.at(self.slices, (lang // 8, at), (1 << (lang % 8)).astype(np.uint8))
        fill = np.array([(self.slices[k // 8] >> (k % 8) & 1).mean() for k in range(len(langs))])
        self.false = fill**HASHES

    def positions(self, gram: np.ndarray) -> list[np.ndarray]:
        h = gram.view(np.uint64)
        return [((h >> np.uint64(32 * k)) & np.uint64(self.size - 1)).astype(np.int64) for k in range(HASHES)]

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        """(language, score) of each text; ``und`` without a letter or where none is known."""
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        for lo, hi, doc, h, has in grams(texts):
            rows = hi - lo
            total = np.maximum(np.bincount(doc, minlength=rows)[:rows], 1)
            hits = []
            at = self.positions(h)
            for part in self.slices:
                held = part[at[0]]
                for x in at[1:]:
                    held = held & part[x]
                hits.append(np.bincount(doc * 256 + held, minlength=rows * 256)[: rows * 256].reshape(rows, 256) @ bits)
            if not self.langs:
                yield from [("und", 0.0)] * rows
                continue
            hit = np.concatenate(hits, axis=1)[:, : len(self.langs)]
            share = np.clip((hit / total[:, None] - self.false) / (1 - self.false), 0, 1)
            order = np.lexsort((np.arange(len(self.langs)), -self.texts))  # ties: most texts, then name
            best = order[share[:, order].argmax(axis=1)]
            for k in range(rows):
                yield (self.langs[best[k]], float(share[k, best[k]])) if has[k] else ("und", 0.0)


def fit(labelled: DataFrame, fit_texts: int = FIT_TEXTS) -> Model:
    """A model of the texts and languages in ``labelled`` (doc_id, text, lang); rows with a null text
    or language don't count, rows without a doc_id do."""
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string"))
    sizes = dict(sorted(map(tuple, labelled.groupBy("lang").count().collect())))  # one row a language
    langs = list(sizes)
    if not langs:
        return Model([], np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_texts / n))])
    drawn = labelled.where(draw < rate[F.col("lang")]).select("text", "lang")
    texts = dict(map(tuple, drawn.groupBy("lang").count().collect()))
    least = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (k, max(1, int(np.ceil(MIN_SHARE * texts.get(lang, 0)))))])
    rows = drawn.mapInArrow(trimmed(_gram_rows(langs)), "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = rows.where(F.col("n") >= least[F.col("lang")]).toArrow()  # n-grams of a text / MIN_SHARE a language at most
    lang, gram, n = (rows.column(c).to_numpy().astype(t) for c, t in (("lang", np.int64), ("gram", np.int64), ("n", np.float64)))
    share = n / np.array([max(texts.get(x, 0), 1) for x in langs], float)[lang]
    _, same = np.unique(gram, return_inverse=True)
    top = np.zeros(same.max(initial=-1) + 1)
    np.maximum.at(top, same, share)
    pure = share >= PURITY * top[same]
    return Model(langs, np.array([sizes[x] for x in langs]), lang[pure], gram[pure])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1). Only the text counts.

    Null and empty texts and texts without a letter are ``und`` with score 0; a text with letters
    always gets a learned language, if any is. An empty table gives no rows. Rows that repeat are
    predicted alike; an extra column with one of the new names gives way to it.
    """
    docs = without(docs, "lang_pred", "score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.predict([t or "" for t in batch.column(names.index("text")).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(trimmed(run), schema_with(docs, "lang_pred string, score double"))
