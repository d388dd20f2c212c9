"""Substring dedup by sliding sentence spans.

A text is split into sentences: after ``.``, ``!``, ``?`` or an ellipsis (with closing quotes or
brackets) before white space, unless an abbreviation or an initial ends there, after ``。``, ``！`` or ``？``, and at line
ends. Sentences are cut at clauses, and what then is longer than `PIECE` words is cut before words that
the words around them choose, so that texts which share a passage share the cuts inside it, marks or
none, also where it is pasted into the middle of a sentence. Words stand between white space; in scripts
that write none (Han, kana, Thai, Lao, Khmer, Burmese) each character is one. From every sentence (or
piece) a span runs over as many following sentences as it takes to reach ``min_words`` words, at least
two. A passage of `MIN_WORDS` + 2 `PIECE` words (50) holds a span of its own. Spans
are compared by a 64-bit hash of their lower-cased words. Of every span that occurs more than once
in the table, the occurrence in the smallest (doc_id, position) stays; sentences that any other
occurrence covers are removed with the white space after them.

The hash of each span is joined globally: one aggregate with map-side combination finds the first
document of each repeated span, one join (hot spans broadcast) marks the other occurrences, and only
the marked positions meet the texts again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import text as T
from tessella.llm.common import materialize, release, schema_with, scratch, trimmed, without

#: Words that a span has at least; with fewer, everyday sentences would meet by chance.
MIN_WORDS = 26
#: Words that a piece has at most without a cut inside it.
PIECE = 12
#: Of as many neighbouring words in a longer piece, the one of least hash begins a new piece.
WINDOW = 8
_CLAUSE = re.compile(r"[,;:]\s+|[，、；：]\s*")
_SENTENCE = re.compile(r"""(?<=[.!?…])["'”’)\]]*\s+|\n+|(?<=[。！？])["'”’）」』]*\s*""")
#: Words before a full stop that ends no sentence; so does a single letter.
_ABBREVIATIONS = set("bzw ca cf ch co dr ed eg etc fig hr inc ing jr ltd m mme mr mrs ms no nr p pp prof sr sra st usw vgl vol vs z".split())
_BEFORE = re.compile(r"(\w+)\.$")
#: Characters of scripts without spaces between words.
_SPACELESS = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_SPACELESS = re.compile(f"[{_SPACELESS}]")
_WORD = re.compile(f"[{_SPACELESS}]|[^\x20\x09-\x0d{_SPACELESS}]+")


def _ends(text: str, at: int) -> bool:
    """Whether a sentence ends before the white space at ``at``."""
    m = _BEFORE.search(text, max(0, at - 8), at)
    return not m or len(m[1]) > 1 and m[1].lower() not in _ABBREVIATIONS or m.start() == max(0, at - 8) > 0


def _marks(text: str) -> list[int]:
    """Start of each sentence and clause, in characters."""
    starts, out = [0, *(m.end() for m in _SENTENCE.finditer(text) if "\n" in m[0] or _ends(text, m.start())), len(text)], []
    for a, b in zip(starts, starts[1:]):
        if a < b or not out:
            out.append(a)
        out += [m.end() for m in _CLAUSE.finditer(text, a, b) if m.end() < b]
    return out


def _words(text: str, data: np.ndarray, chars: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, in bytes."""
    if chars is None or not _HAS_SPACELESS.search(text):
        return T.words(data, np.array([0, len(data)]))[:2]
    spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    return tuple(np.append(chars, len(data))[spans].T)


def _pieces(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each piece in characters; the word that each begins with, and how many words there
    are; a hash of each word."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    chars = np.flatnonzero((data & 0xC0) != 0x80) if len(raw) != len(text) else None  # bytes that begin a character
    begin, end = _words(text, data, chars)
    at, n = np.array(_marks(text)), len(begin)
    first = np.append(np.searchsorted(begin, at if chars is None else np.append(chars, len(data))[at]), n)
    h = T.span_hashes(data, begin, end)
    size = np.diff(first)
    if n <= PIECE or size.max() <= PIECE:
        return at, first, h
    pair = np.append(np.uint64(0), T.sequence_hashes(h, 2))  # a word and the one before it
    least = WINDOW - 1 - np.lib.stride_tricks.sliding_window_view(pair, WINDOW)[:, ::-1].argmin(1)
    # windows in one long piece, without the word that it begins with
    p = np.arange(n - WINDOW + 1)
    head, stop, long = (np.repeat(x, size)[: len(p)] for x in (first[:-1], first[1:], size > PIECE))
    p = p[long & (p > head) & (p + WINDOW <= stop)]
    new = np.unique(p + least[p])
    where = begin[new] if chars is None else np.searchsorted(chars, begin[new])
    at, k = np.unique(np.append(at, where), return_index=True)
    return at, np.append(np.append(first[:-1], new)[k], n), h


def sentences(text: str) -> list[int]:
    """Start of each piece, in characters; from the second on, where the gap before it ends."""
    return _pieces(text)[0].tolist()


def _spans(text: str, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentence after the last, hash) of each span."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first, h = _pieces(text)
    m = len(at)
    if m < 2 or len(h) < min_words:
        return none
    some, k = np.diff(first) > 0, np.arange(m)
    stop = np.maximum(np.searchsorted(first, first[:m] + min_words), k + 2)
    ok = some & (stop <= m)
    go = np.minimum(np.searchsorted(first, first[1:] - min_words, side="right") - 1, k - 1)
    back = some & (go >= 0) & (first[1:] - first[np.maximum(go, 0)] >= min_words)
    both = np.unique(np.append(k[ok] * (m + 1) + stop[ok], go[back] * (m + 1) + k[back] + 1))
    ok, stop = both // (m + 1), both % (m + 1)
    if not len(ok):
        return none
    a, b = first[ok], first[stop]
    hashed = T.mix(T.Rolling(h).of(a, b) + (b - a).astype(np.uint64))
    return ok, stop, hashed.view(np.int64)


def _span_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = [_spans(t, min_words) if t else ((), (), ()) for t in part.column(1).to_pylist()]
                sizes = [len(x[0]) for x in found]
                rows = np.repeat(np.arange(len(found)), sizes)
                cols = [np.concatenate([np.asarray(x[k], np.int64) for x in found]) for k in range(3)] if found else [np.zeros(0, np.int64)] * 3
                again = np.ones(len(rows), bool)  # an earlier span of the text is the same
                for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
                    again[a + np.unique(cols[2][a:b], return_index=True)[1]] = False
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(cols[2]), pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)), pa.array(again)], ["doc_id", "h", "i", "j", "again"])

    return run


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the sentences of these spans."""
    at = [*sentences(text), len(text)]
    gone = np.zeros(len(at), bool)
    for i, j in spans:
        gone[i:j] = True
    gone[-1] = False
    keep = np.flatnonzero(~gone[:-1])
    kept = "".join(text[at[k] : at[k + 1]] for k in keep)
    return kept.rstrip() if len(keep) and gone[-2] else kept


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts, spans = batch.column("text"), batch.column("_spans").to_pylist()
        out, gone = texts.to_pylist(), [0] * batch.num_rows
        for k, marked in enumerate(spans):
            if marked and out[k]:
                before = len(out[k])
                out[k] = cut(out[k], [(x["i"], x["j"]) for x in marked])
                gone[k] = before - len(out[k])
        cols = [pa.array(out, texts.type) if c == "text" else pa.array(gone, pa.int64()) if c == "_spans" else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays(cols, ["n_removed" if c == "_spans" else c for c in names])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, any further columns) with repeated spans removed from ``text``, and
    ``n_removed``, the characters removed from it.

    Every row stays; a text that others cover wholly becomes empty. Null texts stay null. Rows
    without a doc_id are left alone and cover nothing. Rows that repeat a doc_id count as one
    document at the same positions, so exact repeats of a row stay alike. A span that a text repeats
    goes from its later places too. An empty table gives no rows. An extra column named _spans or
    n_removed gives way.
    """
    docs = without(docs, "_spans", "n_removed")
    spans = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(trimmed(_span_rows(min_words)), "doc_id bigint, h bigint, i int, j int, again boolean")
    with scratch() as made:
        marked = _marked(materialize(spans))
        release(docs.sparkSession, made, marked)
    rows, many = marked.agg(F.count("*"), F.coalesce(F.sum(F.size("_spans")), F.lit(0))).first()
    few = rows + many <= BROADCAST_ROWS
    joined = docs.join(F.broadcast(marked) if few else marked, "doc_id", "left").select(*[f"`{c}`" for c in docs.columns], "_spans")
    return joined.mapInArrow(trimmed(_cut_rows), schema_with(docs, "n_removed bigint"))


def _marked(spans: DataFrame) -> DataFrame:
    """The spans to remove of each document that has any, as a table."""
    first = materialize(spans.groupBy("h").agg(F.min("doc_id").alias("d0"), F.count("*").alias("c")).where("c > 1"))
    least = HOT_SHARE * (first.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0] or 0)
    # Hot spans are few: their rows are marked where they are and don't meet in one task.
    near = spans.join(F.broadcast(first.where(F.col("c") >= least + 2).select("h", "d0")), "h", "left")
    rest = near.where("d0 is null").drop("d0").join(first.where(F.col("c") < least + 2).select("h", "d0"), "h")
    marked = near.where("d0 is not null").unionByName(rest).where("doc_id != d0 or again")
    return materialize(marked.groupBy("doc_id").agg(F.collect_list(F.struct("i", "j")).alias("_spans")))


#: Least share of all repeated spans that a span has whose rows aren't shuffled to it.
HOT_SHARE = 1 / 65536
#: Marked documents and spans (8 bytes each) up to which the marks are broadcast to the texts.
BROADCAST_ROWS = 1_000_000
