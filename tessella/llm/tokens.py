"""Token ids of whole texts by the tokenizers library, with pieces between spaces looked up.

A byte-level BPE tokenizer whose split pattern never joins a character with a following space gives
the same ids for a text as for its pieces "word", " word", " word" one after another, as long as
each space stands alone between other characters. So each distinct piece is encoded once a worker,
and all pieces of a batch are looked up together by a 64-bit hash in an open-addressing table. Texts
with other runs of white space, or with one of the tokenizer's added tokens (``<|endoftext|>``, which
the library reads as one id), are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from tessella.llm.text import span_hashes

#: Distinct pieces that a worker holds; beyond that the first `KEPT`, which hold the common ones, stay.
CACHE, KEPT = 800_000, 400_000
#: Slots of the table, as a power of two.
SLOTS = 21
#: New pieces that are encoded as lines of one text.
LINES = 50
_FIRST = np.uint64(0xA24BAED4963EE407)
_RARE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BESIDE = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain(text: str, added: tuple[str, ...] = ()) -> bool:
    """Whether pieces between spaces can be encoded on their own."""
    return not any(x in text for x in (*_BESIDE, *added)) and (text.isascii() or not _RARE.search(text))


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        found = self.whole(["a\n b"])[0]
        self.line = found[1] if len(found) == 3 else None
        self.n, self.used = 0, 0
        self.flat = np.zeros(1 << 20, np.uint32)
        room = CACHE + (1 << 16)
        self.start, self.size, self.key = np.zeros(room, np.int32), np.zeros(room, np.int32), np.zeros(room, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        at, left = (keys >> np.uint64(64 - SLOTS)).astype(np.int64), np.arange(len(keys))
        while len(left):
            held, want = self.keys[at], keys[left]
            hit = held == want
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (held != 0)
            left, at = left[go], (at[go] + 1) & ((1 << SLOTS) - 1)
        return out

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Put distinct new keys into the table."""
        at, left = (keys >> np.uint64(64 - SLOTS)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]  # of several for one slot the last has it
            self.values[at[won]] = numbers[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << SLOTS) - 1)

    def _keep(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Number the keys of pieces whose ids lie one after another in ``ids``."""
        n, end = self.n, self.n + len(keys)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(len(ids) + len(self.flat) // 4, np.uint32))
        if end > len(self.start):
            self.start, self.size, self.key = (np.append(x, np.zeros(end - len(x) + (1 << 16), x.dtype)) for x in (self.start, self.size, self.key))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n:end] = self.used + np.cumsum(sizes) - sizes
        self.size[n:end], self.key[n:end] = sizes, keys
        self._insert(keys, np.arange(n, end))
        self.n, self.used = end, self.used + len(ids)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Encode new pieces, with the space before them. Those that begin with a space and have no
        line break are encoded as lines of a few texts, which costs half as much as a text each."""
        lined = [self.line is not None and len(x) > 1 and x[0] == " " and "\n" not in x for x in texts]
        lines, alone = [k for k, ok in enumerate(lined) if ok], [k for k, ok in enumerate(lined) if not ok]
        groups = [lines[k : k + LINES] for k in range(0, len(lines), LINES)]
        for group, found in zip(groups, self.whole(["\n".join([texts[k] for k in g]) for g in groups]), strict=True):
            ids = np.array(found, np.uint32)
            breaks = ids == self.line
            ends = np.append(np.flatnonzero(breaks), len(ids))
            if len(ends) == len(group):
                self._keep(keys[group], ids[~breaks], np.diff(ends, prepend=-1) - 1)
            else:
                alone += group
        if alone:
            found = self.whole([texts[k] for k in alone])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._keep(keys[alone], np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        if self.n > CACHE:
            self.n, self.used = KEPT, int(self.start[KEPT])
            self._clear()
            self._insert(self.key[:KEPT].copy(), np.arange(KEPT))
        easy = [bool(t) and plain(t, self.added) for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") for t, ok in zip(texts, easy, strict=True) if ok]
        hard = iter(self.whole([t for t, ok in zip(texts, easy, strict=True) if t and not ok]))
        if raw:
            whole = b" ".join(raw)  # what lies between its spaces are the pieces of all texts
            data = np.frombuffer(whole, np.uint8)
            spaces = np.flatnonzero(data == 32)
            begin, end = np.append(0, spaces + 1), np.append(spaces, len(data))
            first = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in raw)]))
            keys = span_hashes(data, begin, end, lower=False)
            keys[first[:-1]] ^= _FIRST
            keys[keys == 0] = 1
            numbers = self._find(keys)
            missing = np.flatnonzero(numbers < 0)
            if len(missing):
                new, at = np.unique(keys[missing], return_index=True)
                at = missing[at]
                lead = np.ones(len(keys), np.int64)
                lead[first[:-1]] = 0
                self._learn(new, [whole[a:b].decode("utf-8", "surrogatepass") for a, b in zip((begin[at] - lead[at]).tolist(), end[at].tolist(), strict=True)])
                numbers[missing] = self._find(keys[missing])
            sizes = self.size[numbers].astype(np.int64)
            after = np.cumsum(sizes)
            flat = self.flat[np.repeat(self.start[numbers] - after + sizes, sizes) + np.arange(int(after[-1]))]
            ends = np.append(0, after)[first]
        out, k = [], 0
        for t, ok in zip(texts, easy, strict=True):
            if ok:
                out.append(flat[ends[k] : ends[k + 1]])
                k += 1
            else:
                out.append(np.array(next(hard) if t else [], np.uint32))
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(path)
