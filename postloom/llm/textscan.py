"""Words, lines and hashed n-grams of a batch of texts, found with array operations over the UTF-8 bytes.

A word is a maximal run of bytes other than the six ASCII white-space characters. Hashes are 64-bit: of a run of bytes a
polynomial over random byte values modulo 2**64, then mixed; of an n-gram a polynomial over its words' hashes, mixed again.
They are equal for equal content in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
VALUES_LOWER = VALUES[LOWER]
#: Texts are scanned in runs of about this many bytes, so that the arrays stay in the processor's cache and a worker stays small.
RUN_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """BASE ** i and its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, RUN_BYTES + 1)
            inverse = U(pow(int(BASE), -1, 2**64))
            self.up, self.down = (np.multiply.accumulate(np.concatenate(([U(1)], np.full(size - 1, b, np.uint64)))) for b in (BASE, inverse))
        return self.up[:n], self.down[: n + 1]


_powers = _Powers()


def forget() -> None:
    """Drop the table of powers if a long text made it large."""
    global _powers
    if len(_powers.up) > 2 * RUN_BYTES:
        _powers = _Powers()


class Scan:
    """data: the bytes of all texts; docs: where each text begins, and the end; starts, ends: of words; first: each
    document's first word, and the number of words."""

    def __init__(self, data: np.ndarray, docs: np.ndarray, lower: bool = False):
        self.data, self.docs, self.lower = data, docs, lower
        self.n_docs = len(docs) - 1
        self.space = IS_SPACE[data]
        self.starts, self.ends = self.runs(~self.space)
        self.first = np.searchsorted(self.starts, docs)
        self._sums = None

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes; a run ends with its document."""
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.docs] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines of all documents, empty ones too, and each document's first line."""
        breaks = np.flatnonzero(self.data == 10)
        n_before = np.searchsorted(breaks, self.docs)
        first = n_before + np.arange(self.n_docs + 1)
        starts = np.sort(np.concatenate((breaks + 1, self.docs[:-1])), kind="stable")
        ends = np.sort(np.concatenate((breaks, self.docs[1:])), kind="stable")
        # a document that begins at a break's end, or ends at a break, sorts next to it; both orders give the same pairs
        return starts, ends, first

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = _powers.get(len(self.data))
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((VALUES_LOWER if self.lower else VALUES)[self.data] * up, out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def grams(self, n: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and first word (counted over all documents) of every n-gram within a document."""
        words = self.words() if words is None else words
        w = len(words)
        if w < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        docs = self.word_docs()
        x = words[: w - n + 1].copy()
        for k in range(1, n):
            x *= BASE
            x += words[k : w - n + 1 + k]
        at = np.flatnonzero(docs[: w - n + 1] == docs[n - 1 :])
        return mix(x[at]), docs[at], at

    def per_doc(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each document are marked."""
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return np.diff(sums[self.docs])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def distinct(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents and hashes of the distinct pairs, in order, how often each occurs, and the pair of each input."""
    order = np.lexsort((hashes, docs))
    d, h = docs[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    pair = np.empty(len(d), np.int64)
    pair[order] = np.cumsum(new) - 1
    return d[at], h[at], np.diff(np.append(at, len(d))), pair


def column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def scans(texts: pa.Array, lower: bool = False, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, Scan]]:
    """Scans of consecutive texts [from, to), of about run_bytes each; a longer text is scanned alone and whole."""
    if not len(texts):
        return
    data, offsets = column(texts)
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + run_bytes, "right")) - 1)
        yield a, b, Scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        a = b
