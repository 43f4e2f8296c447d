"""Packing token sequences by sum-of-squares online packing.

Every partition packs its documents as they come. A document's full windows are cut off first; its tail is placed into the
fill level that leaves the smallest sum of squared counts of partially filled windows, with the counts kept in an array by
level. A level is a range of fills, so that windows meet on few levels and close often: a window within the last level is
topped up with the first ids of a document that comes later, and is full then. What is partially filled when the documents
end, at most a few windows a level, is joined end to end and cut, so a partition leaves at most one window that is not full.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from postloom.llm.common import documents, released, text_of
from postloom.llm.textscan import Scan, U, scans
from postloom.session import ship

WINDOW, END_ID = 4096, 2
#: Fill levels of a window. With fewer of them windows close sooner and are topped up by longer pieces. At the end of a
#: partition some LEVELS windows are open, so one should fill at least ten times as many (MIN_TASK_TOKENS of them).
LEVELS = 8
MIN_TASK_TOKENS = 10 * LEVELS * WINDOW
#: Entries of a generation of an encoder's memory, each some 20 bytes and its ids, and ids of one.
MEMORY_WORDS, MEMORY_IDS = 250_000, 1_500_000
#: Bytes of text that are encoded at once: words that repeat within them are looked up once.
ENCODED_BYTES = 1 << 19
#: Sequences of one partition are numbered from the partition's number times this.
PER_PARTITION = 1 << 32


class Table:
    """Ids by 64-bit key: sorted keys with the place and number of each one's ids, and what was added lately beside them."""

    def __init__(self):
        self.parts = [(np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int32))] * 2  # old keys, late keys
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return sum(len(keys) for keys, *_ in self.parts)

    def find(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Fills in places and numbers of the keys that are here, and tells which are."""
        known = np.zeros(len(keys), bool)
        for own, places, numbers in self.parts:
            if len(own):
                k = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[k] == keys
                at[hit], n[hit] = places[k[hit]], numbers[k[hit]]
                known |= hit
        return known

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Adds keys that are not here, with their ids one after another; the places given to them."""
        if self.used + len(ids) > len(self.ids):
            grown = np.empty(max(2 * len(self.ids), self.used + len(ids)), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(n) - n
        self.used += len(ids)
        late = tuple(np.concatenate(x) for x in zip(self.parts[1], (keys, at, n.astype(np.int32)), strict=True))
        if len(late[0]) > 1 << 15:
            late = tuple(np.concatenate(x) for x in zip(self.parts[0], late, strict=True))
            order = np.argsort(late[0], kind="stable")
            self.parts = [tuple(x[order] for x in late), tuple(x[:0] for x in late)]
        else:
            order = np.argsort(late[0], kind="stable")
            self.parts = [self.parts[0], tuple(x[order] for x in late)]
        return at


class Memory:
    """Ids of words by the words' hashes, in two generations: when the young one is full it becomes the old one, and what is
    used again is kept."""

    def __init__(self, words: int = MEMORY_WORDS, ids: int = MEMORY_IDS):
        self.words, self.most_ids = words, ids
        self.clear()

    def clear(self) -> None:
        self.young, self.old = Table(), Table()

    def look_up(self, keys: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """Places in self.young.ids and numbers of ids of distinct keys; learn gives ids and their numbers for those, by
        their positions in keys, that are not known."""
        if len(self.young) > self.words or self.young.used > self.most_ids:
            self.young, self.old = Table(), self.young
        at, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        new = np.flatnonzero(~self.young.find(keys, at, n))
        old_at, old_n = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        kept = self.old.find(keys[new], old_at, old_n)
        again = new[kept]
        if len(again):
            at[again], n[again] = self.young.add(keys[again], take(self.old.ids, old_at[kept], old_n[kept]), old_n[kept]), old_n[kept]
        new = new[~kept]
        if len(new):
            ids, counts = learn(new)
            at[new], n[new] = self.young.add(keys[new], ids, counts), counts
        return at, n


def take(ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at these places, one after another."""
    ends = np.cumsum(n)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + n, n)]


def _ascii(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


LETTERS = _ascii(bytes(range(65, 91)) + bytes(range(97, 123)))
MARKS = b".,;:!?"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    A vocabulary that puts texts in lower case, drops white space and ends words with a suffix (see wordwise) is applied word
    by word: its pieces never cross ASCII white space, so a text's ids are those of its words in turn. Words are found and
    hashed as arrays; the ids of known words come from a memory by hash. A word of ASCII letters, with one mark after it or
    without, is known by its letters in lower case. Of new words in Latin-1, where lower case does not depend on what stands
    around, letters go straight to the vocabulary's merges, many at a time. Other words keep all steps, and are told apart by
    a special token between them. Any other vocabulary encodes whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        self.wordwise = kinds == ["NFC", "Replace", "Lowercase"] and form["model"].get("end_of_word_suffix") == "</w>"
        self.memory = Memory()
        if not self.wordwise:
            return
        self.mark = form["added_tokens"][0]["content"]
        self.mark_id = form["added_tokens"][0]["id"]
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        own = {c: self.plain(chr(c)) for c in MARKS}
        self.mark_ids = {c: ids for c, ids in own.items() if len(ids) == 1}
        self.is_mark, self.id_of_mark = np.zeros(256, bool), np.zeros(256, np.uint32)
        for c, ids in self.mark_ids.items():
            self.is_mark[c], self.id_of_mark[c] = True, ids[0]

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_apart(self, words: list[str], tokenizer: Tokenizer, between: str, cut) -> list[np.ndarray]:
        """Ids of words that are joined by a separator; cut gives the end of each word's ids and where the next begins."""
        out = []
        for i in range(0, len(words), 256):
            part = words[i : i + 256]
            ids = np.array(tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops, starts = cut(ids)
            if len(stops) != len(part):
                raise AssertionError("the words cannot be told apart")
            out += [ids[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        return out

    def at_marks(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(ids == self.mark_id)
        return np.append(cuts, len(ids)), np.concatenate(([0], cuts + 1))

    def at_word_ends(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stops = np.flatnonzero(self.ends[ids]) + 1
        return stops, np.concatenate(([0], stops[:-1]))

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and their numbers."""
        found: list[np.ndarray | None] = [None] * len(words)
        letters, others = {}, {}  # of each stem, the words that have it
        for k, w in enumerate(words):
            if "<|" in w:  # may hold a special token
                found[k] = self.plain(w)
                continue
            stem = w
            if max(w) <= "\xff":
                stem = w.lower()
                if ord(stem[-1]) in self.mark_ids and stem[:-1].isalpha():
                    stem = stem[:-1]
                (letters if stem.isalpha() else others).setdefault(stem, []).append(k)
            else:
                others.setdefault(stem, []).append(k)
        for stems, tokenizer, between, cut in ((letters, self.letters, " ", self.at_word_ends), (others, self.tokenizer, self.mark, self.at_marks)):
            for at, ids in zip(stems.values(), self.encode_apart(list(stems), tokenizer, between, cut), strict=True):
                for k in at:
                    found[k] = ids
        for k, w in enumerate(words):
            if "<|" not in w and ord(w[-1]) in self.mark_ids and len(w) > 1 and max(w) <= "\xff" and w[:-1].lower().isalpha():
                found[k] = np.append(found[k], self.mark_ids[ord(w[-1])])
        counts = np.array([len(ids) for ids in found], np.int64)
        return np.concatenate(found), counts

    def forget(self) -> None:
        self.memory.clear()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; null is empty."""
        if not self.wordwise:
            for x in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False):
                yield np.array(x.ids, "<u4").tobytes()
            return
        for _, _, scan in scans(texts, run_bytes=ENCODED_BYTES):
            raw, first = self.encode_words(scan)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                yield raw[4 * a : 4 * b]

    def encode_words(self, scan: Scan) -> tuple[bytes, np.ndarray]:
        """The ids of all words of a scan, and where each document's begin."""
        starts, ends, last = scan.starts, scan.ends, scan.data[scan.ends - 1]
        marked = self.is_mark[last] & (ends - starts > 1)
        stops = ends - marked
        letters = np.zeros(len(scan.data) + 1, np.int32)
        np.cumsum(LETTERS[scan.data], out=letters[1:])
        simple = letters[stops] - letters[starts] == stops - starts
        marked &= simple
        keys = scan.words()
        lower = Scan.__new__(Scan)
        lower.data, lower.lower, lower._sums = scan.data, True, None
        keys[simple] = lower.span_hash(starts[simple], stops[simple])
        keys[~simple] ^= U(0x5851F42D4C957F2D)  # a word that is no letters alone is not taken for one
        distinct, first, word = np.unique(keys, return_index=True, return_inverse=True)

        def learn(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, is_simple = first[new], simple[first[new]]
            to = np.where(is_simple, stops[at], ends[at])
            return self.ids_of([str(scan.data[a:b], "utf-8") if not low else str(scan.data[a:b], "ascii").lower() for a, b, low in zip(starts[at].tolist(), to.tolist(), is_simple.tolist(), strict=True)])

        at, n = self.memory.look_up(distinct, learn)
        own = n[word]
        begin = np.concatenate(([0], np.cumsum(own + marked)))
        ids = np.empty(begin[-1], np.uint32)
        run = np.concatenate(([0], np.cumsum(own)))
        step = np.arange(run[-1])
        ids[step + np.repeat(begin[:-1] - run[:-1], own)] = self.memory.young.ids[step + np.repeat(at[word] - run[:-1], own)]
        ids[(begin[1:] - 1)[marked]] = self.id_of_mark[last[marked]]
        return ids.astype("<u4", copy=False).tobytes(), begin[scan.first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """The partially filled windows of one partition, each a list of (item, start, length); items are any values.

    A window's level is its fill in steps of window / levels, rounded up, so that what its level leaves free is free. A
    window on the last level waits in `closing` for the ids that make it full.
    """

    def __init__(self, window: int = WINDOW, levels: int = LEVELS):
        self.window, self.levels = window, max(1, min(levels, window))
        self.counts = np.zeros(self.levels + 1, np.int64)  # of windows by level; 0 and the last level stay 0
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(self.levels)]
        self.closing: list[tuple[int, list]] = []  # (free, pieces)

    def steps(self, size: int) -> int:
        return -(-size * self.levels // self.window)

    def level(self, steps: int) -> int:
        """The level to place so many steps on: moving a window from level h to h + steps changes the sum of squares by
        2 * (counts[h + steps] - counts[h]) + 2, a new window by 2 * counts[steps] + 1, a window that comes to the last
        level by -2 * counts[h] + 1. Ties go to the fullest window."""
        top = self.levels - steps
        cost = 2 * (self.counts[steps:] - self.counts[: top + 1]) + 2
        cost[self.counts[: top + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * self.counts[steps] + 1 if top else 0
        if top and self.counts[top]:
            cost[top] = 1 - 2 * self.counts[top]
        return int(top - np.argmin(cost[::-1]))

    def add(self, item, start: int, size: int) -> Iterator[list]:
        """Place a piece shorter than the window; the pieces of a window that is full now. Of a piece that reaches over
        what a closing window has free, the first ids go there."""
        if self.closing:
            free, pieces = self.closing.pop()
            part = min(free, size)
            pieces.append((item, start, part))
            start, size, free = start + part, size - part, free - part
            if free:
                self.closing.append((free, pieces))
            else:
                yield pieces
            if not size:
                return
        steps = self.steps(size)
        h = self.level(steps)
        fill, pieces = 0, []
        if h:
            fill, pieces = self.open[h].pop()
            self.counts[h] -= 1
        pieces.append((item, start, size))
        fill += size
        at = self.steps(fill)
        if fill == self.window:
            yield pieces
        elif at == self.levels:
            self.closing.append((self.window - fill, pieces))
        else:
            self.open[at].append((fill, pieces))
            self.counts[at] += 1

    def flush(self) -> Iterator[list]:
        """The partially filled windows, joined and cut into full ones and at most one that is not."""
        window, used = [], 0
        left = [pieces for _, pieces in self.closing] + [pieces for held in reversed(self.open) for _, pieces in held]
        for pieces in left:
            for item, start, length in pieces:
                while length:
                    part = min(length, self.window - used)
                    window.append((item, start, part))
                    start, length, used = start + part, length - part, used + part
                    if used == self.window:
                        yield window
                        window, used = [], 0
        if window:
            yield window
        self.__init__(self.window, self.levels)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, levels: int = LEVELS, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, made_by, row_id.

    A document's tokens are its text's ids and END_ID; null text counts as empty and has END_ID alone. Every token is in
    exactly one piece; a sequence's pieces are gapless from offset 0 and fill it, but for the last sequence of a partition.
    Documents are packed where they lie, without a shuffle; sequence_id is unique and rises from the partition's number times
    PER_PARTITION. made_by tells how the sequence was filled: "document" (cut from one document), "levels" or, for what a
    partition had open at its end, "rest". A partition of fewer than MIN_TASK_TOKENS tokens has many of the last kind, which
    only means more cuts. Rows that repeat an identifier are packed each for itself; row_id tells them apart. An empty table gives no rows; other columns are
    ignored. tokenizer: the vocabulary file's path on every executor.
    """
    ship(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row_id"))
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "made_by", "row_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, out, number, part, size, id_type = encoder(path), Packer(window, levels), [], 0, 0, 0, pa.null()

        def emit(pieces: list, made_by: str) -> None:
            nonlocal number, size
            offset = 0
            for (doc_id, raw, base, tokens, row_id), start, length in pieces:
                out.append((doc_id, start, length, raw[4 * (start - base) : 4 * (start - base + length)], tokens, part * PER_PARTITION + number, offset, made_by, row_id))
                offset += length
                size += length
            number += 1

        def drain() -> pa.RecordBatch:
            nonlocal size
            cols = list(zip(*out, strict=True))
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            out.clear()
            size = 0
            return batch

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            if len(batch):
                part = batch.column("part")[0].as_py()
            for doc_id, row_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("row_id").to_pylist(), own.encode(batch.column("text")), strict=True):
                raw += END_ID.to_bytes(4, "little")
                n = len(raw) // 4
                base = n - n % window
                for start in range(0, base, window):
                    emit([((doc_id, raw, 0, n, row_id), start, window)], "document")
                if n > base:  # only the tail's ids are held while its window is open
                    for full in packer.add((doc_id, raw[4 * base :], base, n, row_id), base, n - base):
                        emit(full, "levels")
                if size >= 1 << 20:
                    yield drain()
        own.forget()
        for pieces in packer.flush():
            emit(pieces, "rest")
        if out:
            yield drain()

    return rows.mapInArrow(released(run), f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, made_by string, row_id bigint")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(documents(spark, sf_dir)))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "made_by", "row_id")


QUERIES = {"op5_packing": op5_packing}
ORACLES = {}
