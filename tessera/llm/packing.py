"""Packing documents into windows of tokens: best-fit decreasing over a segment tree.

A document is its tokens and one end mark. Documents longer than a window are first
cut into full windows; the rest of each is a piece. Pieces are dealt into groups of
a fixed expected size, `GROUP` tokens, and every group is packed by itself: longest
piece first, each into the open window with the least room that still takes it. A
segment tree indexed by the room left finds that window. A group leaves about one
window with padding, whatever the size of the corpus.

A text is read once, where it lies: token numbers never move, only the lengths and
checksums of the pieces do. Words between ASCII white space are tokenized by
themselves, each spelling once per worker, which gives the tokens of the whole text
because this tokenizer drops white space and never joins over it. Neither does it join a
letter or digit with the punctuation after it, so `word` and `word.` share the tokens of `word`.
New words go to the tokenizer many in one string, with a number sign between them that is one
token and stands for nothing else. ASCII letters are
lower-cased before that, as the tokenizer does, unless the text holds combining marks.

Edge cases: a null or empty text is the end mark alone; rows of one id are documents of
their own, told apart by `sequence_id` and `offset`; a null id is an id; control strings
of the tokenizer in a text are ordinary text; an empty table gives no rows; other columns
are not read. An overlong word is tokenized whole and not remembered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, pieces
from tessera.session import stage

WINDOW = 4096
END_MARK = 2
GROUP = 1 << 22
PIECE_SHARE = 64        # a piece counts as this many tokens at least, so that very short pieces don't swell a group
REMEMBERED, LONGEST = 600_000, 64
AT_HAND = 1 << 20       # bytes of text whose words are looked up together
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GAP, AT_ONCE = "\u00bd", 1000     # a sign of Unicode class N is always a piece by itself
_WIDTH = 4

_TOKENIZERS: dict = {}


class Words:
    """Token numbers of words as packed unsigned 32-bit numbers, each word tokenized once per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}         # remembered before `known` was full
        (self.gap,) = self.tokenizer.encode(GAP, add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str) -> Words:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task owns one core
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def _tokens(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Packed token numbers of every word, by the tokenizer."""
        out, alone = {}, [w for w in words if GAP.encode() in w]
        words = [w for w in words if GAP.encode() not in w] if alone else words
        for w, e in zip(alone, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in alone], add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, "<u4").tobytes()
        gap = f" {GAP} ".encode()
        for i in range(0, len(words), AT_ONCE):
            some = words[i:i + AT_ONCE]
            (e,) = self.tokenizer.encode_batch_fast([gap.join(some).decode("utf-8", "replace")], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            at, packed = np.flatnonzero(ids == self.gap) * _WIDTH, ids.tobytes()
            out.update(zip(some, (packed[a:z] for a, z in zip([0, *(at + _WIDTH).tolist()], [*at.tolist(), len(packed)], strict=True)), strict=True))
        return out

    def _fresh(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Packed token numbers of words not in `known`; they are remembered there."""
        fresh = {w: self.older[w] for w in new if w in self.older}
        # an ASCII letter or digit, then marks alone
        stems = {w: stem for w in new if w not in fresh and (stem := w.rstrip(MARKS))[-1:].isalnum() and len(stem) < len(w)}
        own = {*stems.values(), *(w[len(stem):] for w, stem in stems.items())}
        parts = {w: self.known[w] for w in own if w in self.known}
        own.update(w for w in new if w not in fresh and w not in stems)
        parts.update(self._tokens([w for w in own if w not in parts]))
        for w in new:
            if w not in fresh:
                fresh[w] = parts[stems[w]] + parts[w[len(stems[w]):]] if w in stems else parts[w]
        for some in (parts, fresh):
            self.known.update((w, v) for w, v in some.items() if len(w) <= LONGEST)
        return fresh

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Packed token numbers of every text, without end mark."""
        split = [(t if b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        found = [list(map(self.known.get, words)) for words in split]
        gaps = [[i for i, v in enumerate(f) if v is None] for f in found]
        fresh = self._fresh({words[i] for words, gap in zip(split, gaps, strict=True) for i in gap})
        for words, f, gap in zip(split, found, gaps, strict=True):
            for i in gap:
                f[i] = fresh[words[i]]
            yield b"".join(f)


def cut_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_mark: int = END_MARK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and part and nr, which tell all pieces apart."""
    mark = np.array([end_mark], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nr"]

    def run(batches):
        words, part, nr = Words.of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in pieces(batch, "text", AT_HAND):
                rows = []
                for doc, ids in zip(b.column(0).to_pylist(), words.encode(as_bytes(b.column(1))), strict=True):
                    ids = memoryview(ids + mark)
                    total = len(ids) // _WIDTH
                    for start in range(0, total, window):
                        piece = ids[start * _WIDTH:(start + window) * _WIDTH]
                        rows.append((doc, start, len(piece) // _WIDTH, zlib.crc32(piece), total, part, nr))
                        nr += 1
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, ", ".join(f"{n} long" for n in names)))


class OpenWindows:
    """Windows by the room left in them: a segment tree over 0..window that counts the open windows below each node."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, name: int) -> None:
        self.at[room].append(name)
        self._add(room, 1)

    def tightest(self, need: int) -> int | None:
        """The least room of at least `need` among open windows."""
        i, count = need + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not count[i]:
                    i += 1
        return i - self.leaves

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.at[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of every piece; lengths in descending order."""
    open_windows, n, into, offsets = OpenWindows(window), 0, [], []
    for length in lengths:
        room = open_windows.tightest(length)
        if room is None:
            name, room, n = n, window, n + 1
        else:
            name = open_windows.take(room)
        into.append(name)
        offsets.append(window - room)
        if room > length:
            open_windows.put(room - length, name)
    return into, offsets


def packed(cut: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        current, held = None, []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            into, offsets = best_fit(t.column("length").to_pylist(), window)
            ids = np.array(into, np.int64) + (current << 32)
            out = pa.table({**{n: t.column(n) for n in names}, "sequence_id": ids, "offset": pa.array(offsets, pa.int64())})
            held.clear()
            return out.to_batches()
        for b in batches:
            g = b.column(0).to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else []
            first = 0
            for end in ends:
                if held and g[first] != current:
                    yield from flush()
                current = int(g[first])
                held.append(b.slice(first, end - first))
                first = end
        if held:
            yield from flush()
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("part", "nr"), F.lit(groups)))
    ordered = dealt.select("group", *names, "part", "nr").repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "start", "part", "nr")
    return ordered.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "sequence_id", "offset"]))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_mark: int = END_MARK, group: int = GROUP) -> DataFrame:
    """Every piece of every document with its place: sequence_id, and the tokens before it there as offset."""
    cut = stage(cut_pieces(docs, path, window, end_mark), "pack-pieces")
    weight = cut.agg(F.sum(F.greatest(F.col("length"), F.lit(PIECE_SHARE)))).first()[0] or 0
    return packed(cut, max(1, -(-weight // group)), window)
