"""Exact removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document
with a smaller id. Positions get names for their first 1, 2, 4, ... bytes: the name of
twice the length comes from the pair of names at a position and at a growing
offset. Names are content hashes instead of sort ranks, so they are equal across
documents without an exchange, and only two sorts are distributed: at half the
length and at the full length. Each drops the positions that are unique.

1. Half length, at sampled positions. Of the half-length strings within a string of full
   length, the ones with the smallest hash are anchors. Equal strings have equal
   anchors at equal places, so a string can only repeat if its anchors do. With the
   name goes that of the anchor's context, which holds every full-length string
   around it: where a smaller document has the same context, all of them repeat and
   the anchor is settled. Anchors that no other document has are dropped; the rest stay open.
2. Full length, at the positions around open anchors that no settled anchor covers.
   Of equal names all but those of the smallest document repeat.

Names travel packed, a row for each chunk of input and part of names; tasks sort
a part with numpy. Answers travel packed to home parts, where they meet the texts. Hot strings: a chunk sends only its smallest document of equal
contexts (or strings) and settles the others itself; anchors that a chunk itself finds in
several documents with different contexts are dealt by context, with one mark per chunk at their name.
A name has 64 bits and its part comes from an independent sum, so the number of
parts adds to the bits as data grow.

Edge cases: a null text is empty; texts below `LENGTH` bytes lose nothing; a null id
has no order: such rows lose nothing and take nothing from others; rows with one
id take nothing from each other; repeated rows get the same result; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, pieces
from tessera.session import stage

LENGTH = 50
PART_BYTES = 16 << 20
CHUNK = 1_000_000
PIECE = 512 << 10

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]
_R = np.random.default_rng(11)
_BYTE, _SUM = _R.integers(1, 1 << 63, 256, dtype=np.uint64), _R.integers(1, 1 << 63, 256, dtype=np.uint64)
_GAP = b"\xff"       # no byte of UTF-8


def names(b: np.ndarray, length: int) -> np.ndarray:
    """Name of the `length` bytes from each position on (the last length - 1 places mean nothing), by doubling."""
    run, have, out, done = _BYTE[b], 1, None, 0
    while True:
        if length & have:
            if out is None:
                out = run.copy()
            else:
                out ^= out >> np.uint64(29)
                out *= _M[0]
                out[:len(b) - done] += run[done:] * _M[1]
            done += have
        if done == length:
            break
        later = run[have:] * _M[2]
        run = run ^ run >> np.uint64(31)
        run *= _M[3]
        run[:len(b) - have] += later
        have *= 2
    out ^= out >> np.uint64(32)
    out *= _M[4]
    out ^= out >> np.uint64(29)
    return out


def longer(name: np.ndarray, at: np.ndarray, half: int, pieces_: int) -> np.ndarray:
    """Names of `pieces_` half lengths in a row from `at` on: a pair, for the full length, of names at a position and at an offset."""
    out = name[at]
    for i in range(1, pieces_):
        out = (out ^ out >> np.uint64(29)) * _M[0] + (name[at + i * half] ^ np.uint64(i)) * _M[1]
    out = (out ^ out >> np.uint64(32)) * _M[4]
    return out ^ out >> np.uint64(29)


def part_of(b: np.ndarray, length: int, at: np.ndarray, parts: int) -> np.ndarray:
    """Part of the strings at `at`, from a sum over their bytes that is independent of the names."""
    s = np.concatenate([[np.uint64(0)], np.cumsum(_SUM[b])])
    return _dealt(s[at + length] - s[at], parts)


def _dealt(x: np.ndarray, parts: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _M[4]
    return ((x ^ x >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _slide(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest (largest) of the `width` values from each position on; at the end, of those that are left."""
    have, op = 1, np.minimum if least else np.maximum
    while have < width:
        s = min(have, width - have)
        a = np.concatenate([op(a[:-s], a[s:]), a[-s:]]) if len(a) > s else a
        have += s
    return a


class Joined:
    """Texts in one array with gaps of half a length around each."""

    def __init__(self, texts: list[bytes], length: int):
        gap = _GAP * length
        self.lens = np.array([len(t) for t in texts], np.int64)
        self.starts = length + np.concatenate([[0], np.cumsum(self.lens + length)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        self.bytes = np.frombuffer(gap + gap.join(texts) + gap * 3, np.uint8)

    def starting(self, length: int) -> np.ndarray:
        """Whether a string of `length` bytes starts here within one text."""
        change = np.zeros(len(self.bytes) + 1, np.int8)
        long = self.lens >= length
        change[self.starts[long]] = 1
        change[(self.starts + self.lens - length + 1)[long]] -= 1
        return np.cumsum(change[:-1], dtype=np.int8).astype(bool)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def anchors(j: Joined, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors, and the half-length names everywhere."""
    half = length // 2
    name, width = names(j.bytes, half), length - half + 1
    value = np.maximum((name >> np.uint64(32)).astype(np.uint32), 1)
    value[~j.starting(half)] = 0xFFFFFFFF
    least = _slide(value, width, True)
    least[~j.starting(length)] = 0
    return np.flatnonzero(_slide(least[::-1], width, False)[::-1] == value), name


# ------------------------------------------------------------ packed entries

SETTLED, OPEN, STRING = 1, 2, 3         # states of a place in replies
_ROW = "part int, kind int, docs binary, rids binary, counts binary, low binary, high binary, names binary, contexts binary"
_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 7]


def _packed(part, kind, doc, rid, pos, key=None, context=None):
    """Rows of entries, one per part: documents as runs, places, names. Entries of one document come in a row."""
    order = np.argsort(part, kind="stable")
    part, doc, rid, pos = part[order], doc[order], rid[order], pos[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        d, r, p, s = doc[a:b], rid[a:b], pos[a:b], order[a:b]
        new = np.flatnonzero(_first(d, r))
        yield (int(part[a]), kind, d[new].astype("<i8").tobytes(), r[new].astype("<i8").tobytes(), np.diff(np.append(new, b - a)).astype("<u4").tobytes(),
               (p & 0xFFFF).astype("<u2").tobytes(), (p >> 16).astype("<u2").tobytes(), None if key is None else key[s].tobytes(), None if context is None else context[s].tobytes())


def _batch(rows):
    cols = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=[x.split()[0] for x in _ROW.split(", ")])


def _opened(rows, name_type):
    """Entries of packed rows: doc, rid, place, name, context."""
    def join(k, kind):
        return np.frombuffer(b"".join(r[k] or b"" for r in rows), kind)
    counts = join(4, "<u4")
    return np.repeat(join(2, "<i8"), counts), np.repeat(join(3, "<i8"), counts), join(5, "<u2").astype(np.int64) | join(6, "<u2").astype(np.int64) << 16, join(7, name_type), join(8, "<u8")


def _replies(doc, rid, pos, state, parts):
    """One row per home part of documents: their places and states."""
    order = np.lexsort((pos, doc, rid))
    doc, rid, pos, state = doc[order], rid[order], pos[order], state[order]
    return _batch(list(_packed(_dealt(rid.view(np.uint64), parts), 0, doc, rid, pos, state.astype("u1"))))


def _first(*columns):
    """Where a new group starts in sorted columns."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return change


def _of_group(values, new):
    return values[new][np.cumsum(new) - 1]


def _ordered(first, *rest):
    """Order by `first`, then by the others; they are looked at only where `first` is repeated."""
    o = np.argsort(first, kind="stable")
    same = first[o][1:] == first[o][:-1]
    tied = np.zeros(len(o), bool)
    tied[1:] |= same
    tied[:-1] |= same
    few = o[tied]
    o[tied] = few[np.lexsort((*reversed([c[few] for c in rest]), first[few]))]
    return o


class _Chunk:
    """Columns of entries gathered until there are enough to sort."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, *columns):
        self.parts.append(columns)
        self.n += len(columns[0])

    def take(self):
        out = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.n = [], 0
        return out


# ------------------------------------------------------------ half length

def _anchor_rows(chunk, parts):
    name, context, part, doc, rid, pos = chunk.take()
    o = _ordered(name, context, doc)
    of_name, of_class = _first(name[o]), _first(name[o], context[o])
    smallest, at = _of_group(doc[o], of_class), np.flatnonzero(of_name)
    many = (np.maximum.reduceat(smallest, at) != np.minimum.reduceat(smallest, at))[np.cumsum(of_name) - 1]
    repeat = doc[o] > smallest
    key = name.astype("<u4")
    i = np.sort(o[repeat])
    yield from _packed(_dealt(rid[i].view(np.uint64), parts), 9, doc[i], rid[i], pos[i])
    for kind, keep, to in ((0, ~repeat & ~many, part), (1, ~repeat & many, _dealt(context, parts)), (2, of_name & many, part)):
        i = np.sort(o[keep])
        yield from _packed(to[i], kind, doc[i], rid[i], pos[i], key[i], context[i] if kind < 2 else None)


def _send_anchors(parts: int, length: int):
    half = length // 2

    def run(batches):
        chunk = _Chunk()
        for whole in batches:
            for b in pieces(whole, "text", PIECE):
                j = Joined(as_bytes(b.column(2)), length)
                at, name = anchors(j, length)
                if len(at):
                    who = j.owner(at)
                    chunk.add(name[at], longer(name, at - half, half, 3), part_of(j.bytes, half, at, parts), b.column(0).to_numpy()[who], b.column(1).to_numpy()[who], at - j.starts[who])
                if chunk.n >= CHUNK:
                    yield _batch(list(_anchor_rows(chunk, parts)))
        if chunk.n:
            yield _batch(list(_anchor_rows(chunk, parts)))
    return run


def _settle_anchors(rows, parts):
    """Settled and open anchors of one part."""
    out = []
    marks = np.unique(np.concatenate([np.frombuffer(r[7], "<u4") for r in rows if r[1] == 2] or [np.zeros(0, "<u4")]))
    for kind in (0, 1):
        doc, rid, pos, key, context = _opened([r for r in rows if r[1] == kind], "<u4")
        o = _ordered(key, context, doc)
        doc, rid, pos, key, context = doc[o], rid[o], pos[o], key[o], context[o]
        of_key, of_class = _first(key), _first(key, context)
        repeat = doc > _of_group(doc, of_class)
        if kind == 0 and len(doc):
            at = np.flatnonzero(of_key)
            open_ = (np.add.reduceat(of_class, at, dtype=np.int64) > 1) & (np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at)) | np.isin(key[at], marks)
            open_ = open_[np.cumsum(of_key) - 1]
        else:
            open_ = np.ones(len(doc), bool)
        keep = repeat | open_
        out.append((doc[keep], rid[keep], pos[keep], np.where(repeat, SETTLED, OPEN)[keep]))
    doc, rid, pos, *_ = _opened([r for r in rows if r[1] == 9], "<u4")
    out.append((doc, rid, pos, np.full(len(doc), SETTLED)))
    return _replies(*(np.concatenate(c) for c in zip(*out, strict=True)), parts)


# ------------------------------------------------------------ full length

def _covered(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Which of n places lie from `before` before to `after` after one of the places `at`."""
    change = np.bincount(np.clip(at - before, 0, n), minlength=n + 1) - np.bincount(np.clip(at + after + 1, 0, n), minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


class _Home:
    """Replies for the documents of one home part."""

    def __init__(self, rows):
        doc, rid, self.pos, self.state, _ = _opened(rows, "u1")
        o = np.argsort(rid, kind="stable")
        self.doc, self.rid, self.pos, self.state = doc[o], rid[o], self.pos[o], self.state[o]

    def of(self, doc, rid):
        """Settled anchors, open anchors and repeated strings of a document."""
        a, b = np.searchsorted(self.rid, [rid, rid + 1]) if rid < (1 << 63) - 1 else (np.searchsorted(self.rid, rid), len(self.rid))
        own = self.doc[a:b] == doc if doc is not None else np.zeros(b - a, bool)
        pos, state = self.pos[a:b][own], self.state[a:b][own]
        return pos[state == SETTLED], pos[state == OPEN], pos[state == STRING]


_MEETING = "part int, kind int, doc_id long, rid long, text string, docs binary, rids binary, counts binary, low binary, high binary, names binary"


def _meet(docs: DataFrame, replies: DataFrame, parts: int) -> DataFrame:
    """Documents and the replies for them in home parts, replies first. A part holds bounded text, however many copies a document has."""
    none = {c: F.lit(None).cast(t) for c, t in (x.split() for x in _MEETING.split(", "))}
    r = replies.select("part", F.lit(0).alias("kind"), *[none[c].alias(c) for c in ("doc_id", "rid", "text")], "docs", "rids", "counts", "low", "high", "names")
    home = _home_of(F.col("rid"), parts)
    d = docs.select(home.alias("part"), F.lit(1).alias("kind"), "doc_id", "rid", "text", *[none[c].alias(c) for c in ("docs", "rids", "counts", "low", "high", "names")])
    return r.unionByName(d).repartition("part").sortWithinPartitions("part", "kind")


def _home_of(rid, parts: int):
    """Home part of a document, as `_dealt` gives it, by a small vectorised function."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def home(r: pd.Series) -> pd.Series:
        return pd.Series(_dealt(r.to_numpy(np.int64).view(np.uint64), parts))
    return home(rid)


def _documents(batches, limit: int):
    """Lists of (doc_id, rid, text, settled, open, strings), each with about `limit` bytes of text."""
    at, rows, home, out, size = None, [], None, [], 0
    for whole in batches:
        for b in pieces(whole, "text", limit):
            cols = [b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6, 7, 8, 9, 10)]
            for t, (part, kind, doc, rid, *packed) in zip(as_bytes(b.column(4)), zip(*cols, strict=True), strict=True):
                if part != at:
                    at, rows, home = part, [], None
                if kind == 0:
                    rows.append((part, kind, *packed, None))
                    continue
                if home is None:
                    home, rows = _Home(rows), []
                out.append((doc, rid, t, *home.of(doc, rid)))
                size += len(t)
                if size > limit:
                    yield out
                    out, size = [], 0
    if out:
        yield out


def _string_rows(chunk, parts):
    name, part, doc, rid, pos = chunk.take()
    o = _ordered(name, doc)
    repeat = np.zeros(len(o), bool)
    repeat[o] = doc[o] > _of_group(doc[o], _first(name[o]))
    i = np.flatnonzero(repeat)
    yield from _packed(_dealt(rid[i].view(np.uint64), parts), 9, doc[i], rid[i], pos[i])
    i = np.flatnonzero(~repeat)
    yield from _packed(part[i], 0, doc[i], rid[i], pos[i], name[i].astype("<u8"))


def _send_strings(parts: int, length: int):
    half = length // 2

    def run(batches):
        chunk = _Chunk()
        for docs in _documents(batches, PIECE):
            docs = [d for d in docs if len(d[4])]
            if not docs:
                continue
            j = Joined([d[2] for d in docs], length)
            wanted = np.zeros(len(j.bytes), bool)
            for s, (_, _, t, settled, open_, _) in zip(j.starts.tolist(), docs, strict=True):
                n = len(t) - length + 1
                wanted[s:s + n] = _covered(open_, length - half, 0, n) & ~_covered(settled, length - half, 0, n)
            at = np.flatnonzero(wanted)
            if len(at):
                who = j.owner(at)
                ids, rids = (np.array([d[k] for d in docs], np.int64)[who] for k in (0, 1))
                chunk.add(longer(names(j.bytes, half), at, half, 2), part_of(j.bytes, length, at, parts), ids, rids, at - j.starts[who])
            if chunk.n >= CHUNK:
                yield _batch(list(_string_rows(chunk, parts)))
        if chunk.n:
            yield _batch(list(_string_rows(chunk, parts)))
    return run


def _settle_strings(rows, parts):
    doc, rid, pos, name, _ = _opened([r for r in rows if r[1] == 0], "<u8")
    o = _ordered(name, doc)
    o = o[doc[o] > _of_group(doc[o], _first(name[o]))]
    d, r, p, *_ = _opened([x for x in rows if x[1] == 9], "<u8")
    doc, rid, pos = np.concatenate([doc[o], d]), np.concatenate([rid[o], r]), np.concatenate([pos[o], p])
    return _replies(doc, rid, pos, np.full(len(doc), STRING), parts)


# ------------------------------------------------------------ whole

def _by_part(settle, parts: int):
    def run(batches):
        at, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != at:
                    if held:
                        yield settle(held, parts)
                    at, held = row[0], []
                held.append(row)
        if held:
            yield settle(held, parts)
    return run


def _finish(length: int):
    around = length - length // 2

    def run(batches):
        for docs in _documents(batches, PIECE):
            out = []
            for doc, _, t, settled, _, strings in docs:
                n = len(t)
                starts = _covered(settled, around, 0, max(n - length + 1, 0)) | _covered(strings, 0, 0, max(n - length + 1, 0))
                gone = _covered(np.flatnonzero(starts), 0, length - 1, n)
                kept = t if not gone.any() else np.frombuffer(t, np.uint8)[~gone].tobytes()
                out.append((doc, n, int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


@contextmanager
def _shuffles_removed(spark):
    """Shuffle files of a stage go with its end: the stage table holds what is needed later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    own = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // PART_BYTES))

    def settled(sent, settle, name):
        return stage(sent.repartition("part").sortWithinPartitions("part").mapInArrow(_by_part(settle, parts), _ROW), name)
    with _shuffles_removed(spark):
        first = settled(own.select("doc_id", "rid", "text").mapInArrow(_send_anchors(parts, length), _ROW), _settle_anchors, "repeat-anchors")
        second = settled(_meet(own, first, parts).mapInArrow(_send_strings(parts, length), _ROW), _settle_strings, "repeat-strings")
    return _meet(rows, first.unionByName(second), parts).mapInArrow(_finish(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
