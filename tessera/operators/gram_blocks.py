"""Grams on their way to the tasks that count them, as compressed blocks.

A map task takes the documents a slice of tokens at a time, numbers the slice's words in order, and sorts its grams as numbers.
Equal grams of one group (source, side, tradition) become one entry with its uses and documents; a document is never cut, so documents
add up. Each gram has a part by a hash of its words, and the entries of a part travel as one block: the words used, then word numbers,
group, uses and documents as columns. A reduce task opens the blocks of one part at a time, numbers the words anew and adds up equal grams.
All entries of a gram meet in one part, so whatever is wanted per gram is made there.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera import fixed_values as V

SLICE = 800_000       # tokens that a map task holds at a time, or one document
GROUP = ("source", "side", "tradition", "source_tradition")
BLOCKS = "gram_part int, block binary"
ROWS = "gram string, source string, side string, tradition string, count long, docs long"
TOTALS = "gram string, count long, seeker long, church long, doc_freq long, n_sources long, top_source_share double"
TRADITIONS = "gram string, tradition string, count long, n_sources long, top_share double"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@contextmanager
def _lent():
    """Arrow takes memory from the C library, and what is free goes back to the system: Python workers live on between tasks."""
    before = pa.default_memory_pool()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        yield
    finally:
        pa.set_memory_pool(before)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


# ---------------------------------------------------------------- hashes
def _word_hashes(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words), dtype=np.uint64)


def _chain(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of the hashes of a gram's words."""
    h = np.zeros(len(hashes[0]), dtype=np.uint64)
    for x in hashes:
        h = (h ^ x) * _MIX
        h ^= h >> np.uint64(29)
    return h


def gram_hashes(batches):
    """Batches of `gram` -> one row of hashes each, as binary."""
    for batch in batches:
        split = [g.split(" ") for g in batch.column(0).to_pylist() if g is not None]
        words = sorted({w for s in split for w in s})
        at, of = {w: i for i, w in enumerate(words)}, _word_hashes(words)
        out = [_chain([of[[at[s[k]] for s in split if len(s) == n]] for k in range(n)]) for n in {len(s) for s in split}]
        yield pa.RecordBatch.from_pylist([{"hashes": np.concatenate(out).tobytes() if out else b""}], pa.schema([("hashes", pa.binary())]))


# ---------------------------------------------------------------- out: documents to blocks
def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones: the high ones are mostly alike."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _block(words: pa.Array, groups: list, columns: list[list]) -> bytes:
    """Columns of each n: numbers of the words, group, uses, documents."""
    text = words.cast(pa.binary())
    body, shape = [b"".join(text.to_pylist()), _planes(lengths := _narrow(pc.binary_length(text).to_numpy()))], []
    for arrays in columns:
        first = arrays[0].astype(np.int64)
        arrays = [_narrow(a) for a in (np.diff(first, prepend=0), *arrays[1:])]     # first words ascend
        shape.append([len(first), [a.itemsize for a in arrays]])
        body += [_planes(a) for a in arrays]
    head = json.dumps([groups, len(words), lengths.itemsize, len(body[0]), shape, sum(map(len, body))]).encode()
    return len(head).to_bytes(4, "little") + head + pa.Codec("zstd", compression_level=3).compress(b"".join(body), asbytes=True)


def _wide(body: bytes, rows: int, width: int, at: int) -> np.ndarray:
    x = np.frombuffer(body, np.uint8, rows * width, at).reshape(width, rows).T.copy().view(f"<u{width}").ravel()
    return x.astype(np.int32 if width < 4 else np.int64)


def _opened(block: bytes):
    n = int.from_bytes(block[:4], "little")
    groups, n_words, width, size, shape, total = json.loads(block[4:4 + n])
    body = pa.decompress(block[4 + n:], decompressed_size=total, codec="zstd", asbytes=True)
    offsets = np.concatenate(([0], np.cumsum(_wide(body, n_words, width, size)))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), n_words, [None, pa.py_buffer(offsets), pa.py_buffer(body[:size])])
    at, columns = size + n_words * width, []
    for rows, widths in shape:
        arrays = []
        for w in widths:
            arrays.append(_wide(body, rows, w, at))
            at += rows * w
        columns.append([np.cumsum(arrays[0], dtype=np.int64), *arrays[1:]])
    return words, groups, columns


def _numbered(x: np.ndarray) -> tuple[np.ndarray, int]:
    u, inverse = np.unique(x, return_inverse=True)
    return inverse.astype(np.int64), len(u)


def _key(numbers: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each row of word numbers below `size`, in their order."""
    key, most = numbers[0].astype(np.int64), size
    for x in numbers[1:]:
        if most * size >= 1 << 63:
            key, most = _numbered(key)
        key, most = key * size + x, most * size
    return key


def pack(max_n: int, content_only: bool, parts: int, wanted: np.ndarray | None, width: int):
    """Batches of the first `width` columns of GROUP and toks -> blocks. `wanted`: sorted hashes of the only grams to count."""
    stop = set(V.STOPWORDS)
    is_digits = lambda w: w.isascii() and w.isdigit()

    def of_slice(tables):
        group_of, ids, lengths, coded = {}, [], [], []
        while tables:       # texts are let go one batch after the other, numbers stay
            t = tables.pop(0)
            ids += [group_of.setdefault(g, len(group_of)) for g in zip(*[t.column(c).to_pylist() for c in range(width)])]
            lengths.append(t.column(width).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            coded.append(t.column(width).flatten().dictionary_encode())
            del t
        ids, names, lengths = np.array(ids, dtype=np.int32), list(group_of), np.concatenate(lengths)
        every = pa.chunked_array(coded).unify_dictionaries()
        terms = every.chunk(0).dictionary
        toks = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in every.chunks])
        del every, coded
        if not len(toks):
            return
        rank = pc.array_sort_indices(terms)
        terms = terms.take(rank)
        words = terms.to_pylist()
        place = np.empty(len(words), dtype=np.int32)
        place[rank.to_numpy()] = np.arange(len(words), dtype=np.int32)
        order = np.argsort(ids, kind="stable")      # documents of a group stand together
        begin, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
        ids, doc = ids[order], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        toks = place[toks[np.repeat((begin - (np.cumsum(lengths) - lengths)).astype(np.int32), lengths) + np.arange(len(doc), dtype=np.int32)]]
        hashes = _word_hashes(words)
        edge = np.array([w in stop for w in words])
        digits = np.array([is_digits(w) for w in words])
        entries = []
        for n in range(1, max_n + 1):
            if len(toks) < n:
                break
            at = np.flatnonzero(doc[:len(doc) - n + 1] == doc[n - 1:]).astype(np.int32)
            if content_only and n > 1:
                odd = np.ones(len(at), dtype=bool)
                for k in range(n):
                    odd &= digits[toks[at + k]]
                at = at[~(odd | edge[toks[at]] | edge[toks[at + n - 1]])]
            if wanted is not None and len(at):
                h = _chain([hashes[toks[at + k]] for k in range(n)])
                i = np.searchsorted(wanted, h)
                at = at[(i < len(wanted)) & (wanted[np.minimum(i, len(wanted) - 1)] == h)] if len(wanted) else at[:0]
            if not len(at):
                continue
            key = _key([toks[at + k] for k in range(n)], len(words))
            order = np.argsort(key, kind="stable")      # documents stay in order, and they are in order of their group
            key, at = key[order], at[order]
            del order
            d = doc[at]
            g = ids[d]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])))
            new_doc = new | np.concatenate(([True], d[1:] != d[:-1]))
            starts = np.flatnonzero(new)
            uses = np.diff(np.append(starts, len(key))).astype(np.int32)
            seen = np.add.reduceat(new_doc.astype(np.int32), starts)
            at, g = at[starts], g[starts]
            del key, d, new, new_doc, starts
            numbers = [toks[at + k] for k in range(n)]
            part = (_chain([hashes[x] for x in numbers]) >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(part.astype(np.uint32), kind="stable")
            part = part[order].astype(np.int64)
            entries.append(([x[order] for x in numbers], g[order], uses[order], seen[order], np.searchsorted(part, np.arange(parts + 1))))
        for p in range(parts):
            mine = [[a[cuts[p]:cuts[p + 1]] for a in (*numbers, g, uses, seen)] for numbers, g, uses, seen, cuts in entries]
            mine = [m for m in mine if len(m[0])]
            if not mine:
                continue
            used, inner = np.unique(np.concatenate([a for m in mine for a in m[:-3]]), return_inverse=True)
            gs, g_inner = np.unique(np.concatenate([m[-3] for m in mine]), return_inverse=True)
            columns, i, j = [], 0, 0
            for m in mine:
                rows, n = len(m[0]), len(m) - 3
                columns.append([*[inner[i + k * rows:i + (k + 1) * rows] for k in range(n)], g_inner[j:j + rows], *m[-2:]])
                i, j = i + rows * n, j + rows
            yield p, _block(terms.take(pa.array(used)), [names[x] for x in gs], columns)

    def run(batches):
        with _lent():
            yield from each(batches)

    def each(batches):
        def packed(tables):
            found = list(of_slice(tables))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["gram_part", "block"])
        held, tokens = [], 0
        for batch in batches:
            lengths = batch.column(width).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            begin = 0
            for i, n in enumerate(lengths.tolist()):
                if tokens and tokens + n > SLICE:
                    yield packed([*held, batch.slice(begin, i - begin)])
                    held, tokens, begin = [], 0, i
                tokens += n
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if tokens:
            yield packed(held)
    return run


# ---------------------------------------------------------------- in: blocks to rows
def _merged(blocks: list[bytes]):
    """The words and groups of the blocks, and one by one for each n (numbers, gram, its first row, group, uses, documents), equal grams of a
    group added up and in order of gram and group."""
    all_words, group_of, every, at = [], {}, {}, 0
    for block in blocks:
        words, groups, columns = _opened(block)
        all_words.append(words)
        own = np.array([group_of.setdefault(tuple(g), len(group_of)) for g in groups], dtype=np.int32)
        for arrays in columns:
            every.setdefault(len(arrays) - 3, []).append(([(a + at).astype(np.int32) for a in arrays[:-3]], own[arrays[-3]], *arrays[-2:]))
        at += len(words)
    coded = pa.concat_arrays(all_words).dictionary_encode()
    words, number = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False)

    def each():
        for n in sorted(every):
            numbers, *rest = zip(*every.pop(n))
            numbers = [number[np.concatenate(c)] for c in zip(*numbers)]
            g, uses, seen = [np.concatenate(c) for c in rest]
            key = _key(numbers, max(len(words), 1))
            order = np.lexsort((g, key))
            key, g = key[order], g[order]
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (g[1:] != g[:-1]))))
            first, key = order[starts], key[starts]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            add = lambda x: np.add.reduceat(x[order], starts, dtype=np.int64)
            yield [x[first] for x in numbers], np.cumsum(new) - 1, np.flatnonzero(new), g[starts], add(uses), add(seen)
    return words, each(), list(group_of)


def _text(words: pa.Array, numbers: list[np.ndarray], rows) -> pa.Array:
    each = [words.take(pa.array(x[rows])) for x in numbers]
    return each[0] if len(each) == 1 else pc.binary_join_element_wise(*each, " ")


def _coded(values: list) -> tuple[np.ndarray, list]:
    known: dict = {}
    return np.array([known.setdefault(v, len(known)) for v in values], dtype=np.int64), list(known)


def _sums(gram: np.ndarray, code: np.ndarray, uses: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram, code and uses, one row for each pair. `gram` ascends; `size` is above every code."""
    key = gram * size + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[starts] // size, key[starts] % size, np.add.reduceat(uses[order], starts)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def rows(words, n_grams, groups):
    for numbers, gram, first, g, uses, seen in n_grams:
        pick = lambda c: pa.array([x[c] for x in groups], pa.string()).take(pa.array(g))
        yield [_text(words, numbers, slice(None)), pick(0), pick(1), pick(2), pa.array(uses), pa.array(seen)]


def totals(words, n_grams, groups):
    source, _ = _coded([g[0] for g in groups])
    side = {s: np.array([g[1] == s for g in groups]) for s in ("seeker", "church")}
    for numbers, gram, first, g, uses, seen in n_grams:
        add = lambda x: np.add.reduceat(x, first)
        per, _, c = _sums(gram, source[g], uses, len(groups))
        cuts = _starts(per)
        count = add(uses)
        yield [_text(words, numbers, first), pa.array(count), pa.array(add(np.where(side["seeker"][g], uses, 0))), pa.array(add(np.where(side["church"][g], uses, 0))),
               pa.array(add(seen)), pa.array(np.diff(np.append(cuts, len(per)))), pa.array(np.maximum.reduceat(c, cuts) / count)]


def traditions(words, n_grams, groups):
    source, _ = _coded([g[0] for g in groups])
    of, names = _coded([g[3] for g in groups] + [g[2] for g in groups])
    of_source, of_doc = of[:len(groups)], of[len(groups):]
    home = np.zeros(len(groups), dtype=np.int64)
    home[source] = of_source        # one tradition for each source
    known = np.array([x is not None for x in names])
    church = np.array([g[1] == "church" for g in groups]) & known[of_doc]
    size = len(names)
    for numbers, gram, first, g, uses, seen in n_grams:
        here = church[g]
        a, a_of, a_uses = _sums(gram[here], of_doc[g[here]], uses[here], size) if here.any() else [np.empty(0, dtype=np.int64)] * 3
        s_gram, s_source, s_uses = _sums(gram, source[g], uses, len(groups))
        there = known[home[s_source]]
        s_gram, s_of, s_uses = s_gram[there], home[s_source[there]], s_uses[there]
        keys = np.unique(np.concatenate((a * size + a_of, s_gram * size + s_of)))
        if not len(keys):
            continue
        count, n, top, total = (np.zeros(len(keys), dtype=np.int64) for _ in range(4))
        count[np.searchsorted(keys, a * size + a_of)] = a_uses
        i = np.searchsorted(keys, s_gram * size + s_of)
        np.add.at(n, i, 1)
        np.add.at(total, i, s_uses)
        np.maximum.at(top, i, s_uses)
        share = np.where(total > 0, top / np.maximum(total, 1), 0.0)
        yield [_text(words, numbers, first[keys // size]), pa.array(names, pa.string()).take(pa.array(keys % size)), pa.array(count), pa.array(n), pa.array(share)]


def unpack(made, schema: str):
    """Blocks sorted by part -> rows of `made` (rows, totals, traditions)."""
    kind = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    names, types = zip(*[f.split() for f in schema.split(", ")])

    def run(batches):
        with _lent():
            yield from each(batches)

    def each(batches):
        def closed(blocks):
            for columns in made(*_merged(blocks)):
                whole = pa.RecordBatch.from_arrays([c.cast(kind[t]) for c, t in zip(columns, types)], names=list(names))
                for at in range(0, len(whole), 50_000):
                    yield whole.slice(at, 50_000)
        part, held = None, []
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part and held:
                    yield from closed(held)
                    held = []
                part = p
                held.append(b)
        if held:
            yield from closed(held)
    return run
