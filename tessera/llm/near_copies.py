"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Copies are searched by op8's method first: SimHash fingerprints, here of the 5-word shingles,
Hamming search in vantage-point trees over block shards. The links of `BITS` bits or fewer that
connect a group are candidates, and whole sets decide. A similarity of 0.8 is about ten bits,
give or take three, a radius at which no bits of two fingerprints need agree in a block worth
sharding by. So what lies further apart, or what is connected by candidates that are not alike,
is found by a prefix filter that follows; it passes over all that is connected by then.

No pair is missed. Shingles have one order for all documents, those that a sample
shows as common last. Of n shingles the first n - ceil(0.8 n) + 1 are sent; two
sets of similarity 0.8 share one of these (prefix filter) and differ in size by a
factor of 0.8 at most. Documents that meet at a shingle are a run. The smallest
set of each run is compared with the others, and what is alike is linked; so are those that come first in a few random orders of all nodes, which nearly always connects a
large group. In a second round, all pairs of a run that are not connected by then are compared; links within a group
would add nothing. So a large group of copies of each other costs its size, and unrelated
documents that share no rare shingle never meet. A run longer than `RUN` is cut into bands of
sizes, and every band meets itself and each band within reach.

Two sets are compared by their shapes first: counts of shingles by leading bits, a byte
for about four shingles. Sets of similarity 0.8 differ in a ninth of their joint size at most,
and shapes never differ by more than their sets. The whole sets of those left are made
anew from the texts and compared exactly.

Texts come in small batches and become shingles a megabyte at a time, so a worker's memory
depends on the longest text alone. Prefixes move packed, 20 bytes a shingle. Shuffle files and stage tables go as soon as
their last reader is done.

Equal sets are one node. Shingles and sets are 64-bit hashes, taken as equal strings.
The sample decides about speed only.

Edge cases: words are as in SimHash; a text of fewer words than a shingle is one
shingle; texts without words are copies of each other; rows of one id are one document;
rows without id take part and stay; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, pieces
from tessera.llm.sim_hash import components, links, majority
from tessera.session import batches_of, is_small, shuffles_removed, stage, unstage

SHINGLE = 5
SEED = 42
ALIKE, OF = 4, 5          # the similarity as a fraction: whole numbers only, so no pair is lost by rounding
BITS = 7                   # eight blocks of eight bits
SAMPLE_ROWS = 20_000
COMMON, MOST_COMMON = 4, 50_000
PART = 250_000             # shingles in a part, as expected
PIECE = 1 << 20            # bytes of text turned into shingles at once; the work takes sixteen times as much
BATCH_ROWS = 1_000         # rows sent to a worker at once
PACK = 500_000             # prefix shingles packed at once
KNOWN, LONG = 200_000, 32  # words remembered, and the bytes of the longest
RUN = 4_096
NEAREST = 4                # nearest sets of other groups that a set meets in each run before the last round
SMALL = 16 << 20
GIVEN = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_M_ORDERS = [np.uint64(x) for x in (0x51, 0xA2, 0xF3)]


class _Words(dict):
    """Hashes of words, each computed once while it is remembered; long words are not."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONG:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = h
        return h


def shingles(texts: list[bytes], known: _Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within a text, and the text of each."""
    known = _Words() if known is None else known
    words = [t.lower().split() for t in texts]
    lens = np.array([len(w) for w in words], dtype=np.int64)
    h = np.array([known[x] for w in words for x in w], dtype=np.uint64)
    own = np.repeat(np.arange(len(texts)), lens)
    g = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        g = (g ^ (g >> np.uint64(29))) * _M + h[i:i + len(g)]
    g = (g ^ (g >> np.uint64(32))) * _M
    whole = own[:len(g)] == own[SHINGLE - 1:] if len(g) else np.zeros(0, bool)
    short = np.flatnonzero((lens > 0) & (lens < SHINGLE))
    g = np.concatenate([g[whole], np.array([xxhash.xxh64_intdigest(b" ".join(words[i]), SEED + 1) for i in short], dtype=np.uint64)])
    own = np.concatenate([own[:len(whole)][whole], short])
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    return g[first], own[first]


def _cut(own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the texts in the table of shingles."""
    sizes = np.bincount(own, minlength=n).astype(np.int64)
    return np.cumsum(sizes) - sizes, sizes


def _nodes(g: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(g[a:a + n].tobytes(), SEED) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)], dtype=np.uint64).view(np.int64)


def shapes(g: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Counts of shingles by leading bits, up to 255: a power of two of them, at least a quarter of the shingles and 16."""
    out = []
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        bits = max(4, (n // 4).bit_length())
        out.append(np.minimum(np.bincount((g[a:a + n] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes())
    return out


def _folded(m: np.ndarray) -> np.ndarray:
    """Shapes of half the length."""
    return np.minimum(m[:, 0::2].astype(np.uint16) + m[:, 1::2], 255).astype(np.uint8)


def apart(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many shingles one set and others differ at least, by their shapes. Shapes of `others` are as long as `one` or twice that."""
    if others.shape[1] > len(one):
        others = _folded(others)
    return np.abs(others.astype(np.int16) - one.astype(np.int16)).sum(1, dtype=np.int64)


def may_be_alike(one: np.ndarray, n_one: int, others: np.ndarray, n_others: np.ndarray) -> np.ndarray:
    """Whether the shapes allow the similarity of one set and others."""
    return (OF + ALIKE) * apart(one, others) <= (OF - ALIKE) * (n_one + n_others)


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, row (the id, or a hash of the text), node, size (shingles), shape and fingerprint (bits) of every row."""
    def run(batches):
        known = _Words()
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                g, own = shingles(as_bytes(b.column(2)), known)
                starts, sizes = _cut(own, b.num_rows)
                bits = np.array([majority(g[a:a + n]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_nodes(g, starts, sizes)), pa.array(sizes), pa.array(shapes(g, starts, sizes), pa.binary()), pa.array(bits)],
                                                 names=["doc_id", "row", "node", "size", "shape", "bits"])
    return _rows(docs).mapInArrow(run, "doc_id long, row long, node long, size long, shape binary, bits long")


def sets(docs: DataFrame) -> DataFrame:
    """row and node of every row, and the shingles as bytes."""
    def run(batches):
        known = _Words()
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                g, own = shingles(as_bytes(b.column(1)), known)
                starts, sizes = _cut(own, b.num_rows)
                packed = [g[a:a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_nodes(g, starts, sizes)), pa.array(packed, pa.binary())], names=["row", "node", "grams"])
    return docs.select("row", "text").mapInArrow(run, "row long, node long, grams binary")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("row"), "text")


def common_shingles(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, ascending, and in how many."""
    def run(batches):
        known = _Words()
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(as_bytes(b.column(0)), known)[0].view(np.int64))], names=["gram"])
    part = docs.select("text").sample(min(1.0, SAMPLE_ROWS / max(1, rows)), 42)
    n = F.count(F.lit(1)).alias("n")
    found = part.mapInArrow(run, "gram long").groupBy("gram").agg(n).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "gram").limit(MOST_COMMON).collect()
    gram, n = np.array([r.gram for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(gram)
    return gram[order], n[order]


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """part and entries: shingles in the prefix of a text with its node and size, packed by the part of the shingle."""
    def run(batches):
        known, (grams, often) = _Words(), common
        held, n_texts, n_held = [], 0, 0
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                g, own = shingles(as_bytes(b.column(0)), known)
                starts, sizes = _cut(own, b.num_rows)
                node = _nodes(g, starts, sizes)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                    g = g[np.lexsort((np.where(grams[at] == g, often[at], 0), own))]
                keep = np.arange(len(g)) - starts[own] < (sizes - (ALIKE * sizes + OF - 1) // OF + 1)[own]
                held.append((g[keep], own[keep] + n_texts, node, sizes))
                n_texts, n_held = n_texts + b.num_rows, n_held + int(keep.sum()) + b.num_rows
                if n_held >= PACK:
                    yield packed(held)
                    held, n_texts, n_held = [], 0, 0
        if held:
            yield packed(held)

    def packed(held):
        g, own, node, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first = np.unique(node, return_index=True)
        keep = np.isin(own, first)              # equal sets are one node
        g, own = g[keep], own[keep]
        part = (g % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        g, own, part = g[order], own[order], part[order]
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
        blobs = [g[a:z].tobytes() + node[own[a:z]].tobytes() + sizes[own[a:z]].astype(np.uint32).tobytes() for a, z in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "entries"])
    return docs.select("text").mapInArrow(run, "part int, entries binary")


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    """Rows gram, node, size of packed entries, all as signed numbers."""
    n = [len(b) // 20 for b in blobs]
    gram = np.concatenate([np.frombuffer(b, np.int64, k) for b, k in zip(blobs, n, strict=True)])
    node = np.concatenate([np.frombuffer(b, np.int64, k, 8 * k) for b, k in zip(blobs, n, strict=True)])
    size = np.concatenate([np.frombuffer(b, np.uint32, k, 16 * k) for b, k in zip(blobs, n, strict=True)])
    return np.stack([gram, node, size.astype(np.int64)])


def _bands(nodes: np.ndarray, sizes: np.ndarray):
    """A run, or if it is long, every band of it alone and with each later band in reach. Ascending by size."""
    if len(nodes) <= RUN:
        yield nodes, sizes
        return
    cuts = [(a, min(a + RUN, len(nodes))) for a in range(0, len(nodes), RUN)]
    for i, (a, b) in enumerate(cuts):
        yield nodes[a:b], sizes[a:b]
        for c, d in cuts[i + 1:]:
            if ALIKE * sizes[c] > OF * sizes[b - 1]:
                break
            yield np.concatenate([nodes[a:b], nodes[c:d]]), np.concatenate([sizes[a:b], sizes[c:d]])


def runs(blobs: DataFrame) -> DataFrame:
    """run, nodes, sizes: the distinct lists of nodes that meet at a shingle, ascending by size and without gaps that part them."""
    kind = pa.list_(pa.int64())

    def lists(held):
        t = _unpacked(held)
        t = t[:, np.lexsort((t[1], t[2], t[0]))]
        new = np.ones(t.shape[1], bool)
        new[1:] = (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1])
        t = t[:, new]
        cut = np.flatnonzero((t[0][1:] != t[0][:-1]) | (OF * t[2][:-1] < ALIKE * t[2][1:])) + 1
        ends = np.concatenate([cut, [t.shape[1]]])
        firsts = np.concatenate([[0], cut])
        many, seen, out = np.flatnonzero(ends - firsts > 1), set(), []
        for a, b in zip(firsts[many].tolist(), ends[many].tolist(), strict=True):
            key = t[1][a:b].tobytes()
            key = xxhash.xxh64_intdigest(key, SEED)
            if key in seen:
                continue
            seen.add(key)
            for nodes, sizes in _bands(t[1][a:b], t[2][a:b]):
                out.append((xxhash.xxh64_intdigest(nodes.tobytes(), SEED), nodes, sizes))
                if len(out) >= 2000 or len(nodes) > 1000:
                    yield batch(out)
                    out = []
        yield batch(out)

    def batch(out):
        keys = np.array([k for k, _, _ in out], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x for _, x, _ in out], kind), pa.array([x for _, _, x in out], kind)], names=["run", "nodes", "sizes"])

    def run(batches):
        at, held = None, []
        for b in batches:
            for part, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != at and held:
                    yield from lists(held)
                    held = []
                at = part
                held.append(entries)
        if held:
            yield from lists(held)
    found = blobs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "run long, nodes array<long>, sizes array<long>")
    return found.dropDuplicates(["run"])


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (fp, head) whose shapes allow the similarity. fp has the larger set."""
    def run(batches):
        for b in batches:
            fp, head = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keep = np.zeros(b.num_rows, bool)
            for i, (one, n_one, other, n_other) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)):
                keep[i] = may_be_alike(np.frombuffer(one, np.uint8), n_one, np.frombuffer(other, np.uint8)[None], np.array([n_other]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array(head[keep])], names=["fp", "head"])
    one = nodes.select(F.col("node").alias("head"), F.col("shape").alias("one"), F.col("size").alias("n_one"))
    other = nodes.select(F.col("node").alias("fp"), F.col("shape").alias("other"), F.col("size").alias("n_other"))
    return pairs.join(one, "head").join(other, "fp").select("fp", "head", "one", "n_one", "other", "n_other").mapInArrow(run, "fp long, head long")


def alike(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (fp, head) whose whole sets have the similarity, as a stage table."""
    def run(batches):
        current, base = None, None
        for b in batches:
            out = []
            for head, fp, grams in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                g = np.frombuffer(grams, np.uint64)
                if fp is None:
                    current, base = head, g
                elif head == current:
                    both = len(np.intersect1d(base, g, assume_unique=True))
                    if OF * both >= ALIKE * (len(base) + len(g) - both):
                        out.append((fp, head))
            a, h = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(h, pa.int64())], names=["fp", "head"])
    ends = pairs.select(F.col("fp").alias("node")).unionByName(pairs.select(F.col("head").alias("node"))).distinct()
    wanted = stage(nodes.join(ends, "node", "left_semi").select("row", "node"), "copies-wanted")
    # texts stay in place where the wanted rows are few; beyond the bound they are joined by a shuffle
    few = is_small(wanted, SMALL)
    reach = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    rows = _rows(docs)
    own = sets(rows.join(reach(wanted.select("row").distinct()), "row", "left_semi"))
    own = stage(own.join(reach(wanted), ["row", "node"], "left_semi").dropDuplicates(["node"]).select("node", "grams"), "copies-sets")
    heads = pairs.select("head").distinct().select("head", F.lit(None).cast("long").alias("fp"), F.col("head").alias("node"))
    asked = heads.unionByName(pairs.select("head", "fp", F.col("fp").alias("node")))
    d = asked.join(own, "node").select("head", "fp", "grams")
    found = stage(d.repartition("head").sortWithinPartitions("head", F.asc_nulls_first("fp")).mapInArrow(run, "fp long, head long"), "copies-edges")
    unstage(wanted, own)
    return found


def _open_pairs(met: DataFrame, nearest: int | None = None) -> DataFrame:
    """Pairs of a run in different groups, fp the larger set, whose sizes and shapes allow the similarity; of each node all, or those with its nearest larger sets.

    Runs with one first node, in a random order of all nodes, lie together, and a pair that several of them hold is given once.
    """
    def run(batches):
        last, given = None, set()
        for b in batches:
            fps, heads = [], []
            for nodes, sizes, labels, shape, key in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if key != last:
                    last, given = key, set()
                nodes, sizes, labels = (np.array(x, np.int64) for x in (nodes, sizes, labels))
                order = np.lexsort((nodes, sizes))
                nodes, sizes, labels = nodes[order], sizes[order], labels[order]
                shape = [np.frombuffer(shape[k], np.uint8) for k in order]
                lengths = np.array([len(x) for x in shape])
                table = {n: np.stack([x for x in shape if len(x) == n]) for n in np.unique(lengths).tolist()}     # sets ascend, so shapes do
                first = {n: int(np.searchsorted(lengths, n)) for n in table}
                for i in range(len(nodes) - 1):
                    end, n = int(np.searchsorted(ALIKE * sizes, OF * sizes[i], "right")), int(lengths[i])
                    near, other = [], []
                    for m in (n, 2 * n):
                        if m in table:
                            a, z = max(i + 1, first[m]), min(end, first[m] + len(table[m]))
                            j = np.arange(a, z)[labels[a:z] != labels[i]] if a < z else np.zeros(0, np.int64)
                            if len(j):
                                d = apart(shape[i], table[m][j - first[m]])
                                fit = (OF + ALIKE) * d <= (OF - ALIKE) * (sizes[i] + sizes[j])
                                other.append(j[fit])
                                near.append((d / (sizes[i] + sizes[j]))[fit])
                    if other:
                        j = np.concatenate(other)
                        if nearest is not None:
                            j = j[np.argsort(np.concatenate(near), kind="stable")[:nearest]]
                        if len(given) > GIVEN:
                            given.clear()            # some pairs come again then; `distinct` below ends them
                        fresh = [k for k in j.tolist() if (nodes[i], nodes[k]) not in given]
                        given.update((nodes[i], nodes[k]) for k in fresh)
                        j = np.array(fresh, np.int64)
                        fps.append(nodes[j])
                        heads.append(np.full(len(j), nodes[i]))
                        if len(fps) > 5000:
                            yield pairs(fps, heads)
                            fps, heads = [], []
            yield pairs(fps, heads)

    def pairs(fps, heads):
        t = np.unique(np.stack([np.concatenate(fps), np.concatenate(heads)]), axis=1) if fps else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(t[0]), pa.array(t[1])], names=["fp", "head"])
    first = F.array_min(F.transform("nodes", lambda n: F.struct(F.xxhash64(n).alias("h"), n.alias("n"))))["n"]
    together = met.select("nodes", "sizes", "labels", "shapes", first.alias("key")).repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(run, "fp long, head long").distinct()


def _star_pairs(met: DataFrame) -> DataFrame:
    """In every run, each node with the smallest set and with the nodes that come first in a few random orders of all nodes: (fp, head), fp the larger set."""
    def run(batches):
        for b in batches:
            fps, heads = [], []
            for nodes, sizes in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                nodes, sizes = np.array(nodes, np.int64), np.array(sizes, np.int64)
                own = {0}                                   # nodes ascend by size
                for seed in _M_ORDERS:
                    x = (nodes.view(np.uint64) ^ seed) * _M
                    own.add(int(((x ^ x >> np.uint64(29)) * _M).argmin()))
                for i in own:
                    j = np.arange(len(nodes))
                    low, high = np.minimum(i, j), np.maximum(i, j)
                    fit = (j != i) & (ALIKE * sizes[high] <= OF * sizes[low])
                    fps.append(nodes[high[fit]])
                    heads.append(nodes[low[fit]])
            pairs = np.unique(np.stack([np.concatenate(fps), np.concatenate(heads)]), axis=1) if fps else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["fp", "head"])
    return met.select("nodes", "sizes").mapInArrow(run, "fp long, head long").distinct()


def _near_labels(edges: DataFrame, hops: int = 3) -> DataFrame:
    """node and the smallest node within a few links: nodes with one label are connected, though not all that are connected have one."""
    both = edges.select(F.col("fp").alias("a"), F.col("head").alias("b")).unionByName(edges.select(F.col("head").alias("a"), F.col("fp").alias("b")))
    label = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
    for _ in range(hops - 1):
        known = label.select(F.col("a").alias("b"), "label")
        label = both.join(known, "b").groupBy("a").agg(F.min("label").alias("label")).join(label.withColumnRenamed("label", "_own"), "a").select("a", F.least("label", "_own").alias("label"))
    return label.withColumnRenamed("a", "node")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs by fingerprint, fp the larger set, whose sizes allow the similarity: one set of each fingerprint with the others of it, and with those that links of `BITS` bits lead to."""
    own = F.struct("size", "node")
    firsts = stage(nodes.groupBy("bits").agg(F.min(own).alias("one")), "copies-firsts")
    same = nodes.select("bits", own.alias("other")).join(firsts, "bits").select("one", "other")
    a, b = firsts.select(F.col("bits").alias("fp"), F.col("one")), firsts.select(F.col("bits").alias("head"), F.col("one").alias("other"))
    near = links(firsts.select(F.col("bits").alias("fp")), BITS, trees=True).join(a, "fp").join(b, "head").select("one", "other")
    low, high = F.least("one", "other"), F.greatest("one", "other")
    fit = (F.col("one.node") != F.col("other.node")) & (ALIKE * high["size"] <= OF * low["size"])
    return same.unionByName(near).filter(fit).select(high["node"].alias("fp"), low["node"].alias("head")).distinct()


def _unconnected(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (fp, head) without one label."""
    a, b = groups.select(F.col("node").alias("fp"), F.col("label").alias("_a")), groups.select(F.col("node").alias("head"), F.col("label").alias("_b"))
    return pairs.join(a, "fp", "left").join(b, "head", "left").filter(F.coalesce("_a", "fp") != F.coalesce("_b", "head")).select("fp", "head")


def linked(docs: DataFrame, nodes: DataFrame, met: DataFrame) -> DataFrame:
    """node and label of the nodes that similarity connects with others: by fingerprints, then the rest by the runs of the prefix filter."""
    tested = stage(print_pairs(nodes), "copies-prints-met")
    pairs = stage(likely(tested, nodes), "copies-pairs")
    edges = alike(docs, pairs, nodes)
    unstage(pairs)
    groups = stage(_near_labels(edges), "copies-labels")
    stars = stage(_unconnected(_star_pairs(met), groups).join(tested, ["fp", "head"], "left_anti"), "copies-stars")
    pairs = stage(likely(stars, nodes), "copies-pairs")
    edges, tested = edges.unionByName(alike(docs, pairs, nodes)), tested.unionByName(stars)
    unstage(pairs, groups)
    for nearest in (NEAREST, None):
        groups = stage(_near_labels(edges), "copies-labels") if nearest else components(edges)
        each = met.filter(F.size("nodes") > 2).select("run", F.explode("nodes").alias("node")).join(groups, "node", "left").select("run", "node", F.coalesce("label", "node").alias("label"))
        split = each.groupBy("run").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a <> _b").select("run")
        each = each.join(split, "run", "left_semi").join(nodes.select("node", "size", "shape"), "node")
        open_runs = each.groupBy("run").agg(F.collect_list(F.struct("node", "size", "label", "shape")).alias("_x")).select(
            F.col("_x.node").alias("nodes"), F.col("_x.size").alias("sizes"), F.col("_x.label").alias("labels"), F.col("_x.shape").alias("shapes"))
        pairs = stage(_open_pairs(open_runs, nearest).join(tested, ["fp", "head"], "left_anti"), "copies-pairs")
        if pairs.isEmpty():
            continue
        more = alike(docs, pairs, nodes)
        if nearest is None and more.isEmpty():
            return groups
        edges, tested = edges.unionByName(more), tested.unionByName(pairs)
    return groups if nearest is None and pairs.isEmpty() else components(edges)


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The documents without those whose group has a smaller id. Rows of one id are one document; rows without id stay."""
    with shuffles_removed(docs.sparkSession), batches_of(docs.sparkSession, BATCH_ROWS):
        found = stage(prints(docs), "copies-prints")
        often = common_shingles(docs, found.count())
        sent = found.agg(F.sum(F.floor(F.col("size") * (OF - ALIKE) / OF) + 1)).first()[0] or 0
        nodes = stage(found.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("shape").alias("shape"), F.first("bits").alias("bits")), "copies-nodes")
        met = stage(runs(prefixes(docs, often, max(1, -(-sent // PART)))), "copies-runs")
        labels = linked(docs, nodes, met).withColumnRenamed("node", "_node")
        named = stage(nodes.join(labels, F.col("node") == F.col("_node"), "left").select("node", "first", F.coalesce("label", "node").alias("label")), "copies-groups")
        unstage(met, nodes)
        ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
        named = named.join(ids, "label").select(F.col("node").alias("_node"), "component_id")
        gone = stage(found.join(named, F.col("node") == F.col("_node")).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "copies-gone")
        unstage(found)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
