"""SimHash near-duplicates: exact Hamming search in vantage-point trees.

Fingerprints are 64 majority bits over the XXH64 values of 4-word shingles.
Equal fingerprints are one node. Two fingerprints that differ in at most r bits
agree on at least one of r + 1 blocks of bits, that is, their block distance is
0: a shard holds the fingerprints of one block value. A larger shard is cut around a
vantage point: with bound m, fingerprints at distance up to m + r from the vantage point go
inside and those beyond m go outside. By the triangle inequality a pair within
r bits meets on at least one side, so those in the overlap stand in both. Within
a shard the same rule grows a vantage-point tree down to small leaves, where
distances are computed. A pair of a shard is never written: what leaves it is a
star of each group that its links connect.

Stars are joined into components by large-star and small-star rounds over a
table of links, cut from its lineage by stage tables.

Why blocks come first: fingerprints of unrelated texts are about 32 bits apart, give or take
4, so a vantage point alone leaves most of them in the overlap.

Edge cases: a null or empty text has the fingerprint zero and is linked like any
other; fewer words than a shingle are one shingle; repeated rows have equal
fingerprints; rows without id take part, but an id that is null never names a
component unless no other is there; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes
from tessera.session import stage

SHINGLE = 4
SEED = 42
RADIUS = 4
LEAF = 512
SHARD_ROWS = 20_000
SPLITS = 3


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; zero if there are none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes) -> int:
    import xxhash
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(whole, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = ends - lens + 1
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(whole[a:b], SEED) for a, b in zip(starts[:-SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist(), strict=True)], dtype=np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in as_bytes(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------ within a shard

def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _unite(root: np.ndarray, pairs, made: list | None = None) -> None:
    """Unite the groups of each pair; pairs that did so are added to `made`."""
    for pair in pairs:
        a, b = _find(root, pair[0]), _find(root, pair[1])
        if a != b:
            root[max(a, b)] = min(a, b)
            if made is not None:
                made.append(pair)


def _flat(root: np.ndarray) -> np.ndarray:
    while (root[root] != root).any():
        root = root[root]
    return root


def shard_roots(fps: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, made: list | None = None) -> np.ndarray:
    """For each of a shard's distinct fingerprints, the first one that links connect it with. Links that connect groups are added to `made`."""
    root, todo = np.arange(len(fps)), [np.arange(len(fps))]
    while todo:
        idx = todo.pop()
        if len(idx) > leaf:
            d = np.bitwise_count(fps[idx] ^ fps[idx[0]])
            near = idx[d <= radius].tolist()
            _unite(root, ((near[0], j) for j in near[1:]), made)
            groups = _flat(root)[idx]
            if (groups == groups[0]).all():      # connected already, further links add nothing
                continue
            bound = int(np.median(d)) - radius // 2
            inside, outside = idx[d <= bound + radius], idx[d > bound]
            if max(len(inside), len(outside)) <= 0.9 * len(idx):
                todo += [inside, outside]
                continue
        for i in range(0, len(idx), leaf):
            rows = idx[i:i + leaf]
            for j in range(i, len(idx), leaf):
                cols = idx[j:j + leaf]
                a, b = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[cols][None, :]) <= radius)
                keep = rows[a] < cols[b]
                _unite(root, _forest(rows[a[keep]], cols[b[keep]], root), made)
    return _flat(root)


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray):
    """Links between different groups only, most of a dense leaf being settled without a loop over its pairs."""
    while len(a):
        i = np.lexsort((a, b))
        first = np.concatenate([[True], b[i][1:] != b[i][:-1]])
        yield from zip(a[i][first].tolist(), b[i][first].tolist(), strict=True)
        flat = _flat(root)
        open_ = flat[a] != flat[b]
        a, b = a[open_], b[open_]


# ------------------------------------------------------------ shards

def _block(j: int, radius: int):
    """Block j of radius + 1 blocks of the 64 bits, as a column."""
    n = radius + 1
    low, high = 64 * j // n, 64 * (j + 1) // n
    return F.shiftrightunsigned("fp", low).bitwiseAND((1 << (high - low)) - 1)


def shards(nodes: DataFrame, radius: int = RADIUS, most: int = SHARD_ROWS, splits: int = SPLITS) -> DataFrame:
    """fp, block, value, side so that every pair within `radius` bits shares a shard (the three numbers)."""
    tables = F.array(*[F.struct(F.lit(j).alias("block"), _block(j, radius).alias("value")) for j in range(radius + 1)])
    d = nodes.select("fp", F.explode(tables).alias("_t")).select("fp", "_t.block", "_t.value", F.lit(0).alias("side"))
    key = ["block", "value", "side"]
    for _ in range(splits):
        d = stage(d, "simhash-shards")
        large = stage(d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("fp").alias("_vantage")).filter(F.col("_n") > most).drop("_n"), "simhash-large")
        if large.isEmpty():
            break
        far = d.join(large, key).withColumn("_far", F.bit_count(F.col("fp").bitwiseXOR(F.col("_vantage"))))
        bounds = far.groupBy(*key).agg((F.percentile_approx("_far", 0.5) - radius // 2).alias("_bound"))
        inside, outside = F.col("side") * 3 + 1, F.col("side") * 3 + 2
        sides = (F.when(F.col("_far") <= F.col("_bound"), F.array(inside)).when(F.col("_far") > F.col("_bound") + radius, F.array(outside))
                 .otherwise(F.array(inside, outside)))
        cut = far.join(bounds, key).select("fp", "block", "value", F.explode(sides).alias("side"))
        d = d.join(large, key, "left_anti").select("fp", *key).unionByName(cut)
    return d


def links(nodes: DataFrame, radius: int = RADIUS, most: int = SHARD_ROWS, splits: int = SPLITS, trees: bool = False) -> DataFrame:
    """Stars of linked fingerprints: fp and head, two different ones, for the groups of each shard. `trees`: links within `radius` that connect each group instead."""
    parts = shards(nodes, radius, most, splits)

    def run(batches):
        def star(fps):
            f, made = np.array(fps, dtype=np.int64), []
            r = shard_roots(f.view(np.uint64), radius, made=made)
            if trees:
                ends = np.array(made, np.int64).reshape(-1, 2)
                return f[ends[:, 0]], f[ends[:, 1]]
            other = r != np.arange(len(f))
            return f[other], f[r[other]]
        current, own, out = None, [], []

        def emit():
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["fp", "head"])
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True))
            for k, fp in zip(keys, b.column(0).to_pylist(), strict=True):
                if k != current:
                    if len(own) > 1:
                        out.append(star(own))
                    current, own = k, []
                own.append(fp)
            if len(out) > 1000:
                yield emit()
        if len(own) > 1:
            out.append(star(own))
        if out:
            yield emit()
    ordered = parts.repartition("block", "value", "side").sortWithinPartitions("block", "value", "side", "fp")
    return ordered.mapInArrow(run, "fp long, head long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (its smallest node) of every node in `edges` (fp, head), by alternating star rounds."""
    e = stage(edges.select(F.greatest("fp", "head").alias("a"), F.least("fp", "head").alias("b")).distinct(), "simhash-edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
        large = both.join(low, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        large = large.unionByName(low.filter("n != m").select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        small = small.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        new = stage(small, "simhash-edges")
        if new.count() == e.count() and new.exceptAll(e).isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("label"))
        e = new


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    prints = stage(fingerprints(docs), "simhash-prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    groups = components(links(nodes.select("fp"), radius))
    named = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = stage(named, "simhash-groups")
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    labels = named.join(ids, "label").select(F.col("fp").alias("_fp"), "component_id")
    return (prints.join(labels, F.col("fp") == F.col("_fp"))
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def first_of_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without those whose group has a smaller id. Rows of one id are one document; rows without id stay."""
    gone = near_duplicates(docs, radius).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
