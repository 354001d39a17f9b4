"""Exact top-k by inner product: cover trees over queries and data, searched together.

Vectors are dealt to bounded blocks, near ones together (nearest of a bounded
number of pivots; a large pivot is salted into several blocks). Every block has a
cover tree: centres of a level are further apart than its scale, and every vector
lies within the scale of its centre; small children share a leaf. A pair of a query node
and a data node is dropped if

    <cq, cx> + |cq| rx + |cx| rq + rq rx  <  the worst k-th score within the query node.

Two rounds: query blocks first meet the data blocks of their own pivot, which gives
every query a k-th score to beat; then those blocks of other pivots whose bound
reaches the worst of them. Bounds are raised by a rounding allowance and only a
lower bound prunes, so ties survive: results equal an exhaustive search. Blocks
stream: a task holds one data block, its tree and one query block at a time.

Components are kept in 32 bits, or in 64 where they need it. Scores are exact: by floating-point products while
all of them fit 53 bits, by 64-bit products while these fit, else by whole numbers of any size, of which those beyond
64 bits are returned as the largest or smallest long.

Edge cases: null vectors and those with null or non-finite components, or of 2^63 and more after scaling,
take no part; only vectors of one length meet; rows with one
id and one vector are one row; rows with the query's id are never its candidates;
rows without id take no part; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import stage

SCALE = 256
TOP = 5
PIVOTS = 32
DATA_BLOCK = 2048
QUERY_BLOCK = 256
LEAF = 64
SLOTS = 64


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim and q (the floored components in a row, as 32-bit integers, or as 64-bit ones where one is too large)."""
    def run(batches):
        for b in batches:
            ids, dims, out = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or v is None or None in v:
                    continue
                x = np.floor(np.array(v, dtype=np.float64) * scale)
                if np.isfinite(x).all() and (np.abs(x) < 2**63).all():
                    ids.append(i)
                    dims.append(len(x))
                    out.append(_packed_numbers(x.astype("<i8")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "q"])
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, dim int, q binary")


def _packed_numbers(x: np.ndarray) -> bytes:
    return x.astype("<i8" if (x < -2**31).any() or (x >= 2**31).any() else "<i4").tobytes()


def _numbers(body: bytes, n: int, dim: int) -> np.ndarray:
    """`n` packed vectors as 64-bit integers."""
    return np.frombuffer(body, "<i8" if len(body) == 8 * n * dim and n * dim else "<i4").reshape(n, dim).astype(np.int64)


def _matrix(parts: list[bytes], dim: int) -> np.ndarray:
    """Vectors packed one by one as 64-bit integers."""
    if all(len(x) == 4 * dim for x in parts):
        return _numbers(b"".join(parts), len(parts), dim)
    return np.concatenate([_numbers(x, 1, dim) for x in parts])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, held within 64 bits."""
    most = max(1, a.shape[1]) * max((abs(int(v)) for v in (a.min(initial=0), a.max(initial=0)))) * max((abs(int(v)) for v in (b.min(initial=0), b.max(initial=0))))
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    whole = a.astype(object) @ b.T.astype(object)
    return np.clip(whole, -2**63, 2**63 - 1).astype(np.int64)


def _below(scores: np.ndarray) -> np.ndarray:
    """Scores as floating-point numbers that are not above them."""
    f = scores.astype(np.float64)
    return np.where(np.abs(f) < 2**53, f, np.nextafter(f, -np.inf))


# ------------------------------------------------------------ trees

class Node:
    """Centre, its norm, the largest distance of a member, members, children (none for a leaf)."""
    __slots__ = ("centre", "norm", "radius", "members", "children")

    def __init__(self, x: np.ndarray, members: np.ndarray, centre: np.ndarray, children=()):
        self.centre, self.members, self.children = centre, members, children
        self.norm = float(np.sqrt(centre @ centre))
        d = x[members] - centre
        self.radius = float(np.sqrt((d * d).sum(axis=1).max(initial=0.0)))


def cover_tree(x: np.ndarray, members: np.ndarray | None = None, scale: float | None = None, leaf: int = LEAF) -> Node:
    members = np.arange(len(x)) if members is None else members
    if len(members) <= leaf:
        return Node(x, members, x[members].mean(axis=0))
    top = Node(x, members, x[members[0]])
    if top.radius == 0:
        return top
    scale = top.radius / 2 if scale is None else min(scale, top.radius / 2)
    children, small, rest = [], [], members
    while len(rest):
        d = x[rest] - x[rest[0]]
        near = (d * d).sum(axis=1) <= scale * scale
        (children if near.sum() > leaf else small).append(rest[near])
        rest = rest[~near]
    pages, page, size = [], [], 0
    for s in small:
        if size + len(s) > leaf and page:
            pages.append(np.concatenate(page))
            page, size = [], 0
        page.append(s)
        size += len(s)
    if page:
        pages.append(np.concatenate(page))
    top.children = [cover_tree(x, c, scale / 2, leaf) for c in children] + [Node(x, p, x[p].mean(axis=0)) for p in pages]
    return top


def bound(a: Node, b: Node) -> float:
    """No inner product between members of both is above this."""
    v = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    return v + 1e-6 * (a.norm + a.radius + 1) * (b.norm + b.radius + 1)


class Best:
    """The k best candidates of each query of a block; `known` are k-th scores reached elsewhere. x: integers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, known: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.floor = _below(known)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def add(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        scores = _products(self.x[rows], x)
        hit = (scores >= self.floor[rows][:, None]) & (self.ids[rows][:, None] != ids[None, :])
        for i in np.flatnonzero(hit.any(axis=1)):
            r, m = rows[i], hit[i]
            s, v = np.concatenate([self.found[r][0], scores[i][m]]), np.concatenate([self.found[r][1], ids[m]])
            o = np.lexsort((v, ~s))[:self.k]                # ~s falls as s grows, and overflows nowhere
            self.found[r] = s[o], v[o]
            if len(o) == self.k:
                self.floor[r] = max(self.floor[r], float(_below(s[o[-1:]])[0]))


def dual_search(queries: Node, data: Node, best: Best, ids: np.ndarray, x: np.ndarray) -> None:
    todo = [(bound(queries, data), queries, data)]
    while todo:
        b, q, d = todo.pop()
        if b < best.floor[q.members].min():
            continue
        if not q.children and not d.children:
            best.add(q.members, ids[d.members], x[d.members])
        elif not q.children or (d.children and d.radius >= q.radius):
            todo += sorted(((bound(q, c), q, c) for c in d.children), key=lambda t: t[0])
        else:
            todo += sorted(((bound(c, d), c, d) for c in q.children), key=lambda t: t[0])


# ------------------------------------------------------------ blocks

_BLOCK = "dim int, pivot int, salt int, ids binary, body binary, n int, centre array<double>, radius double"


def _pivots(q: DataFrame, n: int) -> dict[int, np.ndarray]:
    """At most `n` vectors of each length, by a hash of the id; `n` is the bound of what comes to the driver, for lengths in use."""
    w = W.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "q")
    rows = q.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).select("dim", "q").collect()
    return {d: _matrix([bytes(r.q) for r in rows if r.dim == d], d).astype(np.float64) for d in {r.dim for r in rows}}


def blocks(q: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Blocks of at most about `size` vectors: keys, packed ids and vectors, centre and radius."""
    def assign(batches):
        for b in batches:
            ids, dims, body = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            near = []
            for d, v in zip(dims, body, strict=True):
                x = _numbers(v, 1, d)[0].astype(np.float64)
                p = pivots[d]
                near.append(int(((p - x) ** 2).sum(axis=1).argmin()) if d else 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column(1), b.column(2), pa.array(near, pa.int32())], names=["vec_id", "dim", "q", "pivot"])
    a = stage(q.mapInArrow(assign, "vec_id long, dim int, q binary, pivot int"), "cover-assigned")
    many = a.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / size).alias("_salts"))
    a = a.join(many, ["dim", "pivot"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("_salts")).cast("int"))

    def pack(batches):
        for b in batches:
            out = []
            for dim, pivot, salt, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q = _matrix([r["q"] for r in rows], dim)
                x = q.astype(np.float64)
                c = x.mean(axis=0)
                r = float(np.sqrt(((x - c) ** 2).sum(axis=1).max()))
                out.append((dim, pivot, salt, np.array([r["vec_id"] for r in rows], "<i8").tobytes(), _packed_numbers(q), len(rows), c.tolist(), r))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.float64()), pa.float64()]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])
    grouped = a.groupBy("dim", "pivot", "salt").agg(F.collect_list(F.struct("vec_id", "q")).alias("rows"))
    return grouped.mapInArrow(pack, _BLOCK)


def search(data: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """Best candidates per query. requests: query blocks (ids, body, known: k-th scores) with the key of a data block each."""
    key = ["dim", "pivot", "salt"]
    d = data.select(*key, F.lit(0).alias("kind"), "ids", "body", F.lit(None).cast("binary").alias("known"))
    r = requests.select(*key, F.lit(1).alias("kind"), "ids", "body", "known")

    def run(batches):
        at, tree, ids, x, held, trees = None, None, None, None, 0, {}
        out = []
        for b in batches:
            for dim, pivot, salt, kind, i, body, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    at, ids = (dim, pivot, salt), np.frombuffer(i, "<i8")
                    x = _numbers(body, len(ids), dim)
                    tree = cover_tree(x.astype(np.float64))
                elif at == (dim, pivot, salt):
                    qi = np.frombuffer(i, "<i8")
                    if i not in trees:
                        if len(trees) > 64:
                            trees.clear()
                        qx = _numbers(body, len(qi), dim)
                        trees[i] = qx, cover_tree(qx.astype(np.float64), leaf=LEAF // 4)
                    qx, queries = trees[i]
                    best = Best(qi, qx, np.frombuffer(known, "<f8"), k)
                    dual_search(queries, tree, best, ids, x)
                    for q, (s, v) in zip(qi, best.found, strict=True):
                        if len(v):
                            out.append((np.full(len(v), q), v, s))
                            held += len(v)
                if held > 50_000:
                    yield emit(out)
                    held = 0
        if out:
            yield emit(out)

    def emit(out):
        q, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])
    rows = d.unionByName(r).repartition(*key).sortWithinPartitions(*key, "kind")
    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _reached(qb: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Query blocks with the k-th score that each of their queries has reached (minus infinity below k)."""
    kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_s"))
    members = qb.select("dim", "pivot", "salt", F.posexplode("id_list").alias("_at", "_id"))
    listed = (members.join(kth, F.col("_id") == F.col("_q"), "left").groupBy("dim", "pivot", "salt")
              .agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce(F.col("_s").cast("double"), F.lit(float("-inf"))).alias("s"))))["s"].alias("floors")))
    return qb.join(listed, ["dim", "pivot", "salt"])


def _packed(floors):
    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("floors")
            known = pa.array([np.array(x, "<f8").tobytes() for x in b.column(i).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for j, c in enumerate(b.columns) if j != i), known], names=[*(n for n in b.schema.names if n != "floors"), "known"])
    names = [f for f in floors.schema if f.name != "floors"]
    return floors.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names) + ", known binary")


def _with_lists(qb: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = pa.array([np.frombuffer(x, "<i8").tolist() for x in b.column(b.schema.get_field_index("ids")).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "id_list"])
    return qb.mapInArrow(run, _BLOCK + ", id_list array<long>")


def top_k(vectors: DataFrame, is_query, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best rows for every row that `is_query` (a column over vec_id) selects."""
    q = stage(quantised(vectors, scale).distinct(), "cover-vectors")
    pivots = _pivots(q, PIVOTS)
    data = stage(blocks(q, pivots, DATA_BLOCK), "cover-data")
    queries = stage(_with_lists(blocks(q.filter(is_query), pivots, QUERY_BLOCK)), "cover-queries")
    own = data.select("dim", "pivot", F.col("salt").alias("_salt"))
    first = queries.withColumn("floors", F.transform("id_list", lambda _: F.lit(float("-inf")))).join(own, ["dim", "pivot"])
    first = first.select("dim", "pivot", F.col("_salt").alias("salt"), "ids", "body", "floors")
    near = stage(_ranked(search(data, _packed(first), k), k), "cover-near")
    reached = stage(_packed(_reached(queries, near, k).withColumn("worst", F.array_min("floors")).drop("id_list")), "cover-reached")

    def norm(c):
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("_slot")
    a = reached.select("dim", F.col("pivot").alias("_p"), F.col("salt").alias("_t"), F.col("centre").alias("_c"), F.col("radius").alias("_r"), norm("centre").alias("_n"), "worst", slots)
    b = data.select("dim", "pivot", "salt", "centre", "radius", norm("centre").alias("norm"), F.pmod(F.xxhash64("dim", "pivot", "salt"), F.lit(SLOTS)).cast("int").alias("_slot"))
    dot = F.aggregate(F.zip_with("_c", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    most = dot + F.col("_n") * F.col("radius") + F.col("norm") * F.col("_r") + F.col("_r") * F.col("radius")
    most = most + 1e-6 * (F.col("_n") + F.col("_r") + 1) * (F.col("norm") + F.col("radius") + 1)
    pairs = a.join(b, ["dim", "_slot"]).filter((F.col("_p") != F.col("pivot")) & (most >= F.col("worst"))).select("dim", "_p", "_t", "pivot", "salt")
    body = reached.select("dim", F.col("pivot").alias("_p"), F.col("salt").alias("_t"), "ids", "body", "known")
    far = search(data, pairs.join(body, ["dim", "_p", "_t"]).select("dim", "pivot", "salt", "ids", "body", "known"), k)
    return _ranked(near.select("query_id", "vec_id", "score").unionByName(far), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
