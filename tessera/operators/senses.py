"""Clusters of all terms at once: Lloyd's rounds as DataFrame steps, silhouettes by an equi-join.

Vectors are fixed-point numbers, so sums, centres and distances are exact and the result does not
depend on partitions, on the order of rows or on the engine. The first centre of a term is its first
item, each next one the item farthest from those so far. A round gives every item the nearest centre
(ties to the smaller cluster) and averages by (term, k, cluster, dimension), combined map-side,
so one term may own all rows. Centres are a few short arrays per term; they meet the items by a join
on the term that Spark broadcasts while they are small. A term with few items is taken through the same rounds
whole, within one task: the numbers are whole and small enough to be exact there too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.signals import unit
from tessera.session import stage, unstage

SCALE = 1 << 15
ROUNDS = 10
WHOLE = 4096        # items of a term that one task takes through all rounds; larger terms are spread over tasks


def fixed_point(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale + 0.5))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, v: s + v)


def _apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, v: s + v)


def starts(points: DataFrame, k: int) -> DataFrame:
    """term and cs: `k` centres to start from. points: term, item, x."""
    cs = stage(points.groupBy("term").agg(F.array(F.min_by("x", F.struct("item", "x"))).alias("cs")), "centres")
    for _ in range(k - 1):
        near = F.array_min(F.transform("cs", lambda c: _apart(F.col("x"), c)))
        far = points.join(cs, "term").groupBy("term").agg(F.min_by("x", F.struct((-near).alias("d"), F.col("item"), F.col("x"))).alias("_next"))
        more = stage(cs.join(far, "term").select("term", F.concat("cs", F.array("_next")).alias("cs")), "centres")
        unstage(cs)
        cs = more
    return cs


def assigned(points: DataFrame, centres: DataFrame) -> DataFrame:
    """term, k, item, x and the cluster with the nearest centre. centres: term, k, cs with cluster and c."""
    nearest = F.array_min(F.transform("cs", lambda s: F.struct(_apart(F.col("x"), s["c"]).alias("d"), s["cluster"].alias("cluster"))))
    return points.join(centres, "term").select("term", "k", "item", "x", nearest["cluster"].alias("cluster"))


def _by_cluster(labelled: DataFrame, value: Column) -> DataFrame:
    """term, k and the clusters, each with its size and a value per dimension, ascending."""
    each = labelled.select("term", "k", "cluster", F.posexplode("x").alias("i", "v")).groupBy("term", "k", "cluster", "i").agg(value.alias("c"), F.count("v").alias("n"))
    one = each.groupBy("term", "k", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"), F.max("n").alias("n"))
    return one.groupBy("term", "k").agg(F.array_sort(F.collect_list(F.struct("cluster", "c", "n"))).alias("cs"))


def clusters(points: DataFrame, ks, rounds: int = ROUNDS) -> DataFrame:
    """term, k, item, x, cluster for every `k`. A cluster that loses its last item is gone."""
    first = starts(points, max(ks))
    own = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.transform(F.slice("cs", 1, k), lambda c, i: F.struct(i.cast("int").alias("cluster"), c.alias("c"), F.lit(0).cast("long").alias("n"))).alias("cs")) for k in ks]))
    now = stage(first.select("term", own.alias("_s")).select("term", "_s.k", "_s.cs"), "centres")
    unstage(first)
    for _ in range(rounds):
        new = stage(_by_cluster(assigned(points, now), F.floor(F.sum("v") / F.count("v"))), "centres")
        same = new.select("term", "k", "cs.cluster", "cs.c").exceptAll(now.select("term", "k", "cs.cluster", "cs.c")).isEmpty()
        unstage(now)
        now = new
        if same:
            break
    return assigned(points, now)


def silhouettes(labelled: DataFrame, scale: int = SCALE) -> DataFrame:
    """term, k and the mean cosine silhouette of unit vectors; of divisions into two clusters at least.

    The distances from an item to a cluster add up to size minus the product with the cluster's sum, so no pairs are made.
    """
    one = scale * scale
    sums = _by_cluster(labelled, F.sum("v")).filter(F.size("cs") > 1)
    own = _dot(F.col("x"), F.col("x"))
    total = F.transform("cs", lambda s: F.struct(s["cluster"].alias("cluster"), s["n"].alias("n"), (s["n"] * one - _dot(F.col("x"), s["c"])).alias("t")))
    d = labelled.join(sums, ["term", "k"]).select("term", "k", "cluster", own.alias("_x"), total.alias("_t"))
    mine = F.filter("_t", lambda s: s["cluster"] == F.col("cluster"))[0]
    near = F.array_min(F.transform(F.filter("_t", lambda s: s["cluster"] != F.col("cluster")), lambda s: s["t"] / s["n"])) / one
    d = d.select("term", "k", mine["n"].alias("_n"), (F.try_divide(mine["t"] - (one - F.col("_x")), mine["n"] - 1) / one).alias("_a"), near.alias("_b"))
    most = F.greatest("_a", "_b")
    each = F.when((F.col("_n") > 1) & (most > 0), (F.col("_b") - F.col("_a")) / most).otherwise(0.0)
    return d.groupBy("term", "k").agg(F.round(F.avg(each), 9).alias("silhouette"))


# ---------------------------------------------------------------- terms of few items, whole
def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances; whole numbers below 2^53, so exact."""
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)


def _labels(x: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """The cluster of each row after Lloyd's rounds from the centres `first`. A cluster that loses its last row is gone."""
    ids, now = np.arange(len(first)), first
    for _ in range(rounds):
        at = _nearest(x, now).argmin(1)
        n = np.bincount(at, minlength=len(ids))
        sums = (at[None, :] == np.arange(len(ids))[:, None]).astype(float) @ x
        left = n > 0
        new = np.floor(sums[left] / n[left, None])
        same = left.all() and (new == now).all()
        ids, now = ids[left], new
        if same:
            break
    return ids[_nearest(x, now).argmin(1)]


def _silhouette(x: np.ndarray, label: np.ndarray, scale: int) -> float | None:
    ids, own = np.unique(label, return_inverse=True)
    if len(ids) < 2:
        return None
    one, n, rows = float(scale * scale), np.bincount(own).astype(float), np.arange(len(x))
    t = n * one - x @ ((own[None, :] == np.arange(len(ids))[:, None]).astype(float) @ x).T
    mine = n[own]
    a = (t[rows, own] - (one - (x * x).sum(1))) / np.maximum(mine - 1, 1) / one
    others = t / n
    others[rows, own] = np.inf
    b = others.min(1) / one
    most = np.maximum(a, b)
    ok = (mine > 1) & (most > 0)
    return float(np.where(ok, (b - a) / np.where(ok, most, 1.0), 0.0).sum() / len(x))


def _fits(items: list, x: np.ndarray, ks, rounds: int, scale: int) -> list[dict]:
    """For each k the silhouette and the members; `items` and the rows of `x` are in order of item."""
    cs, near = [0], None
    for _ in range(max(ks) - 1):
        d = _nearest(x, x[cs[-1:]])[:, 0]
        near = d if near is None else np.minimum(near, d)
        cs.append(int(near.argmax()))
    out = []
    for k in ks:
        label = _labels(x, x[cs[:k]], rounds)
        fit = _silhouette(x, label, scale) if len(x) > k + 1 else None
        if fit is not None:
            out.append({"k": k, "s": fit, "members": [{"item": str(i), "cluster": int(c)} for i, c in zip(items, label)]})
    return out


def _whole_terms(points: DataFrame, ks, least: int, rounds: int, scale: int) -> DataFrame:
    """term, n and fits (k, silhouette, members), of terms whose items fit in one task. `points`: term, item, x, sorted within its parts."""
    out = pa.schema([("term", pa.string()), ("n", pa.int64()), ("fits", pa.list_(pa.struct([
        ("k", pa.int64()), ("s", pa.float64()), ("members", pa.list_(pa.struct([("item", pa.string()), ("cluster", pa.int32())])))])))])

    def run(batches):
        def closed(term, parts):
            rows = pa.Table.from_batches(parts)
            x = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in parts]).reshape(len(rows), -1).astype(float)
            items = rows.column(1).to_pylist()
            return {"term": term, "n": len(items), "fits": _fits(items, x, ks, rounds, scale) if len(items) >= least else []}
        term, parts, done = None, [], []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(starts, starts[1:]):
                if parts and keys[a] != term:
                    done.append(closed(term, parts))
                    parts = []
                term = keys[a]
                parts.append(batch.slice(a, b - a))
                if len(done) >= 256:
                    yield pa.RecordBatch.from_pylist(done, out)
                    done = []
        if parts:
            done.append(closed(term, parts))
        if done:
            yield pa.RecordBatch.from_pylist(done, out)
    return points.mapInArrow(run, "term string, n long, fits array<struct<k: long, s: double, members: array<struct<item: string, cluster: int>>>>")


def sense_clusters(contexts: DataFrame, k_min: int = 2, k_max: int = 4, min_contexts: int = 12, rounds: int = ROUNDS, whole: int = WHOLE) -> DataFrame:
    """Per term of (term, item, embedding): n, polysemy, best_k and the items of each cluster.

    The best k has the largest silhouette, the smaller k first. Terms with fewer contexts than `min_contexts` get
    nulls, and so does the division of a term whose contexts are all alike. The list of members is as long as the
    sample of a term. Terms of up to `whole` contexts are done in one task each, all others in steps over all tasks.
    """
    least, ks = max(min_contexts, k_min + 2), list(range(k_min, k_max + 1))
    points = stage(contexts.select("term", "item", fixed_point(unit(F.col("embedding"))).alias("x")), "sense-points")
    odd = F.col("term").isNull() | F.col("x").isNull() | F.exists("x", lambda v: v.isNull())
    n = points.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"))
    n = stage(n.withColumn("whole", (F.col("n") <= whole) & (F.col("odd") == 0) & (F.col("least") > 0) & (F.col("least") == F.col("most"))), "sense-sizes")
    spread = n.filter(~F.col("whole")).select("term", "n")
    polysemy = lambda s: F.when(F.col("n") >= min_contexts, F.round(F.greatest(F.lit(0.0), F.coalesce(s, F.lit(0.0))), 4)).alias("polysemy")
    rows = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few, all_whole = points, spread.isEmpty()
    if not all_whole:
        few = points.join(spread.select("term"), "term", "left_anti").filter("term is not null")
    parts = max(points.sparkSession.sparkContext.defaultParallelism, rows // 20_000)
    fits = _whole_terms(few.repartition(parts, "term").sortWithinPartitions("term", "item", "x"), ks, least, rounds, SCALE)
    best = F.array_min(F.transform("fits", lambda f: F.struct((-F.round(f["s"], 9)).alias("s"), f["k"].alias("k"), F.array_sort(f["members"]).alias("members"))))
    out = fits.select("term", "n", best.alias("_b")).select(
        F.col("term"), F.col("n").cast("int").alias("n"), polysemy(-F.col("_b.s")), F.col("_b.k").cast("int").alias("best_k"), F.col("_b.members").alias("members"))
    return out if all_whole else out.unionByName(_spread_terms(points.join(spread, "term"), spread, ks, least, rounds, polysemy))


def _spread_terms(points: DataFrame, n: DataFrame, ks, least: int, rounds: int, polysemy) -> DataFrame:
    points = points.filter(F.col("n") >= least)
    labelled = stage(clusters(points.select("term", "item", "x"), ks, rounds), "sense-labels")
    fit = silhouettes(labelled).join(n, "term").filter(F.col("n") > F.col("k") + 1)
    best = fit.groupBy("term").agg(F.max("silhouette").alias("_s"), F.min_by("k", F.struct(-F.col("silhouette"), F.col("k"))).alias("best_k"))
    best = stage(best, "sense-best")
    parts = labelled.join(best.select("term", F.col("best_k").alias("k")), ["term", "k"]).groupBy("term").agg(
        F.array_sort(F.collect_list(F.struct(F.col("item").cast("string").alias("item"), F.col("cluster").cast("int").alias("cluster")))).alias("members"))
    out = n.join(best, "term", "left").join(parts, "term", "left")
    return out.select("term", F.col("n").cast("int").alias("n"), polysemy(F.col("_s")), F.col("best_k").cast("int").alias("best_k"), "members")


def corpus_clusters(df: DataFrame, item: str, vector: str = "embedding", k: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """Item and cluster of all rows with a vector, as one term."""
    points = stage(df.filter(F.col(vector).isNotNull()).select(F.lit(0).alias("term"), F.col(item).alias("item"), fixed_point(F.col(vector)).alias("x")), "corpus-points")
    return clusters(points, [k], rounds).select(F.col("item").alias(item), "cluster")


# ---------------------------------------------------------------- the same steps in SQL, for comparison
def sql_clusters(name: str, points: str, ks, rounds: int = ROUNDS) -> list[tuple[str, str, tuple[str, ...]]]:
    """Table expressions (name, body, needs); the last, `{name}_labels`, holds term, k, item, x, cluster. x are lists of doubles."""
    apart = "list_dot_product(p.x, p.x) + list_dot_product({c}, {c}) - 2 * list_dot_product(p.x, {c})"
    out = [(f"{name}_s1", f"SELECT term, [arg_min(x, item)] AS cs FROM {points} GROUP BY term", (points,))]
    for j in range(2, max(ks) + 1):
        far = f"list_min(list_transform(s.cs, lambda c: {apart.format(c='c')}))"
        out.append((f"{name}_s{j}", f"SELECT p.term, list_append(any_value(s.cs), arg_min(p.x, (-({far}), p.item))) AS cs FROM {points} p JOIN {name}_s{j - 1} s USING (term) GROUP BY p.term", (points, f"{name}_s{j - 1}")))
    k_list = ", ".join(f"({k})" for k in ks)
    nearest = f"SELECT s.r, p.term, s.k, p.item, any_value(p.x) AS x, arg_min(s.cluster, ({apart.format(c='s.c')}, s.cluster)) AS cluster FROM {{centres}} s JOIN {points} p USING (term) GROUP BY ALL"
    out.append((f"{name}_centres", f"""
SELECT 0 AS r, term, k, unnest(range(0, k)) AS cluster, unnest(cs[1:k]) AS c FROM {name}_s{max(ks)}, (VALUES {k_list}) t(k)
UNION ALL
SELECT r + 1, term, k, cluster, list(v ORDER BY i) FROM (
  SELECT r, term, k, cluster, i, floor(sum(v) / count(*)) AS v FROM (
    SELECT r, term, k, cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM ({nearest.format(centres=f'(SELECT * FROM {name}_centres WHERE r < {rounds})')})) GROUP BY ALL) GROUP BY r, term, k, cluster
""", (f"{name}_s{max(ks)}", points)))
    out.append((f"{name}_labels", nearest.format(centres=f"(SELECT * FROM {name}_centres WHERE r = {rounds})"), (f"{name}_centres", points)))
    return out


def sql_senses(name: str, contexts: str, min_contexts: int = 12, scale: int = SCALE) -> list[tuple[str, str, tuple[str, ...]]]:
    """`{name}_best`: term, n, polysemy, best_k from `{name}_labels` and the sample `contexts` (term)."""
    one = scale * scale
    return [(f"{name}_sums", f"""
SELECT term, k, cluster, list(v ORDER BY i) AS c, max(n) AS n FROM (SELECT term, k, cluster, i, sum(v) AS v, count(*) AS n FROM (
  SELECT term, k, cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {name}_labels) GROUP BY ALL) GROUP BY ALL""", (f"{name}_labels",)),
            (f"{name}_silhouettes", f"""
SELECT term, k, round(avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END), 9) AS silhouette FROM (
  SELECT l.term, l.k, l.item, max(s.n) FILTER (s.cluster = l.cluster) AS n,
    max((s.n * {one} - list_dot_product(l.x, s.c) - ({one} - list_dot_product(l.x, l.x))) / (s.n - 1) / {one}) FILTER (s.cluster = l.cluster) AS a,
    min((s.n * {one} - list_dot_product(l.x, s.c)) / s.n / {one}) FILTER (s.cluster <> l.cluster) AS b
  FROM {name}_labels l JOIN {name}_sums s ON s.term = l.term AND s.k = l.k GROUP BY l.term, l.k, l.item) WHERE b IS NOT NULL GROUP BY ALL""", (f"{name}_labels", f"{name}_sums")),
            (f"{name}_best", f"""
SELECT term, n, CASE WHEN n >= {min_contexts} THEN round(greatest(0.0, coalesce(s, 0.0)), 4) END AS polysemy, best_k FROM
  (SELECT term, count(*) AS n FROM {contexts} GROUP BY term) LEFT JOIN
  (SELECT term, max(silhouette) AS s, arg_min(k, (-silhouette, k))::BIGINT AS best_k FROM {name}_silhouettes GROUP BY term) USING (term)""", (f"{name}_silhouettes", contexts))]


def sql_hashed(tokens: str, keys: str, source: str, dims: int, scale: int = SCALE) -> str:
    """Fixed-point vectors of hashed tokens as lists of doubles: keys and x. `keys` tell the rows of `source` apart."""
    return f"""
SELECT {keys}, list_transform(v, lambda e: CASE WHEN z > 0 THEN floor(e / sqrt(z) * {scale} + 0.5) ELSE 0.0 END) AS x FROM (SELECT {keys}, v, list_dot_product(v, v) AS z FROM (
 SELECT {keys}, list(coalesce(s, 0.0) ORDER BY idx) AS v FROM (SELECT {keys}, unnest(range(0, {dims})) AS idx FROM {source}) LEFT JOIN (
  SELECT {keys}, ('0x' || substr(md5(tok), 31, 2))::INT % {dims} AS idx, sum(CASE WHEN ('0x' || substr(md5(tok), 29, 2))::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM (
   SELECT {keys}, unnest({tokens}) AS tok FROM {source}) GROUP BY ALL) USING ({keys}, idx) GROUP BY {keys}))"""
