"""Centroid clustering by dual-tree Lloyd rounds.

The vectors of a task are cut into blocks, and each block becomes a cover tree once: its points lie in tree order, so a
node is a range of them, with a centre and a radius. The trees are a table. In each round a cover tree over the
centroids meets every block's tree. A pair of nodes whose lower distance bound is above another pair's upper bound is
dropped; a node that one centroid is left for is given to it whole, by its points' sum; only leaves that several are
left for are compared point by point, in exact integers. A task adds up its blocks and sends one row per cluster and
component, so a round shuffles some thousand sums per task and no vector ever moves, however many are equal.

The driver holds the centroids, ``k`` vectors, and nothing that grows with the input.

Defined cases: kept are vectors with exactly ``dim`` components, all there and finite; components count as
floor(64 * x), held to +-2**27, so that a squared distance fits a long; sums of distances beyond a long are the largest
long; rows that repeat, with or without an id, count and start centroids each; of equal ids the vector that is smaller
component by component comes first, a null id comes last; fewer than ``k`` vectors start as many centroids; an empty
table gives no rows; other columns are ignored. Ties go to the smaller cluster number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.common import cut

DIM, K, ROUNDS, SEED = 64, 16, 3, 1
SCALE, MOST = 64, 2**27
#: Vectors of a block, the points that a leaf may hold, and the children beyond which a scale has no structure.
BLOCK, LEAF, FAN = 4096, 24, 48
#: Bounds are floats; pairs closer than this share of a distance are decided in integers.
SLACK = 1e-9
LONG_MAX = 2**63 - 1
TREE = "ids array<long>, points binary, width int, lo array<int>, hi array<int>, first array<int>, last array<int>, radius array<double>"


class Tree:
    """Nodes in breadth-first order: node n holds points lo[n] to hi[n], its centre is the first of them, its children
    are nodes first[n] to last[n] (none: a leaf), and no point of it is farther than radius[n] from the centre."""

    def __init__(self, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, radius: np.ndarray) -> None:
        self.points, self.lo, self.hi, self.first, self.last, self.radius = points, lo, hi, first, last, radius


def _far(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points.astype(np.float64) - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _net(points: np.ndarray, far: np.ndarray, scale: float, fan: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """(members, distances from the first of them) of balls of radius *scale*, each round a point outside those before;
    None if there would be more than *fan*."""
    left, found = np.arange(len(points)), []
    while len(left):
        if len(found) == fan:
            return None
        near = far[left] if not found else _far(points[left], points[left[0]])
        inside = near <= scale
        found.append((left[inside], near[inside]))
        left = left[~inside]
    return found


def cover_tree(points: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> tuple[Tree, np.ndarray]:
    """The cover tree of *points* (its points are permuted) and the permutation. Radii halve from a level to the next."""
    order = np.arange(len(points))
    far_of = [_far(points, points[0])]
    lo, hi, first, last, radius = [0], [len(points)], [], [], []
    at = 0
    while at < len(lo):
        own, far = order[lo[at] : hi[at]].copy(), far_of[at]
        far_of[at] = None  # type: ignore[call-overload]
        most = float(far.max())
        radius.append(most)
        first.append(len(lo))
        scale, net = most, None
        while len(own) > leaf and most > 0 and net is None:
            scale /= 2
            net = _net(points[own], far, scale, fan)
            if net is None:
                break  # no structure at this scale: a leaf
            if len(net) == 1:
                net = None
        if net is not None:
            place = lo[at]
            for members, near in net:
                order[place : place + len(members)] = own[members]
                lo.append(place)
                hi.append(place + len(members))
                far_of.append(near)
                place += len(members)
        last.append(len(lo))
        at += 1
    return Tree(points[order], *(np.array(x, np.int32) for x in (lo, hi, first, last)), np.array(radius)), order


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances. Products of numbers up to 2**22 add up exactly as floats, which multiply faster."""
    if max(np.abs(points).max(), np.abs(centroids).max()) <= 2**22:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def assign(tree: Tree, centroids: np.ndarray, over: tuple[Tree, np.ndarray]) -> Iterator[tuple[int, int, int | np.ndarray, np.ndarray | None]]:
    """(lo, hi, cluster or clusters, squared distances or None) of ranges of *tree*'s points, from one walk of both trees.

    *over* is the cover tree of *centroids* with its order. What stands at a node is a list of centroid nodes; each goes
    down to its children before the points' node does while its radius is the larger.
    """
    heads, number = over[0], over[1]
    centres = heads.points.astype(np.float64)
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        at, held = stack.pop()
        lo, hi, reach = int(tree.lo[at]), int(tree.hi[at]), tree.radius[at]
        while True:
            mid = _far(centres[heads.lo[held]], tree.points[lo])
            least = mid.min() + reach  # the centre of a node of centroids is a centroid
            held = held[mid - reach - heads.radius[held] <= least * (1 + SLACK) + SLACK]
            wide = (heads.hi[held] - heads.lo[held] > 1) & ((heads.radius[held] >= reach) | (tree.first[at] == tree.last[at]))
            if not wide.any():
                break
            parts = [held[~wide]]
            for h in held[wide]:
                inner = np.arange(heads.first[h], heads.last[h])
                parts.append(inner if len(inner) else np.array([h]))
            opened = np.concatenate(parts)
            if len(opened) == len(held) and (np.sort(opened) == np.sort(held)).all():
                break
            held = opened
        left = np.concatenate([np.arange(heads.lo[h], heads.hi[h]) for h in held])
        if len(left) == 1:
            yield lo, hi, int(number[left[0]]), None
        elif tree.first[at] == tree.last[at]:
            names = np.sort(number[left])
            gaps = _squared(tree.points[lo:hi], centroids[names])
            best = gaps.argmin(1)  # the first of equal ones
            yield lo, hi, names[best], gaps[np.arange(hi - lo), best]
        else:
            stack.extend((child, held) for child in range(tree.first[at], tree.last[at]))


def _ints(flat: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def _pack(block: np.ndarray) -> tuple[bytes, int]:
    most = int(np.abs(block).max(initial=0))
    width = 1 if most < 2**7 else 2 if most < 2**15 else 4
    return block.astype(f"<i{width}").tobytes(), width


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[list, Tree]]:
    for i in range(batch.num_rows):
        row = {n: batch.column(n)[i] for n in batch.schema.names}
        width = row["width"].as_py()
        points = np.frombuffer(row["points"].as_buffer(), f"<i{width}").astype(np.int64)
        ints = [np.array(row[n].values) for n in ("lo", "hi", "first", "last", "radius")]
        yield row["ids"].values, Tree(points.reshape(len(row["ids"].values), -1), *ints)


def kept(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, embedding) of the vectors that count, components as doubles."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter((F.size("embedding") == dim) & fine)


def build(points: DataFrame, block: int = BLOCK, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """The table of block trees of ``kept`` vectors, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                column = part.column(1)
                flat = np.array(column.flatten(), dtype=np.float64)
                tree, order = cover_tree(_ints(flat).reshape(part.num_rows, -1), leaf, fan)
                data, width = _pack(tree.points)
                ids = part.column(0).take(pa.array(order))
                values = [[ids.to_pylist()], [data], [width], [tree.lo], [tree.hi], [tree.first], [tree.last], [tree.radius]]
                kinds = [pa.list_(pa.int64()), pa.binary(), pa.int32(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.float64())]
                names = ["ids", "points", "width", "lo", "hi", "first", "last", "radius"]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    return cut(points.mapInArrow(run, TREE))


def start(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The first centroids: the *k* vectors of least SHA-256 of ``seed:vec_id``, at most *k* rows on the driver."""
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * SCALE))))
    first = points.select(turn.alias("turn"), whole.alias("c")).orderBy(F.col("turn").asc_nulls_last(), "c").limit(k).collect()
    return np.array([r["c"] for r in first], np.int64).reshape(len(first), len(first[0]["c"]) if first else 0)


def step(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: of every cluster that has vectors the floor of their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        sums, counts, over = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), cover_tree(centroids, 1, k) if k else None
        for batch in batches:
            for _, tree in _trees(batch):
                for lo, hi, cluster, gaps in assign(tree, centroids, over):
                    own = tree.points[lo:hi]
                    if gaps is None:
                        sums[cluster] += own.sum(0)
                        counts[cluster] += hi - lo
                    else:
                        counts += np.bincount(cluster, minlength=k)
                        for c in np.unique(cluster):
                            sums[c] += own[cluster == c].sum(0)
        some = np.flatnonzero(counts)
        columns = [np.repeat(some, dim), np.tile(np.arange(dim), len(some)), sums[some].ravel(), np.repeat(counts[some], dim)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "place", "total", "n"])

    rows = trees.mapInArrow(run, "cluster long, place long, total long, n long")
    found = rows.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in found.collect():  # k * dim sums
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) per vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = cover_tree(centroids, 1, len(centroids)) if len(centroids) else None
        for batch in batches:
            for ids, tree in _trees(batch):
                cluster, distance = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
                for lo, hi, found, gaps in assign(tree, centroids, over):
                    cluster[lo:hi] = found
                    distance[lo:hi] = _squared(tree.points[lo:hi], centroids[found : found + 1])[:, 0] if gaps is None else gaps
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and its centroid's digest."""
    points = kept(vectors, dim)
    trees, centroids = build(points, block), start(points, k, seed)
    for _ in range(rounds):
        centroids = step(trees, centroids)
    spark = vectors.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    each = cut(assigned(trees, centroids))
    sums = each.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).join(named, "cluster")
    # One row per cluster: the bound of this window and of the broadcast is k.
    sums = sums.withColumn("all", F.sum("own").over(W.partitionBy()))
    held = lambda c: F.least(F.col(c), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    sums = sums.select("cluster", held("own").alias("cluster_inertia"), held("all").alias("inertia"), "centroid_sha256")
    return each.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _oracle(rounds: int = ROUNDS) -> str:
    sql = f"""
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
), p AS (
  SELECT rid, vec_id, list_transform(embedding, lambda x: greatest(-{MOST}, least({MOST}, floor({SCALE} * x::DOUBLE)))::BIGINT) AS v FROM e
), c0 AS (
  SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS cluster, v AS m
  FROM (SELECT sha256('{SEED}:' || vec_id::VARCHAR) AS h, v FROM p) QUALIFY cluster < {K}
)"""
    gap = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for n in range(rounds + 1):
        sql += f"""
, a{n} AS (
  SELECT rid, vec_id, v, b.cluster AS cluster, b.distance AS distance
  FROM (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'distance': {gap}, 'cluster': cluster}}) AS b FROM p, c{n} GROUP BY rid)
)"""
        if n < rounds:
            sql += f"""
, s{n} AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS k FROM (SELECT cluster, unnest(v) AS x, unnest(range({DIM})) AS i FROM a{n}) GROUP BY cluster, i
), c{n + 1} AS (
  SELECT c.cluster, coalesce(f.m, c.m) AS m FROM c{n} c
  LEFT JOIN (SELECT cluster, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS m FROM s{n} GROUP BY cluster) f USING (cluster)
)"""
    return f"""{sql}
SELECT vec_id, cluster, distance, least(sum(distance) OVER (PARTITION BY cluster), {LONG_MAX})::BIGINT AS cluster_inertia, least(sum(distance) OVER (), {LONG_MAX})::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


ORACLE = _oracle()
