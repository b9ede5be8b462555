"""Approximate nearest neighbours: low-dimensional stable projections in kd-trees, verified until a chi-square test holds.

Vectors are scaled to length 1, so the largest cosine is the smallest Euclidean distance. Projection on ``axes`` Gaussian
directions is 2-stable: the squared projected distance of two points over their squared distance is chi-square distributed with
``axes`` degrees of freedom. A search takes points in order of projected distance, verifies their true distance, and stops
when the next projected distance is so large that a point nearer than the k-th best would have one as large with a
probability of at most 1 - ``confidence``. So each true neighbour is found with a probability of at least ``confidence``.

The tree is distributed: its upper splits come from a bounded sample (``sample`` vectors, chosen by a hash of the id) and
send every vector to one of at most ``max_leaves`` leaves, some of which next to each other are a block; each block has the
lower levels of its own. A query goes through the blocks in order of projected distance, which is that of the nearest of the
tight boxes around a block's leaves, by waves: first its home block, then the next ``growth``, then ``growth`` times as many, and so
on. What it has found bounds the k-th best distance, and it stops at the first block that the stopping test rules out; so few
waves are made, and none visits a block that the wave before could rule out. A block of many points goes in parts and its
queries in chunks, both of bounded size. Inside a block, waves of queries visit their next nearest bucket of points together, as
one matrix product; points that may be as near as the k-th best, but for rounding, are compared by their exact cosine and then by id.

Vectors are scaled by a power of two, which changes no cosine, so their squares neither overflow nor vanish. Vectors that
are equal then are one point with its k + 1 smallest ids, so copies cost nothing and no group of them meets in one task.
Vectors that are null, zero, of another dimension than most of the sample, or that hold null or non-finite components
take no part, as queries or as candidates. Ties go to the smaller id; with fewer than k candidates all are returned.
A repeated id counts once for each different vector: as a candidate, and as a query with ranks of its own; none of its
vectors is its own neighbour. Rows that repeat both count once. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrow_text as at
from .shared_folder import Scratch


#: More than products of unit vectors may be wrong by.
ROUNDING = 1e-12


def chi_square_quantile(p: float, freedom: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form of the distribution."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail(mid) < p else (low, mid)
    return high


def projection(dim: int, axes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, axes]).standard_normal((dim, axes))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class Splits:
    """The upper levels of the tree: any number of leaves, each with as much of the sample as another."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis, self.at, self.children = [], [], []
        self.made = 0
        self.root = self._split(points, leaves)
        self.axis, self.at, self.children = np.array(self.axis, np.int64), np.array(self.at), np.array(self.children, np.int64).reshape(-1, 2)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        """The number of a node, or -1 - the number of a leaf."""
        if leaves == 1:
            self.made += 1
            return -self.made
        node, half = len(self.axis), leaves // 2
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
        cut = float(np.quantile(points[:, axis], half / leaves)) if len(points) else np.inf
        self.axis.append(axis)
        self.at.append(cut)
        self.children.append((0, 0))
        left = points[:, axis] <= cut
        self.children[node] = (self._split(points[left], half), self._split(points[~left], leaves - half))
        return node

    def leaves(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root, np.int64)
        while len(rows := np.flatnonzero(node >= 0)):
            own = node[rows]
            node[rows] = self.children[own, (points[rows, self.axis[own]] > self.at[own]).astype(np.int64)]
        return -1 - node


def reach(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of a point to each of several boxes."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=1)


class Block:
    """The tree's lower levels: buckets of at most ``bucket`` points with tight boxes, and a search over them."""

    def __init__(self, vectors: np.ndarray, matrix: np.ndarray, bucket: int = 256):
        self.vectors, self.units = vectors, units(vectors)
        self.points = self.units @ matrix
        order, bounds = [], [0]
        todo = [np.arange(len(vectors))]
        while todo:
            own = todo.pop()
            if len(own) <= bucket:
                order.append(own)
                bounds.append(bounds[-1] + len(own))
                continue
            p = self.points[own]
            axis = int(np.argmax(np.ptp(p, axis=0)))
            half = np.argpartition(p[:, axis], len(own) // 2)
            todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        self.order, self.bounds = np.concatenate(order), bounds
        self.units, self.points = self.units[self.order], self.points[self.order]
        self.low = np.stack([self.points[a:b].min(axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        self.high = np.stack([self.points[a:b].max(axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])

    def search(self, queries: np.ndarray, matrix: np.ndarray, k: int, stop: float, known: np.ndarray, least: np.ndarray, barred: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: none) and cosines of the k best of each query, nearest first, then by ``least`` (an id of each point).
        known: squared distances that are bounds on each query's k-th best already. stop: the quantile of the stopping
        test. barred: which points are none of the queries' candidates, for numbers of queries and of points."""
        unit = units(queries)
        point = unit @ matrix
        n, m = len(queries), len(self.low)
        gap = np.maximum(np.maximum(self.low[None] - point[:, None], point[:, None] - self.high[None]), 0)
        reach = (gap * gap).sum(axis=2)
        turn = np.argsort(reach, axis=1)
        best, who = np.full((n, k), -np.inf), np.full((n, k), -1)
        open_ = np.arange(n)
        for wave in range(m):
            bound = np.minimum(2 - 2 * best[open_, -1], known[open_]) * stop + ROUNDING
            open_ = open_[reach[open_, turn[open_, wave]] <= bound]
            if not len(open_):
                break
            at_ = turn[open_, wave]
            for b in np.unique(at_):
                own = open_[at_ == b]
                names = self.order[self.bounds[b] : self.bounds[b + 1]]
                distance = 2 - 2 * (unit[own] @ self.units[self.bounds[b] : self.bounds[b + 1]].T)
                distance[barred(own, names)] = np.inf
                every = np.concatenate((2 - 2 * best[own], distance), axis=1)
                limit = np.partition(every, k - 1, axis=1)[:, k - 1] + ROUNDING
                q, p = np.nonzero((distance <= limit[:, None]) & (distance < np.inf))
                # those that were held and those that may be as near, in the order that counts
                q = np.concatenate((np.repeat(np.arange(len(own)), k), q))
                p = np.concatenate((who[own].reshape(-1), names[p]))
                score = np.concatenate((best[own].reshape(-1), cosines(queries[own[q[len(own) * k :]]], self.vectors[p[len(own) * k :]])))
                sort = np.lexsort((np.where(p >= 0, least[p], np.iinfo(np.int64).max), -score, q))
                place = np.arange(len(q)) - np.searchsorted(q[sort], q[sort])
                keep = sort[place < k]
                best[own], who[own] = score[keep].reshape(-1, k), p[keep].reshape(-1, k)
        return who, best


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = [x.as_buffer() for x in column]
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors that take part, as bytes: scaled so that the largest component is from 0.5 to 1."""
    for batch in batches:
        lists = batch.column("v")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
        bounds = lists.offsets.to_numpy().astype(np.int64)
        rows = np.flatnonzero(np.diff(bounds))
        start, size = bounds[rows] - bounds[0], np.diff(bounds)[rows]
        top = np.maximum.reduceat(np.abs(values), start) if len(rows) else np.zeros(0)
        good = np.isfinite(top) & (top > 0)
        rows, start, size, top = rows[good], start[good], size[good], top[good]
        # in two steps, as the power itself may be out of range; -0.0 and 0.0 are one value
        power = np.repeat(-np.frexp(top)[1], size)
        scaled = np.ldexp(np.ldexp(values[at.expand(start, size)], power // 2), power - power // 2) + 0.0
        ends = np.concatenate(([0], np.cumsum(8 * size)))
        vec = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(scaled)]).cast(pa.binary())
        keep = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(keep), batch.column("asks").take(keep), vec], ["vec_id", "asks", "vec"])


def nearest(vectors: DataFrame, query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, axes: int = 16, confidence: float = 0.97, sample: int = 20_000, block_rows: int = 4096, leaf_rows: int = 256, max_leaves: int = 1 << 16, chunk: int = 4096, growth: int = 4, seed: int = 11, visited: list[int] | None = None) -> DataFrame:
    """For the rows where ``query`` holds: query_id, rank (from 1), vec_id, score (cosine), among all other rows. visited: gets the number
    of visits of each wave."""
    spark, scratch = vectors.sparkSession, Scratch()
    written = scratch.written
    result = "query_id long, rank int, vec_id long, score double"
    components = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), components.alias("v"), F.coalesce(query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())

    valid = written(rows.mapInArrow(encode, "vec_id long, asks boolean, vec binary"), "vectors")
    sizes = valid.groupBy(F.octet_length("vec").alias("b")).count().orderBy(F.desc("count"), "b").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    dim = sizes[0].b // 8
    valid = valid.where(F.octet_length("vec") == dim * 8)
    first = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    pairs = valid.select("vec", "vec_id").distinct()
    distinct = pairs.withColumn("_n", first).where(F.col("_n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    matrix = projection(dim, axes, seed)

    share = min(1.0, 1.2 * sample / max(1, sizes[0]["count"]))
    some = valid.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("vec").limit(sample).collect()
    blocks = min(max_leaves, max(1, -(-sizes[0]["count"] // block_rows)))
    fan = max(1, min(max_leaves // blocks, block_rows // leaf_rows))  # leaves of a block
    splits = Splits(units(np.frombuffer(b"".join(bytes(r.vec) for r in some), np.float64).reshape(-1, dim)) @ matrix, blocks * fan)
    tree = spark.sparkContext.broadcast((splits, matrix))  # at most max_leaves splits
    stop = chi_square_quantile(confidence, axes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, m = tree.value
        for batch in batches:
            leaf = upper.leaves(units(_matrix(batch.column("vec"))) @ m) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((leaf // fan).astype(np.int32)), pa.array(leaf.astype(np.int32)), *(batch.column(c) for c in ("vec", "ids"))], ["block", "leaf", "vec", "ids"])

    index = written(distinct.mapInArrow(place, "block int, leaf int, vec binary, ids array<long>"), "vector-index")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tight boxes of the points that a task has of each leaf."""
        _, m = tree.value
        for batch in batches:
            if batch.num_rows:
                points = units(_matrix(batch.column("vec"))) @ m
                order, cut = at.in_parts(batch.column("leaf").to_numpy(), blocks * fan)
                own = np.flatnonzero(np.diff(cut))
                low, high = np.minimum.reduceat(points[order], cut[own]), np.maximum.reduceat(points[order], cut[own])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(x.tolist(), pa.list_(pa.float64())) for x in (low, high))], ["leaf", "low", "high"])

    edges = index.select("leaf", "vec").mapInArrow(bounds, "leaf int, low array<double>, high array<double>")
    each = lambda f, c: [f(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(axes)]
    boxes = edges.groupBy("leaf").agg(*each(F.min, "low"), *each(F.max, "high")).orderBy("leaf").collect()  # at most max_leaves
    numbers = np.array([list(r) for r in boxes], np.float64).reshape(len(boxes), -1)
    names, turn = np.unique(numbers[:, 0].astype(np.int64) // fan, return_index=True)
    # at most max_leaves boxes; a block's boxes follow each other from its turn on
    shared = spark.sparkContext.broadcast((matrix, names, turn, numbers[:, 1 : 1 + axes], numbers[:, 1 + axes :]))

    # equal vectors ask once; an id with several vectors asks for itself, and skips all that are its own
    asking = valid.where("asks").select("vec_id", "vec").distinct()
    several = pairs.join(asking.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("vec_id", F.col("vec_id").alias("skip"))
    asked = written(asking.join(several, "vec_id", "left"), "vector-asked")
    queries = written(index.select("block", "vec").join(asked.select("vec", "skip").distinct(), "vec").select("block", F.monotonically_increasing_id().alias("key"), "vec", "skip"), "vector-queries")

    parts = index.groupBy("block").agg(F.ceil(F.count("*") / (4 * block_rows)).cast("int").alias("parts"))

    def look(key: tuple, points: pa.Table, asks: pa.Table) -> pa.Table:
        m = shared.value[0]
        names, kinds = ["key", "score", "vec_id"], [pa.int64(), pa.float64(), pa.int64()]
        if not asks.num_rows or not points.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        vectors_, wanted = _matrix(points["vec"]), _matrix(asks["vec"])
        ids, skips = points["ids"].to_pylist(), asks["skip"].to_pylist()
        single, only = np.array([len(x) == 1 for x in ids]), np.array([x[0] for x in ids])
        skipping, skip = np.array([x is not None for x in skips]), np.array([x or 0 for x in skips])
        who, best = Block(vectors_, m).search(wanted, m, k + 1, stop, asks["bound"].to_numpy(), only, lambda q, p: skipping[q, None] & single[p] & (only[p] == skip[q, None]))
        own, place_ = np.nonzero(who >= 0)
        found: list[list[tuple]] = [[] for _ in range(len(wanted))]
        for q, h, s in zip(own.tolist(), who[own, place_].tolist(), best[own, place_].tolist(), strict=True):
            found[q] += [(-s, i) for i in ids[h] if i != skips[q]]
        keys, lists = asks["key"].to_pylist(), [sorted(f)[: k + 1] for f in found]
        return pa.Table.from_arrays([pa.array([x for x, f in zip(keys, lists, strict=True) for _ in f], pa.int64()), pa.array([-s for f in lists for s, _ in f], pa.float64()), pa.array([i for f in lists for _, i in f], pa.int64())], names)

    def searched(asks: DataFrame, name: str) -> DataFrame:
        """Each query against its block, at most k + 1 hits of each: cells of a part of the block's points and a chunk of its queries."""
        cells = written(asks.groupBy("block").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).join(parts, "block"), f"{name}-cells")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        points = index.join(cells, "block").select("block", "vec", "ids", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int").alias("part"), every("chunks").alias("chunk"))
        dealt = asks.join(cells, "block").select(*asks.columns, F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"), every("parts").alias("part"))
        key = ["block", "part", "chunk"]
        return points.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(look, "key long, score double, vec_id long")

    def visits(batches: Iterator[pa.RecordBatch], start: int, count: int) -> Iterator[pa.RecordBatch]:
        """Of each query's blocks in order of projected distance (without its own) the next ones, as far as the stopping test lets it go."""
        m, blocks_, turns, low, high = shared.value
        kinds = {"block": pa.int32(), "key": pa.int64(), "vec": pa.binary(), "skip": pa.int64(), "bound": pa.float64()}
        for batch in batches:
            if not batch.num_rows:
                continue
            points, bound = units(_matrix(batch.column("vec"))) @ m, batch.column("bound").to_numpy()
            base, which, near = batch.column("block").to_numpy(), [], []
            for i in range(len(points)):
                away = np.minimum.reduceat(reach(points[i], low, high), turns)  # the nearest of a block's boxes
                away[np.searchsorted(blocks_, base[i])] = -1
                order = np.argsort(away, kind="stable")[start + 1 : start + 1 + count]
                near.append(blocks_[order[away[order] <= bound[i] * stop + ROUNDING]])
                which.append(np.full(len(near[-1]), i))
            take = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(near).astype(np.int32)), *(batch.column(c).take(take) for c in ("key", "vec", "skip", "bound"))], schema=pa.schema(kinds.items()))

    best = lambda hits: hits.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1).drop("_n")
    # waves: the home block, then growing numbers of the next ones; what was found bounds what is visited then
    top = written(best(searched(queries.withColumn("bound", F.lit(float("inf"))), "vector-home")), "vector-top-0")
    start, count, wave = 0, growth, 0
    while start < len(names) - 1:
        wave += 1
        held = top.groupBy("key").agg(F.count("*").alias("_n"), F.min("score").alias("_s")).where(F.col("_n") > k).select("key", F.greatest(F.lit(0.0), 2 - 2 * F.col("_s")).alias("_b"))
        known = queries.join(held, "key", "left").withColumn("bound", F.coalesce("_b", F.lit(float("inf")))).select("block", "key", "vec", "skip", "bound")
        next_ = written(known.mapInArrow(lambda b, s=start, n=count: visits(b, s, n), "block int, key long, vec binary, skip long, bound double"), f"vector-visits-{wave}")
        seen = next_.count()
        if visited is not None:
            visited.append(seen)
        if not seen:
            break
        # each visit gives at most k + 1 hits
        top = written(best(top.unionByName(searched(next_, f"vector-wave-{wave}"))), f"vector-top-{wave}")
        scratch.drop(valid, f"vector-visits-{wave}", f"vector-wave-{wave}-cells", f"vector-top-{wave - 1}")
        start, count = start + count, count * growth
    listed = top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("top"))
    same = (F.col("a.vec") == F.col("q.vec")) & F.col("a.skip").eqNullSafe(F.col("q.skip"))
    keys = asked.alias("a").join(queries.alias("q"), same).select(F.col("a.vec_id").alias("query_id"), "q.key")
    own = keys.join(listed, "key").select("query_id", F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    return own.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.minus")).alias("score"))
