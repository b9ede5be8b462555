"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors with multiplicities.

Each component x becomes the integer floor(scale * x). Vectors that are equal then are one *distinct vector* with a weight, so a
group of copies, however large, is one row and is summed by one multiplication. A round assigns each distinct vector to
its nearest centroid (squared Euclidean distance; ties go to the smaller number) and sums, for each centroid, weight times
components in integers: tasks send one row for each centroid and share of the distinct vectors, Spark adds these up, and
the driver divides ``k`` sums, rounding down. A centroid without vectors stays. At last the assignments are joined
back to the vectors' ids.

Centroids 0, 1, ... begin as the kept vectors with the smallest hexadecimal sha256 of ``seed:id``; ties go to the smaller
vector (as bytes). A null id stands for the text ``null`` there.

Distances are exact: while all numbers are below 2**22, products of doubles are whole; beyond that integers are used.
Components are held to +-2**27, where squared distances of 64 components still fit 64 bits.

Vectors that are null, of another length than ``dim``, or that hold null or non-finite components take no part and have no
row. Rows that repeat an id, or repeat wholly, each count and are each returned. With fewer vectors than ``k`` there are
as many centroids as vectors. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_folder import Scratch

#: Bound of the quantised components, and of those whose distances are computed as products of doubles.
BOUND, SMALL = 1 << 27, 1 << 22


def _quantise(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("v")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
        x = values.reshape(-1, dim)
        keep = np.flatnonzero(np.isfinite(x).all(axis=1))
        whole = np.clip(np.floor(np.clip(x[keep], -BOUND, BOUND) * scale), -BOUND, BOUND).astype("<i4")
        vec = pa.array([row.tobytes() for row in whole], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), vec], ["vec_id", "vec"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "<i4").reshape(-1, dim)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid and the squared distance, in whole numbers."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < SMALL:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        distance = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None]
    else:
        a, c = x.astype(np.int64), centroids.astype(np.int64)
        distance = np.stack([((a - one) ** 2).sum(axis=1) for one in c], axis=1)
    who = distance.argmin(axis=1)
    return who, distance[np.arange(len(x)), who].astype(np.int64)


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, list[list[int]]]:
    """A row for each vector that takes part: vec_id, cluster, distance (squared), cluster_inertia and inertia (distances summed
    over the cluster and over all; null beyond 64 bits); and the centroids."""
    spark, scratch = vectors.sparkSession, Scratch()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dim)
    kind = rows.schema["vec_id"].dataType.simpleString()
    valid = scratch.written(rows.mapInArrow(lambda b: _quantise(b, dim, scale), f"vec_id {kind}, vec binary"), "quantised")
    distinct = scratch.written(valid.groupBy("vec").agg(F.count("*").alias("weight")), "distinct-vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = valid.select(drawn.alias("drawn"), "vec").orderBy("drawn", "vec").limit(k).collect()  # k vectors
    centroids = [np.frombuffer(bytes(r.vec), "<i4").tolist() for r in first]

    def round_of(now: list[list[int]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(np.array(now, np.int64))  # k vectors

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(shared.value.shape, np.int64), np.zeros(len(shared.value), np.int64)
            limit = 1 << 62 - BOUND.bit_length()  # of the weights whose sums surely fit
            out = lambda: pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count)), pa.array(total[count > 0].tolist(), pa.list_(pa.int64())), pa.array(count[count > 0])], ["cluster", "sums", "n"])
            for batch in batches:
                x, weight = _matrix(batch.column("vec"), dim), batch.column("weight").to_numpy()
                if not len(x):
                    continue
                if int(count.sum()) + int(weight.sum()) > limit:
                    yield out()
                    total[:], count[:] = 0, 0
                who, _ = nearest(x, shared.value)
                np.add.at(total, who, x * weight[:, None])
                np.add.at(count, who, weight)
            yield out()

        return distinct.mapInArrow(sums, "cluster long, sums array<long>, n long")

    for _ in range(rounds if centroids else 0):
        parts = round_of(centroids)
        whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        axes = parts.select("cluster", "n", F.posexplode("sums").alias("axis", "sum")).groupBy("cluster", "axis").agg(whole("sum"), whole("n"))
        for r in axes.collect():  # k times dim numbers
            centroids[r.cluster][r.axis] = int(r["sum"]) // int(r.n)

    shared = spark.sparkContext.broadcast(np.array(centroids, np.int64).reshape(-1, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                who, distance = nearest(_matrix(batch.column("vec"), dim), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("weight"), pa.array(who.astype(np.int32)), pa.array(distance)], ["vec", "weight", "cluster", "distance"])

    assigned = scratch.written(distinct.mapInArrow(assign, "vec binary, weight long, cluster int, distance long"), "assigned")
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight")).alias("d"))
    inertia = {r.cluster: int(r.d) for r in by_cluster.collect()}  # k numbers
    longs = lambda x: x if x < 1 << 63 else None
    sums = spark.createDataFrame([(c, longs(d), longs(sum(inertia.values()))) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long")
    back = valid.join(assigned.select("vec", "cluster", "distance"), "vec")
    return back.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def centroid_hash(centroid: list[int]) -> str:
    """Hexadecimal sha256 of the components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
