"""Centroid clustering in whole numbers, with a distance matrix that follows the centroids.

Vectors become integers once.  Beside each vector its squared length and its dot product with every centroid
are kept, exact in 64 bits.  The squared distance to a centroid is ``|v|^2 - 2 v.c + |c|^2``, so a round reads its
argmin off the stored products.  When centroids move, a product changes by the vector times the change of the
centroid, and only the components that did change enter; centroids that stayed cost nothing, and once
none moves, all later rounds are known.  The updated products are written as the next table, whose
predecessor goes.  Sums per cluster are one aggregation of a few rows; the driver holds centroids, never vectors.

The first centroids are the ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>``; a round assigns every vector
to the nearest centroid (ties: the smaller number) and replaces each centroid that has vectors by the
floor of their mean, component by component.  The rounds end with one more assignment.

Only vectors of ``dim`` components take part, none of them null or non-finite.  Their integers must have fewer than
``BITS`` bits, or distances would not be exact in 64 bits; vectors beyond that take no part either.  A row without id is
assigned but starts no centroid; rows that repeat an id each count, and may start a centroid each (equal
hashes: the smaller vector first).  Fewer vectors than ``k`` give fewer centroids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import remove_scratch
from cpgloom.session import materialize

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, "3"
BITS = 27
STATE = "vec_id long, v array<int>, norm long, dots array<long>, cluster int, distance long"


def integers(vectors: DataFrame, vec_id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v``, the floor of ``scale`` times each component, of the vectors that take part."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    good = (F.size("x") == dim) & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) >= 2.0 ** (BITS - 1)))
    return rows.where(good).select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))


def _follow(state: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """The table after the centroids went from ``old`` to ``new``: products updated, argmin read off them."""
    k, dim = new.shape
    # Without products yet, the centroids come from zero.
    change = new if old is None else new - old
    moved = [(j, np.flatnonzero(change[j])) for j in range(k) if change[j].any()]
    lengths = (new * new).sum(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dim, np.int64)
            norm = (v * v).sum(1) if old is None else batch.column("norm").to_numpy()
            dots = np.zeros((len(v), k), np.int64) if old is None else _matrix(batch.column("dots"), k, np.int64).copy()
            for j, at in moved:
                dots[:, j] += v[:, at] @ change[j, at]
            near = lengths - 2 * dots
            cluster = near.argmin(1)  # the first of equal ones
            distance = norm + near[np.arange(len(v)), cluster]
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("v"), pa.array(norm), _lists(dots), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["vec_id", "v", "norm", "dots", "cluster", "distance"],
            )

    columns = ["vec_id", "v"] if old is None else ["vec_id", "v", "norm", "dots"]
    return state.select(*columns).mapInArrow(work, STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each cluster; a cluster without vectors keeps its centroid."""
    dim = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dim)]).alias("sums"))
    out = centroids.copy()
    for row in sums.collect():  # one row per centroid
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def start(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order."""
    keyed = rows.where("vec_id is not null").withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["v"] for r in keyed.orderBy("_hash", "v").limit(k).collect()], np.int64)  # k rows


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``v`` (the integers), ``cluster`` and ``distance`` (squared) of every vector, and the final centroids."""
    spark = vectors.sparkSession
    room = f"centroids-{uuid.uuid4().hex}"
    rows = materialize(integers(vectors, vec_id, vector, dim, scale), f"{room}/vectors")
    centroids = start(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], STATE).select("vec_id", "v", "cluster", "distance"), np.zeros((0, dim), np.int64)
    old, state = None, rows
    for turn in range(rounds + 1):
        label = f"centroids-{uuid.uuid4().hex}"
        state = materialize(_follow(state, old, centroids), f"{label}/state")
        remove_scratch(spark, room)
        room = label
        new = centroids if turn == rounds else _means(state, centroids)
        if (new == centroids).all():
            break
        old, centroids = centroids, new
    return state.select("vec_id", "v", "cluster", "distance"), centroids


def summarised(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with the inertia of its cluster and of all, and the digest of its centroid.  A sum beyond 64 bits is null."""
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row per centroid
    inertia = sum(int(r["s"]) for r in sums)
    rows = []
    for r in sums:
        digest = hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()
        rows.append((r["cluster"], *[x if x < 1 << 63 else None for x in (int(r["s"]), inertia)], digest))
    small = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(small), "cluster")  # at most one row per centroid
