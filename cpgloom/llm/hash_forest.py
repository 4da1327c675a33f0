"""Approximate nearest neighbours by a hash-prefix forest.

Each vector has one long string of hash bits per tree: signs of random projections, after the mean of the
index is taken off.  A tree is the array of these strings in order; rows that share a prefix are
neighbours in it.  A query descends in each tree to the rows that share its longest prefix, and then all
trees ascend together, one bit at a time and in step, until the rows reached in all trees are enough: the
share ``share`` of the index for each tree, counted with repeats.  These rows are compared exactly, in double
precision, on the original vectors, and each tree keeps the best of each query.

Distributed form: one aggregation counts the rows under every prefix of up to ``depth`` bits, which grows with the
index so that a node of that depth holds about ``LEAF`` rows.  These counts give each query its common prefix
length without touching the rows.  Rows are dealt by (tree, prefix of ``depth`` bits), larger nodes in
several parts; a query goes to the nodes below its prefix, where its distances are computed and all
but the best dropped, so no pairs are shuffled.

A vector travels once per tree, in the index's own number type.  A block of queries meets the rows of a part in one
matrix product, which tells the nearest up to rounding; only those within reach of it get exact distances.

How much must be compared depends on the vectors.  On vectors without directions of their own (64 nearly independent
components) the prefixes of any number of trees reach nine tenths of the nearest rows only with most of the index.

Equal vectors are one entry; the result lists the rows of an entry one by one, ties by smaller id.  Vectors
that are null, zero, or hold null or non-finite components take no part, as rows and as queries, nor do
rows without an id.  Only vectors of the commonest length take part (the shorter of equally common ones).
Rows that repeat an id count each time; a query is never its own neighbour.  An empty table, or one without
usable vectors, gives no rows.  Components of any finite size keep their order: differences whose squares
would leave the range of doubles are scaled by a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

TREES, BITS, LEAF, SHARE, SEED = 12, 48, 2000, 0.08, 7
# Beyond these sizes squares leave the range of doubles; such differences are scaled first.
HUGE, TINY = 1e140, 1e-140
# Queries in one matrix product.
BLOCK = 64


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(vector)
    number = F.transform(v, lambda x: x.cast("double"))
    good = ~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(number, lambda x: x != 0)
    rows = vectors.where(F.col(vec_id).isNotNull() & v.isNotNull()).where(good)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.join(F.broadcast(length), F.size("v") == F.col("d")).select("vec_id", "v")


def _coded(rows: DataFrame, mean: np.ndarray, trees: int, depth: int, seed: int) -> DataFrame:
    """``id``, vector and, per tree, the first ``depth`` bits of its hash string."""
    planes = np.random.default_rng(seed).standard_normal((len(mean), trees * BITS)).reshape(len(mean), trees, BITS)[:, :, :depth]
    planes = np.ascontiguousarray(planes).reshape(len(mean), trees * depth)
    weights = 1 << np.arange(depth - 1, -1, -1, dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                x = x if x.dtype == np.float32 else x.astype(np.float64)
                bits = ((x.astype(np.float64) - mean) @ planes > 0).reshape(len(x), trees, depth)
                code = (bits * weights).sum(2)
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.record_batch([part.column("id"), packed, pa.array(list(code), pa.list_(pa.int64()))], ["id", "x", "codes"])

    return rows.mapInArrow(work, "id long, x binary, codes array<long>")


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances of the rows of ``x`` to ``q``."""
    with np.errstate(over="ignore", under="ignore"):
        dist = np.sqrt(((x - q) ** 2).sum(1))
        for i in np.flatnonzero((dist > HUGE) | (dist < TINY)):
            half = x[i] / 2 - q / 2  # a difference of doubles may itself overflow
            power = int(np.frexp(np.abs(half).max())[1])
            dist[i] = np.ldexp(np.sqrt((np.ldexp(half, -power) ** 2).sum()), power + 1)
    return dist


def nearest(x: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, the rows of ``x`` that are among its ``k`` nearest, all that tie with the last one too, and their distances."""
    large = max(np.abs(x).max(initial=0.0), np.abs(queries).max(initial=0.0))
    plain = TINY < large < HUGE and len(x) > k
    if plain:
        norms = np.einsum("ij,ij->i", x, x)
        slack = 1e-12 * x.shape[1] * large**2
    for i in range(0, len(queries), BLOCK):
        block = queries[i : i + BLOCK]
        if plain:
            rough = norms - 2.0 * (block @ x.T)  # the squared distance less a term of the query's own
            reach = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
        for j, q in enumerate(block):
            near = np.flatnonzero(rough[j] <= reach[j]) if plain else np.arange(len(x))
            dist = distances(x[near], q)
            if len(dist) > k:
                keep = dist <= np.partition(dist, k - 1)[k - 1]
                near, dist = near[keep], dist[keep]
            yield near, dist


def _by_tree(coded: DataFrame, *more: str) -> DataFrame:
    return coded.select("id", "x", *more, F.posexplode("codes").alias("tree", "node"))


def _levels(queries: DataFrame, nodes: DataFrame, trees: int, depth: int, need: int) -> DataFrame:
    """Each query's common prefix length: the longest under which all trees together hold ``need`` rows."""
    up = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    at = F.expr("shiftright(node, cast(%d - level as int))" % depth)
    under = nodes.select("tree", "node", "rows", up).groupBy("tree", "level", at.alias("prefix")).agg(F.sum("rows").alias("rows"))
    asked = _by_tree(queries).select("id", "tree", "node", up).select("id", "tree", "level", at.alias("prefix"))
    reached = asked.join(under, ["tree", "level", "prefix"]).groupBy("id", "level").agg(F.sum("rows").alias("rows"))
    return reached.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("rows") >= need, F.col("level"))), F.lit(0)).alias("level"))


def neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    share: float = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """The ``k`` nearest rows found for each row that ``is_query`` (on ``vec_id``) picks, against all other rows:
    ``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` (Euclidean distance)."""
    rows = materialize(_usable(vectors, vec_id, vector), "vectors")
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    entries = rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    entries = materialize(entries.withColumn("id", F.monotonically_increasing_id()), "entries")
    size = entries.count()
    if not size:
        return spark.createDataFrame([], schema)
    d = len(entries.first()["v"])
    kind = np.float32 if entries.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    sums = entries.select(F.posexplode("v").alias("i", "y")).groupBy("i").agg(F.avg(F.col("y").cast("double")).alias("m"))
    mean = np.zeros(d)
    for r in sums.collect():  # one row per dimension
        mean[r.i] = r.m
    depth = int(min(BITS, max(6, np.ceil(np.log2(size / LEAF)) + 1)))
    need = trees * int(max(4 * k, np.ceil(share * size)))
    index = materialize(_coded(entries.select("id", "v"), mean, trees, depth, seed), "codes")
    asked = rows.where(is_query).select(F.col("vec_id").alias("id"), "v").dropDuplicates()
    queries = materialize(_coded(asked, mean, trees, depth, seed), "queries")
    nodes = materialize(_by_tree(index).groupBy("tree", "node").agg(F.count("*").alias("rows")), "nodes")
    level = _levels(queries, nodes, trees, depth, need)
    parts = nodes.select("tree", "node", F.ceil(F.col("rows") / (2 * LEAF)).cast("int").alias("parts"))
    dealt = _by_tree(index).join(sized(parts), ["tree", "node"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    span = F.expr("shiftleft(1L, cast(%d - level as int))" % depth)
    low = F.expr("shiftleft(shiftright(node, cast(%d - level as int)), cast(%d - level as int))" % (depth, depth))
    sent = _by_tree(queries).join(sized(level), "id").select("id", "x", "tree", low.alias("low"), (low + span - 1).alias("high"))
    below = sized(parts)
    sent = sent.join(below.withColumnsRenamed({"tree": "t2"}), (F.col("tree") == F.col("t2")) & F.col("node").between(F.col("low"), F.col("high")))
    sent = sent.select("id", "x", "tree", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            x, asked = (np.frombuffer(b"".join(t["x"]), kind).reshape(len(t), d).astype(np.float64) for t in (rows, queries))
            ids = rows["id"].to_numpy()
            # One more than asked for: a query's own entry may hold no other row.
            for q, (near, dist) in zip(queries["id"], nearest(x, asked, k + 1), strict=True):
                out.append(pd.DataFrame({"query_id": q, "id": ids[near], "dist": dist}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "dist": []})

    key = ["tree", "node", "part"]
    found = dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(best, "query_id long, id long, dist double")
    found = found.groupBy("query_id", "id").agg(F.min("dist").alias("score"))
    # Rows of the entries: as many of the smallest ids as a result could need.
    by_id = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k + 1)
    members = members.join(entries.select("v", "id"), "v").select("id", "vec_id")
    found = found.withColumn("_r", F.rank().over(Window.partitionBy("query_id").orderBy("score"))).where(F.col("_r") <= k + 1).drop("_r")
    every = found.join(members, "id").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    top = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")
