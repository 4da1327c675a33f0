"""Merkle manifest of a dataset: leaves, roots and inclusion proofs from concatenated levels.

A leaf is the SHA-256 of a row; within each group (a source) leaves ascend by id, and every ``FAN`` consecutive
nodes become the digest of their concatenated hex digests until one is left.  The groups' roots, ordered
by group, go through the same tree and give the root of the dataset.

Nodes are cut into aligned blocks of ``FAN ** 2``.  A block is one row that keeps each of its levels as one hex
string: level 0 has the digests of its nodes end to end, and the parents' level is made by hashing
substrings of ``FAN`` digests.  The siblings of a node are what flanks its digest in its run: two substrings.
What is left of a block is one digest, the blocks' digests are the nodes of the next turn, and so on until
every group has one.  A turn shrinks the nodes ``FAN ** 2`` times, and a block is at most 16 KB of text, so no task
holds a group, however large it is.  A node's path is its flanks in its block and then its block's path.

Nulls: a null field is written as ``-``; a null group is a group and comes first; a null id sorts first.
Rows that agree in group and id are ordered by leaf; equal leaves have the same path up to their place, and
each row keeps its own.  Long texts are hashed whole.  An empty table has no root and gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import same
from cpgloom.operators.ordering import numbered
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

FAN = 16
BLOCK = FAN * FAN
HEX = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its size in bytes, a colon and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _digest(level: Column, at: Column | int, count: Column | int) -> Column:
    """``count`` digests of a level from place ``at`` (from 0) on; fewer where the level ends."""
    at, count = (x if isinstance(x, Column) else F.lit(x) for x in (at, count))
    return F.substring(level, (at * HEX + 1).cast("int"), (count * HEX).cast("int"))


def _flanks(level: Column, place: Column) -> Column:
    """What stands before and after a node in its run."""
    run = F.floor(place / FAN) * FAN
    return F.struct(_digest(level, run, place - run).alias("before"), _digest(level, place + 1, run + FAN - 1 - place).alias("after"))


def _blocks(nodes: DataFrame, group: list[str], carry: Sequence[str] = ()) -> DataFrame:
    """Nodes (``pos`` from 0, ``hash``, ``n`` of the group) as blocks: levels ``l0``, ``l1`` and ``top``, and arrays of ``carry``."""
    by_pos = F.sort_array(F.collect_list(F.struct("pos", "hash", *carry)))
    cut = nodes.groupBy(*group, "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(by_pos.alias("_nodes"))
    cut = cut.withColumn("l0", F.array_join(F.col("_nodes.hash"), ""))
    runs = F.sequence(F.lit(0), F.ceil(F.size("_nodes") / FAN).cast("int") - 1)
    cut = cut.withColumn("l1", F.array_join(F.transform(runs, lambda i: F.sha2(_digest(F.col("l0"), i * FAN, FAN), 256)), ""))
    # A group ends as soon as one node is left.
    top = F.when(F.col("n") == 1, F.col("l0")).when(F.col("n") <= FAN, F.col("l1")).otherwise(F.sha2("l1", 256))
    return cut.withColumn("top", top)


def _inner_path(place: Column) -> Column:
    """Flanks of the node at ``place`` of its block, by level."""
    none = F.array().cast("array<struct<before:string,after:string>>")
    first, second = _flanks(F.col("l0"), place), _flanks(F.col("l1"), F.floor(place / FAN))
    return F.when(F.col("n") == 1, none).when(F.col("n") <= FAN, F.array(first)).otherwise(F.array(first, second))


def _climb(blocks: DataFrame, group: list[str], largest: int) -> DataFrame:
    """``group``, ``block``, the path from the block's digest to the group's root (``up``) and that root (``peak``)."""
    none = F.array().cast("array<struct<before:string,after:string>>")
    if largest <= BLOCK:
        return blocks.select(*group, "block", none.alias("up"), F.col("top").alias("peak"))
    small = blocks.where(F.col("n") <= BLOCK).select(*group, "block", none.alias("up"), F.col("top").alias("peak"))
    nodes = blocks.where(F.col("n") > BLOCK)
    nodes = nodes.select(*group, F.col("block").alias("pos"), F.col("top").alias("hash"), F.ceil(F.col("n") / BLOCK).alias("n"))
    above = materialize(_blocks(nodes, group), "merkle-level")
    higher = sized(_climb(above, group, -(-largest // BLOCK)))
    met = same(above, higher, [*group, "block"])
    each = met.withColumn("_place", F.explode(F.sequence(F.lit(0), F.size("_nodes") - 1)))
    paths = each.select(
        *group, F.get(F.col("_nodes.pos"), F.col("_place")).alias("block"), F.concat(_inner_path(F.col("_place")), "up").alias("up"), "peak"
    )
    return small.unionByName(paths)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(
    rows: DataFrame,
    fields: Sequence[str] = FIELDS,
    doc_id: str = "doc_id",
    group: str = "source",
    tampered: Column | None = None,
) -> DataFrame:
    """One row per row: ``doc_id`` and ``source`` (the id and the group), ``leaf``, ``subroot``, ``root``, ``path`` (from the
    leaf up: structs of the siblings ``before`` and ``after`` as hex), ``proof_sha256`` and ``folded_root``.

    ``tampered`` is a digest that replaces a row's leaf when its root is folded again (null: its leaf).
    """
    digest = leaf([F.col(f"`{c}`") for c in fields])
    other = F.lit(None).cast("string") if tampered is None else tampered
    leaves = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{group}`").alias("source"), digest.alias("hash"), other.alias("other"))
    # A leaf that was not tampered with travels once.
    leaves = leaves.withColumn("other", F.when(F.col("other") != F.col("hash"), F.col("other")))
    # Numbering reads its input twice; texts should be hashed once.
    leaves = materialize(leaves, "merkle-hashes")
    placed = numbered(leaves, ["source"], ["doc_id", "hash"], "_rn", "n").withColumn("pos", F.col("_rn") - 1).drop("_rn")
    blocks = materialize(_blocks(placed, ["source"], ["doc_id", "other"]), "merkle-leaves")
    largest = blocks.agg(F.max("n")).first()[0] or 0
    climbed = materialize(_climb(blocks.drop("_nodes"), ["source"], largest), "merkle-paths")

    peaks = climbed.where("block = 0").select("source", F.col("peak").alias("hash"))
    ordered = numbered(peaks, [], ["source"], "_rn", "n").select("source", F.lit(0).alias("_all"), (F.col("_rn") - 1).alias("pos"), "hash", "n")
    groups = _blocks(ordered, ["_all"], ["source"])
    groups = materialize(groups, "merkle-groups")
    over = sized(_climb(groups, ["_all"], groups.agg(F.max("n")).first()[0] or 0))
    each = same(groups, over, ["_all", "block"]).withColumn("_place", F.explode(F.sequence(F.lit(0), F.size("_nodes") - 1)))
    roots = each.select(
        F.get(F.col("_nodes.source"), F.col("_place")).alias("source"),
        F.concat(_inner_path(F.col("_place")), "up").alias("_over"),
        F.col("peak").alias("root"),
    )

    met = same(same(blocks, sized(climbed), ["source", "block"]), sized(roots), ["source"])
    each = met.withColumn("_place", F.explode(F.sequence(F.lit(0), F.size("_nodes") - 1)))
    node = F.get(F.col("_nodes"), F.col("_place"))
    out = each.select(
        "source", node.alias("_node"), F.col("peak").alias("subroot"), "root", F.concat(_inner_path(F.col("_place")), "up", "_over").alias("path")
    )
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return out.select(
        F.col("_node.doc_id").alias("doc_id"),
        "source",
        F.col("_node.hash").alias("leaf"),
        "subroot",
        "root",
        "path",
        F.sha2(proof, 256).alias("proof_sha256"),
        fold(F.coalesce("_node.other", "_node.hash"), F.col("path")).alias("folded_root"),
    )


def lowered(doc_id: str = "doc_id", text: str = "text", fields: Sequence[str] = FIELDS) -> Column:
    """The tampering of the registered query: where 5 divides the CRC-32 of the id, ``text`` with A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = [F.translate(c, upper, upper.lower()) if c == text else F.col(c) for c in fields]
    return F.when(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, leaf(changed))
