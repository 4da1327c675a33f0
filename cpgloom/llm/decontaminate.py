"""Benchmark decontamination: a distributed positional inverted index over the training documents.

The index is sharded by document: each row holds, for some megabytes of text, the sorted token positions
(postings) of every indexed term, in one coordinate that runs through the shard with gaps between
documents.  A search sends the test windows to all shards.  In each shard a window starts from the
postings of its rarest term, shifted by the term's offset, and intersects the other terms' shifted lists
from rare to common, so a window with a term that the shard lacks costs one look-up.  What is left
are the starts of exact phrase matches; with ``slop`` each term may lie that many words off its place.

Test items are one block while their text is within ``BLOCK_BYTES``; then the index keeps only terms
that some item uses, for no other can take part in a match.  More items are dealt to several blocks by
hash, the index keeps all terms, and the results of the blocks are merged for each document.

Nulls: a null text has no words; items without words or id match nothing.  Repeated items count once,
repeated documents one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgloom.llm.common import ALNUM, bounded, slices, texts
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

WINDOW = 10
BLOCK_BYTES = 16 << 20
# Unused positions between documents; a match can't span two.
GAP = 64

INDEX = "doc_id array<long>, key array<long>, first array<int>, words array<int>, terms array<binary>, ends array<int>, postings array<int>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def _shard(rows: list[bytes], wanted: frozenset[bytes] | None) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """First position and word count of each text, then terms, ends of their lists, and postings."""
    number: dict[bytes, int] = {} if wanted is None else {w: i for i, w in enumerate(sorted(wanted))}
    first, count = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
    ids, at, start = [], [], 0
    for r, text in enumerate(rows):
        words = words_of(text)
        if wanted is None:
            found = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        else:
            found = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
        place = np.flatnonzero(found >= 0)
        ids.append(found[place])
        at.append((place + start).astype(np.int32))
        first[r], count[r] = start, len(words)
        start += len(words) + GAP
    every, where = np.concatenate(ids), np.concatenate(at)
    order = np.argsort(every, kind="stable")
    sizes = np.bincount(every, minlength=len(number))
    used = np.flatnonzero(sizes)
    names = list(number)
    return first, count, [names[i] for i in used], np.cumsum(sizes[used]).astype(np.int32), where[order]


def build_index(docs: DataFrame, wanted: frozenset[bytes] | None = None, text: str = "text") -> DataFrame:
    """The positional index of ``docs``, one row a shard (columns as in ``INDEX``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            first, count, terms, ends, postings = _shard(texts(batch.column("t")), wanted)
            lists = [batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), first, count, terms, ends, postings]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
            names = ["doc_id", "key", "first", "words", "terms", "ends", "postings"]
            yield pa.record_batch([pa.array([v], pa.list_(k)) for v, k in zip(lists, kinds, strict=True)], names)

    keyed = bounded(docs).select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("t"))
    return keyed.mapInArrow(work, INDEX)


class Windows:
    """The distinct windows of a block of items, by length, as term numbers, with the items that have them."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.terms: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                seen.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.groups = [
            (n, np.array([w for w in seen if len(w) == n], np.int32), [sorted(v) for w, v in seen.items() if len(w) == n])
            for n in sorted({len(w) for w in seen})
        ]

    def matches(self, shard: dict, slop: int = 0) -> Iterator[tuple[int, list[int], np.ndarray]]:
        """Length, items and start positions of every window that occurs in the shard."""
        lists: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.terms)
        begin = 0
        for term, end in zip(shard["terms"], shard["ends"], strict=True):
            if (k := self.terms.get(term)) is not None:
                lists[k] = shard["postings"][begin:end].astype(np.int64)
            begin = end
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        for n, windows, items in self.groups:
            counts = size[windows]
            for w in np.flatnonzero(counts.min(1) > 0):
                rare_first = np.argsort(counts[w], kind="stable")
                start = lists[windows[w, rare_first[0]]] - rare_first[0]
                for o in rare_first[1:]:
                    other = lists[windows[w, o]] - o
                    near = np.searchsorted(other, start - slop)
                    start = start[(near < len(other)) & (other[np.minimum(near, len(other) - 1)] <= start + slop)]
                    if not len(start):
                        break
                if len(start):
                    yield n, items[w], start


def _found(batch: pa.RecordBatch, windows: Windows, slop: int, length: int) -> Iterator[pa.RecordBatch]:
    for i in range(batch.num_rows):
        shard = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("first", "words", "ends", "postings")}
        shard["terms"] = batch.column("terms")[i].as_py()
        ids, keys = batch.column("doc_id")[i].as_py(), batch.column("key")[i].as_py()
        first, words = shard["first"].astype(np.int64), shard["words"].astype(np.int64)
        step = np.zeros(int(first[-1] + words[-1]) + length + 2, np.int32)
        items: list[set[int]] = [set() for _ in ids]
        for n, owners, start in windows.matches(shard, slop):
            row = np.searchsorted(first, start, "right") - 1
            inside = (row >= 0) & (start + n <= first[row] + words[row])
            np.add.at(step, start[inside], 1)
            np.add.at(step, start[inside] + n, -1)
            for r in np.unique(row[inside]):
                items[r].update(owners)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(step) > 0, [0])).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        row = np.searchsorted(first, begin, "right") - 1
        runs: list[list[dict]] = [[] for _ in ids]
        for r, b, e in zip(row, begin - first[row], end - first[row], strict=True):
            runs[r].append({"from": int(b), "to": int(e)})
        yield pa.record_batch(
            [
                pa.array([batch.column("shard")[i].as_py()] * len(ids), pa.int64()),
                pa.array(range(len(ids)), pa.int32()),
                pa.array(ids, pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array(words, pa.int64()),
                pa.array(runs, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                pa.array([sorted(s) for s in items], pa.list_(pa.int64())),
            ],
            ["shard", "row", "doc_id", "key", "n_words", "runs", "items"],
        )


def search(index: DataFrame, blocks: Iterable[Windows], slop: int = 0, length: int = WINDOW, stored: bool = False) -> DataFrame:
    """For every document: ``n_words``, the covered ``runs`` of words (from, to: end exclusive) and the ``items``.

    With ``stored``, the hits of a block are written before the next one is made, so that the driver holds one.
    """
    schema = "shard long, row int, doc_id long, key long, n_words long, runs array<struct<from:int,to:int>>, items array<long>"
    found = None
    for windows in blocks:

        def work(batches: Iterator[pa.RecordBatch], windows: Windows = windows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _found(batch, windows, slop, length)

        part = index.mapInArrow(work, schema)
        part = materialize(part, "hits") if stored else part
        found = part if found is None else found.unionByName(part)
    return found.groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("key").alias("key"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def _block_count(items: DataFrame, text: str) -> tuple[DataFrame, int]:
    """Distinct items, stored, and the number of blocks of about ``BLOCK_BYTES`` that they make."""
    rows = materialize(items.where("item_id is not null").select("item_id", F.col(text).alias("t")).distinct(), "items")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 32), F.lit(0))).first()[0]
    return rows, -(-total // BLOCK_BYTES) or 1


def _blocks(rows: DataFrame, n: int, width: int) -> Iterator[Windows]:
    """The blocks, each collected when the one before it is done with."""
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(n)) == k).collect()
        yield Windows(sorted((r.item_id, (r.t or "").encode()) for r in block), width)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = 0, text: str = "text") -> DataFrame:
    """Search the windows of ``items`` (item_id, text) in ``docs``; result as of ``search`` with ``n_hit`` words."""
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    rows, n = _block_count(items, text)
    blocks: Iterable[Windows] = _blocks(rows, n, width)
    if n == 1:
        blocks = list(blocks)
    wanted = frozenset(blocks[0].terms) if n == 1 else None
    index = materialize(build_index(docs, wanted, text).withColumn("shard", F.monotonically_increasing_id()), "index")
    # Runs of several blocks may overlap: a run adds what reaches beyond the furthest end so far.
    cover = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, r: F.struct(
            F.greatest(a["end"], r["to"]).alias("end"),
            (a["n"] + F.greatest(r["to"] - F.greatest(r["from"], a["end"]), F.lit(0))).alias("n"),
        ),
    )
    return search(index, blocks, slop, width, stored=n > 1).withColumn("n_hit", cover["n"].cast("long"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    found = contamination(docs, items, width, text=text).where("n_hit > 0").select("doc_id", F.col("key").alias("_key")).distinct()
    keyed = docs.withColumn("_row_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    found = sized(found)
    return keyed.join(
        found, keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed["_row_key"] == found["_key"]), "left_anti"
    ).drop("_row_key")


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
