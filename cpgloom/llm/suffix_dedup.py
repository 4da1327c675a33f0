"""Suffix-array dedup: depth-limited radix sort of suffixes, most significant digit first.

Suffixes are told apart only through their first ``length`` bytes (the window), so the groups that the last
pass leaves are exactly the repeated windows.  The most significant digit of a window is its core: the
``length / 2`` bytes from its anchor on, the anchor being the place of the smallest hashed 8-gram in the
window's first half (the leftmost of equal ones).  Equal windows have equal anchors and cores, and
neighbouring windows mostly share an anchor, so a pass sorts a cell of neighbouring suffixes as one row.
The passes refine the cells: all suffixes of one anchor, then 16 neighbours, then single suffixes.  In
each pass a cell leaves whose core (the bytes that all its windows hold) occurs once: none of its windows
is repeated.  A cell whose span (the bytes that any of its windows holds) occurs again leaves too: all are.
Only the others are sorted by further bytes, together with one copy of each settled cell of equal core.
Digits are compared by two 64-bit hashes at once: 128 bits.

Every group is counted with partial sums, stored and joined back from the table, broadcast up to its measured
bound and split by adaptive execution beyond it, so a window with very many copies needs no task of its own.  Strings are judged on the input; windows never cross documents; overlapping copies in
one document count.  Nulls: a null text is empty.  Rows that agree in doc_id and text count as separate
copies and get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cpgloom.llm.common import bounded, mix, same, slices, utf8
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

LENGTH = 400
# One stretch of a long text; positions must fit in the low bits of a 64-bit key.
STRETCH = 8 << 20
# Neighbouring suffixes in a cell of the later passes.
GRAINS = (16, 1)
CELL = ["doc_id", "key", "begin", "size", "anchor", "core", "span", "stand_in"]
# ``anchor`` counts from ``begin``; a stand-in for settled cells is itself settled already.
CELL_SCHEMA = "doc_id long, key long, begin int, size int, anchor int, core long, span long, stand_in boolean"
_LOW = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and anchor of every run, for the texts between ``bounds`` in ``data``."""
    reach = length - length // 2 + 1  # places where an anchor may be
    starts, count = bounds[:-1], np.maximum(np.diff(bounds) - length + 1, 0)
    if not count.sum():
        return (np.zeros(0, np.int64),) * 3
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    grams = np.ndarray((len(data),), "<u8", padded.data, strides=(1,))
    key = (mix(grams * np.uint64(0x9E3779B97F4A7C15)) & ~_LOW) | np.arange(len(data), dtype=np.uint64)
    width = 1
    while 2 * width <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(data) - reach + 1], key[reach - width : len(data) - width + 1])
    ends = np.cumsum(count)
    place = np.arange(ends[-1]) + np.repeat(starts - (ends - count), count)
    anchor = (key[place] & _LOW).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return place[first], place[last], anchor[first]


def _digits(raw: memoryview, first: np.ndarray, last: np.ndarray, core: np.ndarray, core_end: np.ndarray, length: int) -> list[np.ndarray]:
    """Hashes of the cores and of the spans of cells."""
    h = xxhash.xxh3_64_intdigest
    cores = (h(raw[a:b]) for a, b in zip(core.tolist(), core_end.tolist(), strict=True))
    spans = (h(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True))
    return [np.fromiter(x, np.uint64, len(first)).view(np.int64) for x in (cores, spans)]


def _stretches(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes, bounds, number of the first text and offset in it; a long text comes in overlapping stretches."""
    data, at = utf8(batch.column("t"))
    if len(data) <= STRETCH:
        yield data, at, 0, 0
        return
    for row in range(batch.num_rows):
        text = data[at[row] : at[row + 1]]
        for off in range(0, max(len(text), 1), STRETCH - length + 1):
            piece = text[off : off + STRETCH]
            yield piece, np.array([0, len(piece)]), row, off
            if off + STRETCH >= len(text):
                break


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return bounded(docs).select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("t"))


def _all_runs(keyed: DataFrame, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            for data, bounds, row0, off in _stretches(batch, length):
                first, last, anchor = runs(data, bounds, length)
                core, span = _digits(memoryview(data), first, last, anchor, anchor + length // 2, length)
                row = np.searchsorted(bounds, first, "right") - 1
                at = pa.array(row + row0)
                begin, size = first - bounds[row] + off, last - first + 1
                yield pa.record_batch(
                    [batch.column("doc_id").take(at), batch.column("key").take(at)]
                    + [x.astype(np.int32) for x in (begin, size, anchor - first)]
                    + [core, span, np.zeros(len(core), bool)],
                    CELL,
                )

    return keyed.mapInArrow(work, CELL_SCHEMA)


def _cells(keyed: DataFrame, open_cells: DataFrame, grain: int, length: int) -> DataFrame:
    """Cut cells into those of ``grain`` neighbouring suffixes, at multiples of ``grain`` before the anchor."""
    part = F.struct("begin", "size", "anchor", "stand_in")
    lists = sized(open_cells.groupBy("doc_id", "key").agg(F.collect_list(part).alias("cells")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            data, at = utf8(batch.column("t"))
            flat = batch.column("cells").flatten()
            begin, size, anchor = (flat.field(c).to_numpy().astype(np.int64) for c in ("begin", "size", "anchor"))
            row = np.repeat(np.arange(batch.num_rows), batch.column("cells").value_lengths().to_numpy())
            # Distances to the anchor run from ``anchor`` down; cell j holds those from j * grain on.
            low, high = (anchor - size + 1) // grain, anchor // grain
            n = high - low + 1
            cell = np.repeat(np.arange(len(n)), n)
            j = low[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
            far = np.minimum((j + 1) * grain - 1, anchor[cell])
            near = np.maximum(j * grain, (anchor - size + 1)[cell])
            base = at[row[cell]]
            place = begin[cell] + anchor[cell]
            first, last = base + place - far, base + place - near
            core = base + place - j * grain
            digits = _digits(memoryview(data), first, last, core, core - grain + 1 + length, length)
            take = pa.array(row[cell])
            yield pa.record_batch(
                [batch.column("doc_id").take(take), batch.column("key").take(take)]
                + [x.astype(np.int32) for x in (first - base, last - first + 1, far)]
                + [*digits, flat.field("stand_in").take(pa.array(cell))],
                CELL,
            )

    return same(keyed, lists, ["doc_id", "key"]).select("doc_id", "key", "t", "cells").mapInArrow(work, CELL_SCHEMA)


def repeated(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``doc_id``, ``key`` and ``spans``: stretches of window starts (from, to) whose windows start elsewhere too."""
    keyed = _keyed(docs, text)
    cells, settled = _all_runs(keyed, length), []
    for grain in (*GRAINS, None):
        cells = materialize(cells, "cells")
        again = sized(cells.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
        left = materialize(cells.join(again, "core"), "recurring")
        twice = left.groupBy("core", "span").agg(F.count("*").alias("n")).where("n > 1").select("core", "span", F.lit(True).alias("all"))
        left = left.join(sized(twice), ["core", "span"], "left")
        settled.append(left.where("all and not stand_in"))
        if grain is None:
            break
        left = materialize(left, "digits")
        settled[-1] = left.where("all and not stand_in")
        unsettled = left.where("all is null")
        stand_in = left.where("all").groupBy("core", "span").agg(F.min(F.struct("doc_id", "key", "begin", "size", "anchor")).alias("x"))
        mixed = sized(unsettled.where("not stand_in").select("core").distinct())
        stand_in = stand_in.join(mixed, "core").select("x.*", F.lit(True).alias("stand_in"))
        unsettled = unsettled.select("doc_id", "key", "begin", "size", "anchor", "stand_in").unionByName(stand_in)
        cells = _cells(keyed, unsettled, grain, length)
    spans = settled[0]
    for more in settled[1:]:
        spans = spans.unionByName(more)
    spans = spans.select("doc_id", "key", F.col("begin").alias("from"), (F.col("begin") + F.col("size")).alias("to"))
    spans = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"))
    # Neighbouring stretches become one.
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<from:int,to:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["to"] >= x["from"]),
            F.concat(
                F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(
                    F.struct(F.element_at(a, -1)["from"].alias("from"), F.greatest(F.element_at(a, -1)["to"], x["to"]).alias("to"))
                ),
            ),
        ).otherwise(F.concat(a, F.array(x))),
    )
    return spans.select("doc_id", "key", merged.alias("spans"))


def drop_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the bytes that no repeated window covers), ``n_bytes``, ``n_removed`` and
    ``removed`` (the maximal removed runs, from and to); columns of these names are replaced."""
    spans = sized(repeated(docs, length, text)).withColumnsRenamed({"key": "_key", "spans": "_spans"})
    base = docs.drop("kept", "n_bytes", "n_removed", "removed")
    kept = base.columns
    more = "kept binary, n_bytes long, n_removed long, removed array<struct<from:int,to:int>>"
    schema = T.StructType(base.schema.fields + T.StructType.fromDDL(more).fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, at = utf8(batch.column(text))
            out, gone = [], []
            for i, spans in enumerate(batch.column("_spans").to_pylist()):
                raw, pieces, cut, here = data[at[i] : at[i + 1]].tobytes(), [], [], 0
                for s in spans or ():
                    begin, end = s["from"], s["to"] - 1 + length
                    if cut and begin <= cut[-1]["to"]:
                        cut[-1]["to"] = max(end, cut[-1]["to"])
                    else:
                        cut.append({"from": begin, "to": end})
                for c in cut:
                    pieces.append(raw[here : c["from"]])
                    here = c["to"]
                out.append(b"".join([*pieces, raw[here:]]))
                gone.append(cut)
            n = np.diff(at)
            removed = n - np.fromiter(map(len, out), np.int64, len(out))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))]
            made = [pa.array(v, k) for v, k in zip((out, n, removed, gone), kinds, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in kept), *made], schema.names)

    keyed = base.withColumn("_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return same(keyed, spans, ["doc_id", "_key"], "left").drop("_key").mapInArrow(work, schema)
