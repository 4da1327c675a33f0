"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Every line that is not blank becomes a number; a document is the sequence of its numbers.  Prefix
doubling ranks the runs of 1, 2, 4, ... lines that start at each position, from the ranks of the two
halves, until it is as deep as the shortest run that matters: one of at least ``min_words`` words.
A class of equal runs is an interval of the suffix array whose common prefix is that run, and the
longer repeated runs are unions of such runs.  In each class the first copy (by doc_id, then place)
stays and the lines of all later copies go.  Only positions in classes of two or more go on to the
next depth, and a line that occurs once never leaves the first count.

Nulls: a null text has no lines and stays null; a null doc_id comes first in the order.  Blank lines
take no part and stay.  Rows that agree in doc_id and text are one document and get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cpgloom.llm.common import bounded, same, slices, texts
from cpgloom.operators.ordering import numbered
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

MIN_WORDS = 10

_AT = ["doc_id", "key"]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return bounded(docs).select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("t"))


def line_ids(docs: DataFrame, min_words: int, text: str = "text") -> DataFrame:
    """Every line that is not blank: document, place, 128-bit ID (``a``, ``b``) and ``need``, the number of
    lines from here that hold ``min_words`` words (0: the document ends before)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            row, place, a, b, need = [], [], [], [], []
            for r, text in enumerate(texts(batch.column("t"))):
                lines = [x for x in text.split(b"\n") if x.strip()]
                words = [len(x.split()) for x in lines]
                stop, total = 0, 0
                for i, line in enumerate(lines):
                    while total < min_words and stop < len(lines):
                        total += words[stop]
                        stop += 1
                    need.append(stop - i if total >= min_words else 0)
                    total -= words[i]
                    h = xxhash.xxh3_128_intdigest(line)
                    a.append((h >> 64) - (1 << 63))
                    b.append((h & ((1 << 64) - 1)) - (1 << 63))
                row += [r] * len(lines)
                place += range(len(lines))
            at = pa.array(row, pa.int32())
            yield pa.record_batch(
                [batch.column("doc_id").take(at), batch.column("key").take(at)]
                + [pa.array(x, k) for x, k in ((place, pa.int32()), (a, pa.int64()), (b, pa.int64()), (need, pa.int32()))],
                ["doc_id", "key", "place", "a", "b", "need"],
            )

    return _keyed(docs, text).mapInArrow(work, "doc_id long, key long, place int, a long, b long, need int")


def _ranked(runs: DataFrame, order: list[str]) -> DataFrame:
    """Replace the columns ``order`` by ``rank``, their place among the classes of two or more."""
    classes = runs.groupBy(*order).agg(F.count("*").alias("_n")).where("_n > 1").select(*order)
    return runs.join(numbered(classes, [], order, rank="rank"), order).drop(*order)


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """Places of the lines to delete: ``doc_id``, ``key`` (of the text) and ``places``, a sorted array."""
    # Equal rows are one document: their lines count once.
    lines = materialize(line_ids(docs, min_words, text).dropDuplicates([*_AT, "place"]), "lines")
    level = materialize(_ranked(lines, ["a", "b"]), "rank")
    deepest = level.agg(F.max("need")).first()[0] or 0
    dead, width = [], 1
    while width <= deepest:
        # Runs of ``need`` lines, width <= need < 2 width, are told apart by the ranks at both their ends.
        ends = level.select(*_AT, (F.col("place")).alias("_end"), F.col("rank").alias("tail"))
        heads = level.where(f"need >= {width} and need < {2 * width}").withColumn("_end", F.col("place") + F.col("need") - width)
        runs = heads.withColumn("tail", F.col("rank")) if width == 1 else same(heads, ends, [*_AT, "_end"])
        first = runs.groupBy("need", "rank", "tail").agg(F.min(F.struct(*_AT, "place")).alias("_first"), F.count("*").alias("_n"))
        later = runs.join(first.where("_n > 1"), ["need", "rank", "tail"]).where(~F.struct(*_AT, "place").eqNullSafe(F.col("_first")))
        dead.append(later.select(*_AT, F.explode(F.sequence("place", F.col("place") + F.col("need") - 1)).alias("place")))
        if 2 * width <= deepest:
            right = level.select(*_AT, (F.col("place") - width).alias("place"), F.col("rank").alias("right"))
            pairs = same(level.withColumnRenamed("rank", "left"), right, [*_AT, "place"])
            level = materialize(_ranked(pairs, ["left", "right"]), "rank")
        width *= 2
    if not dead:
        return lines.select(*_AT, F.array("place").alias("places")).limit(0)
    every = dead[0]
    for more in dead[1:]:
        every = every.unionByName(more)
    return every.groupBy(*_AT).agg(F.array_sort(F.collect_set("place")).alias("places"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """``docs`` with the later copies of repeated runs of lines deleted from ``text``, and ``n_lines`` and
    ``n_removed`` (both of lines that are not blank; columns of these names are replaced)."""
    gone = sized(later_copies(docs, min_words, text)).withColumnsRenamed({"key": "_key", "places": "_places"})
    base = docs.drop("n_lines", "n_removed")
    kept = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out, n_lines, n_gone = [], [], []
            for t, places in zip(batch.column(text).to_pylist(), batch.column("_places").to_pylist(), strict=True):
                dead, place, left = set(places or ()), 0, []
                for line in (t or "").split("\n"):
                    blank = not line.encode().strip()
                    if blank or place not in dead:
                        left.append(line)
                    place += not blank
                out.append(None if t is None else "\n".join(left))
                n_lines.append(place)
                n_gone.append(len(dead))
            cols = [pa.array(out, batch.schema.field(text).type) if c == text else batch.column(c) for c in kept]
            yield pa.record_batch([*cols, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names)

    keyed = base.withColumn("_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return same(keyed, gone, ["doc_id", "_key"], "left").drop("_key").mapInArrow(work, schema)
