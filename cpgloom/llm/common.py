"""Helpers shared by the text operators: byte views of Arrow columns, word hashes, document keys."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgloom.session import scratch_folder

# Text is worked on in slices of about this many bytes; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20

# Lower-cases A-Z only, as the word rules ask.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a blank.
ALNUM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)


# Spark hands Arrow batches to Python tasks; 64 MB of text each (its default) is more than a small worker needs.
# A batch exceeds this by a row, and its buffers outside the heap double: a little less than 4 MB keeps them at 4 MB.
BATCH_BYTES = (4 << 20) - (256 << 10)


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, after asking its session for Arrow batches of few bytes, unless it was told otherwise."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "67108864b") == "67108864b":
        conf.set(name, str(BATCH_BYTES))
    return docs


@contextlib.contextmanager
def scratch_room(spark: SparkSession) -> Iterator[str]:
    """Labels for tables that only the steps inside need: their folder goes at the end, and the shuffle
    files of each query when it ends, so that disk holds one step's data and not all steps'."""
    room = f"room-{uuid.uuid4().hex}"
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield room
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
        remove_scratch(spark, room)


def remove_scratch(spark: SparkSession, label: str) -> None:
    """Removes a folder that ``materialize`` filled, from whatever store holds it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/{label}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than rows); null counts as empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``text`` (at least one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = utf8(batch.column(text))[1][1:]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(column: pa.Array) -> list[bytes]:
    """Each row as UTF-8 bytes; null counts as empty."""
    return column.fill_null("").cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


# Odd multipliers for the places of a window.
_PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
_LOWER = np.frombuffer(LOWER, np.uint8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# The low n bytes of a 64-bit word.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word (fixed constants of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (what stands between ASCII white space, A-Z lower-cased) of the texts
    between ``bounds``, in order, and the number of words of each text."""
    data = _LOWER[data]
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]])[: len(data)]
    full = np.flatnonzero(np.diff(bounds) > 0)
    before[bounds[:-1][full]] = True
    start = np.flatnonzero(~blank & before)
    after = np.concatenate([blank[1:], [True]])[: len(data)]
    after[bounds[1:][full] - 1] = True
    size = np.flatnonzero(~blank & after) + 1 - start
    grams = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    out = mix((grams[start] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(_PLACES[0]))
    left, done = np.flatnonzero((size > 8) & (size <= 256)), 8
    while len(left):
        piece = grams[start[left] + done] & _MASKS[np.minimum(size[left] - done, 8)]
        out[left] = mix(out[left] * np.uint64(_PLACES[1]) + piece)
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > 256):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return out, np.diff(np.searchsorted(start, bounds))


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of every ``width`` consecutive word hashes; needs at least ``width`` of them."""
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        if i % len(_PLACES) == 0 and i:
            out = mix(out)
        out += hashes[i : i + n] * np.uint64(_PLACES[i % len(_PLACES)])
    return mix(out)


def text_key(text: str = "text") -> Column:
    """128 bits that tell texts apart (null and empty alike), so that a repeated doc_id does no harm."""
    return F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32)


def sha256_list(values: Column) -> Column:
    """Lower-case digest of the values as strings, sorted and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(values, lambda v: v.cast("string"))), ","), 256)


def same(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null."""
    other = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    on = [df[k].eqNullSafe(other[f"_other_{k}"]) for k in keys]
    return df.join(other, on, how).drop(*[f"_other_{k}" for k in keys])
