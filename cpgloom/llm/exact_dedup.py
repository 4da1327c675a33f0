"""Exact dedup by two passes of Bloom filtering, in DataFrame functions alone.

A filter is a table of 64-bit words.  The hash of a text picks one word and one bit in it; a bit that at
least two rows pick is set.  The first pass fills a filter from the hashes of all rows, the second one from
the hashes that the first filter lets through, with a hash of its own.  A text that occurs twice sets its
bit in both, so nothing repeated is missed; of the others about one in twenty passes the first filter and
one in several hundred both.  Only these rows shuffle, are grouped by their SHA-256 and learn which row of
their group stays.  The rest pass straight through: their text occurs once.

Two rows of one bit are told from one without counting bits apart: per word, ``bit_or`` has the bits picked,
``bit_xor`` those picked by an odd number of rows, and the row count says whether any odd one was picked three
times or more.  Where that can't be excluded, all bits of the word are set, which costs a few more rows.

A filter holds only words with a set bit and is broadcast up to a measured size; beyond that the hashes meet
it by a shuffle.  A text that a large part of the rows share is counted before it is shuffled, and its rows
meet their group by a broadcast of the at most ``HOT`` largest groups.

Nulls: a null text counts as empty.  Of equal texts the row with the largest id stays (null is the smallest
id); of rows that agree in text and id, one.  Very long texts are hashed whole.  An empty table gives an empty
table.  The added columns replace columns of the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import remove_scratch
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

# Mean number of rows that pick a bit in one 64-bit word.
LOAD = 4
# At most so many groups hold more than 1 / HOT of the rows each.
HOT = 100_000
# Smaller groups than this always meet their rows by a shuffle.
LARGE = 1000
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def _whole(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def _place(seed: int, words: int, hash_: str = "_h") -> tuple[Column, Column]:
    """Word and bit mask of a hash in the filter of pass ``seed``."""
    h = F.xxhash64(F.col(hash_), F.lit(seed))
    return F.pmod(h, F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))


def repeated_bits(hashes: DataFrame, seed: int, words: int) -> DataFrame:
    """The filter of ``hashes`` (``_h``): ``word`` and its ``bits`` that two rows or more may have picked."""
    word, mask = _place(seed, words)
    picked = hashes.select(word.alias("word"), mask.alias("mask")).groupBy("word")
    picked = picked.agg(F.bit_or("mask").alias("any"), F.bit_xor("mask").alias("odd"), F.count("*").alias("n"))
    even = F.col("any").bitwiseAND(F.bitwise_not("odd"))
    # Rows beyond the first of each bit.  As many as even bits: each of these has two, each odd bit has one.
    more = F.col("n") - F.bit_count("any")
    return picked.where(more > 0).select("word", F.when(more == F.bit_count(even), even).otherwise(F.col("any")).alias("bits"))


def _passing(rows: DataFrame, bits: DataFrame, seed: int, words: int) -> DataFrame:
    """``rows`` with ``_hit``: whether the filter has their bit."""
    word, mask = _place(seed, words)
    bits = bits.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    met = rows.withColumn("_at", word).join(bits, F.col("_at") == F.col("_word"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))
    return met.withColumn("_hit", hit).drop("_at", "_word", "_bits")


def _filters(hashes: DataFrame, n: int) -> list[tuple[DataFrame, int, int]]:
    """The filters of both passes, stored, each with its seed and number of words."""
    out = []
    for seed in (1, 2):
        words = max(1, -(-n // LOAD))
        out.append((sized(repeated_bits(hashes, seed, words)), seed, words))
        hashes = _passing(hashes, *out[-1]).where("_hit").drop("_hit")
        n = hashes.count() if seed == 1 else 0
    return out


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: Sequence[str] | None = None) -> DataFrame:
    """Every row, with the id of the row that stays of its text (``keep_id``), the number of rows of that text
    (``group_size``), whether it is the one that stays (``kept``) and ``text_sha256``.

    ``carry`` names the columns that come along, by default all.
    """
    spark = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    room = f"copies-{uuid.uuid4().hex}"
    hashes = materialize(docs.select(F.xxhash64(_whole(text)).alias("_h")), f"{room}/hashes")
    n = hashes.count()
    filters = _filters(hashes, n)
    remove_scratch(spark, room)

    rows = docs.select(*[f"`{c}`" for c in carry], F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(_whole(text)).alias("_h"), F.sha2(_whole(text), 256).alias("text_sha256"))
    for i, one in enumerate(filters):
        rows = _passing(rows, *one).withColumnRenamed("_hit", f"_hit{i}")
    maybe = F.col("_hit0") & F.col("_hit1")
    single = rows.where(~maybe)
    shared = rows.where(maybe).drop("_h", "_hit0", "_hit1").withColumn("_row", F.monotonically_increasing_id())
    shared = materialize(shared, "maybe-copies")  # fixes the row numbers

    groups = shared.groupBy("text_sha256").agg(F.max(F.struct("_id", "_row")).alias("_top"), F.count("*").alias("group_size"))
    groups = materialize(groups, "copy-groups")
    large = F.col("group_size") > max(LARGE, n // HOT)
    hot = F.broadcast(groups.where(large))  # at most HOT rows
    in_hot = shared.join(hot, "text_sha256")
    others = shared.join(hot, "text_sha256", "left_anti").join(groups.where(~large), "text_sha256")
    kept = [F.col("_top._id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_top._row")).alias("kept"), "text_sha256"]
    once = [F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"]
    names = [f"`{c}`" for c in carry]
    return single.select(*names, *once).unionByName(in_hot.select(*names, *kept)).unionByName(others.select(*names, *kept))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each text, with the columns of ``docs``."""
    plain = docs.withColumnsRenamed({c: f"_own_{c}" for c in ADDED if c in docs.columns})
    at = {c: f"_own_{c}" if c in ADDED else c for c in docs.columns}
    out = mark_copies(plain, at[text], at[doc_id]).where("kept")
    return out.select(*[F.col(f"`{at[c]}`").alias(c) for c in docs.columns])
