"""What a task holds at once stays small."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cpgloom.llm import sentencepiece_fst
from cpgloom.llm.common import bounded


def test_encoder_solves_few_words_at_once():
    rows = [" ".join(f"{i * 7919 % 99991:x}word{j:x}" for j in range(i, i + 500)).encode() for i in range(0, 30_000, 500)]
    machine = sentencepiece_fst.Machine(sentencepiece_fst.Model.read(sentencepiece_fst.MODEL))
    encoder = sentencepiece_fst.Encoder(machine)
    tracemalloc.start()
    values, ends = encoder.encode(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    alone = [sentencepiece_fst.Encoder(machine).encode([r])[0] for r in rows[::20]]
    for i, ids in zip(range(0, len(rows), 20), alone, strict=True):
        np.testing.assert_array_equal(values[ends[i] : ends[i + 1]], ids)


def test_batches_stay_below_four_megabytes(spark):
    docs = spark.range(0, 9_000, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["rows", "bytes"])

    seen = bounded(docs).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in seen) == 9_000
    assert max(r.bytes for r in seen) < 4 << 20


def test_words_that_came_again_stay_in_the_encoder(monkeypatch):
    monkeypatch.setattr(sentencepiece_fst, "CACHE", 12)
    machine = sentencepiece_fst.Machine(sentencepiece_fst.Model.read(sentencepiece_fst.MODEL))
    encoder, solved, solve = sentencepiece_fst.Encoder(machine), [], machine.encode_words
    monkeypatch.setattr(machine, "encode_words", lambda words: solved.extend(words) or solve(words))
    rows = [b"the same", b"the same", *(f"w{i} x{i} y{i} z{i}".encode() for i in range(4)), b"the same"]
    got = [encoder.encode([r])[0].tolist() for r in rows]
    assert solved.count("▁same") == 1
    assert len(encoder.known) <= 12
    assert got == [sentencepiece_fst.Encoder(machine).encode([r])[0].tolist() for r in rows]
