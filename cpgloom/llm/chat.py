"""Chat formatting by token-level assembly.

Every role and text is encoded as a segment of its own with a byte-level BPE vocabulary, and reserved ids, which
lie beyond the vocabulary and so arise from no text, are spliced in between: turn, role, text, turn end.
The loss mask covers the text tokens of the trained roles.  It is derived by prefix sums: a start and a stop
mark at every segment's boundary, whose running sum is the mask.

Inside roles and texts, control strings (the template's own marks and those of other common templates)
are escaped: a backslash goes in after the first character of each, and one more where some are there already.
``unescape`` takes one out again, so each text comes back as it was.

Turns are rows and stay rows: a conversation of any length is never one group.  ``render`` gives the tokens of
each turn with their offset in the conversation; ``read_back`` streams over turns sorted within
partitions, in memory for one turn.

Order: turns by number, equal numbers by role, then text; null turn numbers come first.  Null roles and texts
are empty.  Rows with a null conv_id are one conversation of their own.  Repeated rows are repeated turns.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.llm.common import bounded, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings that must not pass from a text into the formatted conversation.
CONTROL = [TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

_BODY = "|".join(f"{re.escape(c[0])}(?:{{}}){re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True))
_PLAIN = re.compile(_BODY.replace("{}", r"\\*"))
_ESCAPED = re.compile(_BODY.replace("{}", r"\\+"))
MAX_VOCABULARY_BYTES = 64 << 20


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The file of the vocabulary, read on the driver; tasks get its bytes."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than 64 MB")
    return raw


class Codec:
    """Segments to ids and back; the ids of the three marks follow those of the vocabulary."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.bpe = tiktoken.Encoding("segments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.turn, self.text, self.end = range(first, first + 3)
        self.marks = {self.turn: TURN, self.text: TEXT, self.end: END}

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(escape(text))

    def decode(self, ids: list[int]) -> str:
        """Ids to formatted text, marks included, still escaped."""
        out, run = [], []
        for i in ids:
            if i in self.marks:
                out += [self.bpe.decode(run), self.marks[i]]
                run = []
            else:
                run.append(i)
        return "".join([*out, self.bpe.decode(run)])

    def segments(self, ids: list[int]) -> list[tuple[str, str]]:
        """Role and text of every turn in the ids, unescaped."""
        out, at = [], 0
        while at < len(ids):
            text, end = ids.index(self.text, at), ids.index(self.end, at)
            if ids[at] != self.turn or end < text:
                raise ValueError("the ids are no sequence of turns")
            out.append((unescape(self.bpe.decode(ids[at + 1 : text])), unescape(self.bpe.decode(ids[text + 1 : end]))))
            at = end + 1
        return out


def loss_mask(sizes: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """Mask over consecutive segments of the given token counts: the running sum of starts and stops."""
    ends = np.cumsum(sizes)
    step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int8)
    np.add.at(step, (ends - sizes)[trained], 1)
    np.add.at(step, ends[trained], -1)
    return np.cumsum(step[:-1]).astype(np.int8)


def render(turns: DataFrame, trained: tuple[str, ...] = ("assistant",), path: str = VOCABULARY) -> DataFrame:
    """One row per turn (conv_id, turn, role, text): ``conv_id``, ``place`` (from 1), ``ids``, ``mask`` and ``offset``, the
    number of the conversation's tokens before this turn."""
    codec = turns.sparkSession.sparkContext.broadcast(vocabulary(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Codec(codec.value)
        for batch in slices(batches, "text", 1 << 20):
            ids, sizes, learn = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = [[bpe.turn], bpe.encode(role or ""), [bpe.text], bpe.encode(text or ""), [bpe.end]]
                sizes += map(len, parts)
                learn += [False, False, False, role in trained, False]
                ids.append([i for p in parts for i in p])
            lengths = np.array(sizes, np.int64)
            mask = loss_mask(lengths, np.array(learn, bool))
            at = pa.array(np.concatenate([[0], np.cumsum(lengths.reshape(-1, 5).sum(1))]), pa.int32())
            flat = np.fromiter((i for x in ids for i in x), np.int32, len(mask))
            lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (flat, mask)]
            keys = [batch.column(c) for c in ("conv_id", "turn", "role", "text")]
            yield pa.record_batch([*keys, *lists], ["conv_id", "turn", "role", "text", "ids", "mask"])

    rows = bounded(turns).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    made = rows.mapInArrow(work, "conv_id long, turn long, role string, text string, ids array<int>, mask array<tinyint>")
    # Running frames read a conversation row by row.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(F.size("ids").cast("long")).over(order)
    return made.select("conv_id", F.count("*").over(order).alias("place"), "ids", "mask", (upto - F.size("ids")).alias("offset"))


def read_back(rendered: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """What the tokens say of each conversation: ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``."""
    codec = rendered.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Codec(codec.value)
        now, said, loss, n, chars, size = None, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for batch in batches:
            done = []
            columns = (batch.column(c) for c in ("conv_id", "ids", "mask"))
            conv, ids_list, masks = columns
            conv = conv.to_pylist()
            for i in range(batch.num_rows):
                if n and conv[i] != now:
                    done.append((now, n, said.hexdigest(), chars, loss.hexdigest(), size))
                    said, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                now = conv[i]
                ids, mask = ids_list[i].as_py(), masks[i].values.to_numpy()
                for role, text in bpe.segments(ids):
                    said.update(f"{role}\n{text}\n".encode())
                    n += 1
                learned = unescape(bpe.bpe.decode(np.array(ids)[mask == 1].tolist()))
                loss.update(learned.encode())
                chars += len(learned)
                size += len(bpe.decode(ids))
            if done:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if n:
            last = ((now,), (n,), (said.hexdigest(),), (chars,), (loss.hexdigest(),), (size,))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(last, kinds, strict=True)], names)

    rows = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "ids", "mask").mapInArrow(work, schema)
