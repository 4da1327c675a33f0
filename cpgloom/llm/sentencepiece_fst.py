"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (dummy prefix, blanks to U+2581), the
pieces (a trie over characters whose accepting states emit piece ids) and byte fallback (a character
in no piece becomes its bytes at a cost of one each).  Composed with a text they give a lattice of arcs.
Byte-pair models add an acceptor over neighbouring pieces: an arc costs nothing where its piece may follow
the last one and infinity where the merges would have crossed the boundary.  The shortest path in the
tropical semiring (minimum over paths, sum along them) is then the one path of finite cost, which is the
encoding that merging by priority gives; it is found position by position, for all words of a batch at once.
Two pieces may stand together if, taking back their merges from the last on, no merge across the
boundary would have come before the one taken back.

Text is cut at blanks and line feeds, which no piece crosses, and equal words are solved once per task.

Nulls: a null text has null ids, an empty one none.  Decoding ids of null gives null, and bytes that
are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cpgloom.llm.common import bounded, slices, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Words remembered in a task, and those solved at once: a word takes some 200 bytes, solving it some 3 KB for a moment.
CACHE = 100_000
AT_ONCE = 4_000
# Bytes of text that are cut into words at once; the words take many times as much.
PART = 512 << 10

_SPACE = "▁"
_NORMAL, _CONTROL, _BYTE, _BPE = 1, 3, 6, 2
_START, _NONE = -1, -2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True

    @classmethod
    def read(cls, path: str) -> Model:
        model = cls([], [], [])
        with open(path, "rb") as f:
            raw = f.read()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append(piece.get(1, b"").decode())
                model.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                model.kinds.append(piece.get(3, _NORMAL))
            elif number == 2 and dict(_fields(value)).get(3) != _BPE:
                raise ValueError("only byte-pair models are supported")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only the identity normaliser that keeps all blanks is supported")
                model.dummy_prefix = bool(spec.get(3, 1))
        return model


class Table:
    """Integer keys to integer values with vectorised look-ups (open addressing); absent: -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]  # of several, the last one stays
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        seen = self.keys[slot]
        hit = seen == keys
        out = np.where(hit, self.values[slot], -1)
        left = np.flatnonzero(~hit & (seen >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


class Machine:
    """The compiled transducers."""

    def __init__(self, model: Model):
        self.dummy_prefix = model.dummy_prefix
        self.byte_ids = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if kind == _BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            else:
                self.raw.append(b"" if kind == _CONTROL else piece.replace(_SPACE, " ").encode())
        normal = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == _NORMAL}
        # Equal scores are one priority; of such merges the leftmost comes first.
        merged = sorted({-model.scores[i] for p, i in normal.items() if len(p) > 1})
        priority = {s: r for r, s in enumerate(merged)}
        rank = {p: priority[-model.scores[i]] for p, i in normal.items() if len(p) > 1}
        n = len(model.pieces)
        self.rank = np.full(n + 1, -1, np.int64)
        self.left, self.right = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        reachable = {}
        for piece, i in normal.items():
            halves = _last_merge(piece, rank) if len(piece) > 1 else ()
            if halves is None:
                continue
            reachable[piece] = i
            if halves:
                self.rank[i] = rank[piece]
                self.left[i], self.right[i] = normal[halves[0]], normal[halves[1]]
        pairs = [(normal[p[:k]], normal[p[k:]], r) for p, r in rank.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        a, b, r = np.array(pairs, np.int64).reshape(-1, 3).T
        self.joins = Table(a << 32 | b, r.astype(np.int32))
        chars = sorted({c for p in normal for c in p})
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        nodes, edges, accepts = {"": 0}, [], {}
        for piece, i in reachable.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    edges.append((nodes[piece[: k - 1]], self.classes[ord(piece[k - 1])], nodes[piece[:k]]))
            accepts[nodes[piece]] = i
        node, by, to = np.array(edges, np.int64).reshape(-1, 3).T
        self.trie = Table(node << 20 | by, to.astype(np.int32))
        # The first step, which every character takes, by its class.
        self.first = np.full(len(chars) + 1, -1, np.int64)
        self.first[by[node == 0]] = to[node == 0]
        self.accepts = np.full(len(nodes), -1, np.int32)
        self.accepts[list(accepts)] = list(accepts.values())
        self.unknown = n  # stands for a character in no piece

    def __getstate__(self) -> dict:
        used = np.flatnonzero(self.classes)
        return self.__dict__ | {"classes": (used, self.classes[used])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        used, values = state["classes"]
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[used] = values

    def may_follow(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        """Whether ``then`` may stand right after ``first``: weight zero, else infinity."""
        out = np.ones(len(first), bool)
        at = np.flatnonzero((first >= 0) & (first != self.unknown) & (then != self.unknown))
        a, b = first[at].astype(np.int64), then[at].astype(np.int64)
        limit = np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            across = self.joins.get(a << 32 | b)
            bad = (across >= 0) & (across < limit)
            out[at[bad]] = False
            # Take back the later of the two last merges; between equals, the right one.
            use_a = self.rank[a] > self.rank[b]
            go = ~bad & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            limit = np.where(use_a, self.rank[a], self.rank[b] + 1)
            a, b = np.where(use_a, self.right[a], a), np.where(use_a, b, self.left[b])
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Shortest path of each word (blanks already U+2581), as packed 32-bit ids."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(points)) - first[word]
        kinds = self.classes[points].astype(np.int64)
        start = np.flatnonzero(kinds > 0)
        node = self.first[kinds[start]]
        arcs = [np.stack([lone := np.flatnonzero(kinds == 0), np.ones(len(lone), np.int64), np.full(len(lone), self.unknown)])]
        length = 0
        while len(start):
            if length:
                node = self.trie.get(node << 20 | kinds[start + length]).astype(np.int64)
            length += 1
            alive = node >= 0
            start, node = start[alive], node[alive]
            ids = self.accepts[node]
            arcs.append(np.stack([start[ids >= 0], np.full(int((ids >= 0).sum()), length), ids[ids >= 0]]))
            more = offset[start] + length < sizes[word[start]]
            start, node = start[more], node[more]
        begin, width, ids = np.concatenate(arcs, axis=1)
        ends = offset[begin] + width
        order = np.argsort(ends, kind="stable")
        begin, width, ids, ends = begin[order], width[order], ids[order], ends[order]
        state = begin + word[begin]  # one state more than characters in each word
        last = np.full(len(points) + len(words), _NONE, np.int64)
        last[first + np.arange(len(words))] = _START
        back = np.zeros(len(last), np.int64)
        cuts = np.searchsorted(ends, np.arange(1, int(sizes.max(initial=0)) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = lo + np.flatnonzero(last[state[lo:hi]] != _NONE)
            at = at[self.may_follow(last[state[at]], ids[at])]
            last[state[at] + width[at]] = ids[at]
            back[state[at] + width[at]] = width[at]
        # Read all paths from their ends.
        here = first + np.arange(len(words)) + sizes
        todo, steps = np.flatnonzero(sizes > 0), []
        while len(todo):
            steps.append((todo, here[todo], last[here[todo]]))
            here[todo] -= back[here[todo]]
            todo = todo[last[here[todo]] != _START]
        if not steps:
            return [b""] * len(words)
        who, where, what = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(where, kind="stable")
        who, where, what = who[order], where[order], what[order]
        packed = what.astype(np.int32).tobytes()
        ends = (np.cumsum(np.bincount(who, minlength=len(words))) * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.unique(who[what == self.unknown]).tolist():
            out[i] = self._with_bytes(words[i], np.frombuffer(out[i], np.int32).tolist())
        return out

    def _with_bytes(self, word: str, ids: list[int]) -> bytes:
        done, place = [], 0
        for i in ids:
            if i == self.unknown:
                done += self.byte_ids[list(word[place].encode())].tolist()
                place += 1
            else:
                done.append(i)
                place += len(self.raw[i].decode())
        return np.array(done, np.int32).tobytes()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the rows of ids that end at ``ends``."""
        sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        begin = np.cumsum(sizes) - sizes
        size = sizes[ids]
        upto = np.cumsum(size)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin[ids] - (upto - size), size)
        raw = np.frombuffer(b"".join(self.raw), np.uint8)[at].tobytes()
        cuts = np.concatenate([[0], upto])[ends].tolist()
        rows = [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return [(r[1:] if self.dummy_prefix and r[:1] == b" " else r).decode(errors="replace") for r in rows]


def _last_merge(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The two parts that the last merge joins when ``piece`` is encoded alone; None if it never becomes one."""
    parts, halves = list(piece), None
    while len(parts) > 1:
        best = min(((rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            return None
        k = best[1]
        halves = (parts[k], parts[k + 1])
        parts[k : k + 2] = ["".join(halves)]
    return halves


class Encoder:
    """Encodes texts of a task, solving each distinct word once."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.line_feed = np.int32(machine.byte_ids[10]).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.met: set[bytes] = set()

    def _words(self, text: bytes) -> list[list[bytes]]:
        """Per line its words; all but a line's first begin with their blanks."""
        out = []
        for line in ((b" " + text) if self.machine.dummy_prefix else text).split(b"\n"):
            if b"  " in line:
                out.append(re.findall(rb" +[^ ]*|[^ ]+", line))
            else:
                parts = line.split(b" ")
                out.append(parts[:1] * bool(parts[0]) + [b" " + p for p in parts[1:]])
        return out

    def encode(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the rows."""
        cut = [self._words(t) if t else [] for t in rows]
        seen: set[bytes] = set()
        for lines in cut:
            seen.update(*lines)
        again = seen.intersection(self.known)
        self.met.update(again)
        if len(self.known) + len(seen) - len(again) > CACHE:
            # Words that came again stay, if they leave room: most others never will.
            kept = self.met if len(self.met) + len(seen) - len(again) <= CACHE // 2 else again
            self.known = {w: self.known[w] for w in kept}
            self.met = again
        # Short words together, so that one long word does not hold up the others.
        new = sorted(seen.difference(self.known), key=len)
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            words = b"\n".join(some).decode().replace(" ", _SPACE).split("\n")
            self.known.update(zip(some, self.machine.encode_words(words), strict=True))
        get = self.known.__getitem__
        packed = [self.line_feed.join([b"".join(map(get, line)) for line in lines]) for lines in cut]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        return np.frombuffer(b"".join(packed), np.int32), ends


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of the whole text in the column ``ids`` (replaced if it is there)."""
    machine = Machine(Model.read(model))
    base = docs.drop(ids)
    kept = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(machine)
        for batch in slices(batches, text, PART):
            values, ends = encoder.encode(texts(batch.column(text)))
            nulls = batch.column(text).is_null()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()), mask=nulls)
            yield pa.record_batch([*(batch.column(c) for c in kept), lists], [*kept, ids])

    return bounded(base).mapInArrow(work, schema)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` in the column ``text`` (replaced if it is there)."""
    machine = Machine(Model.read(model))
    base = rows.drop(text)
    kept = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField(text, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            start = 0
            while start < batch.num_rows:  # some ids at a time
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + (1 << 18), "right")))
                part = batch.slice(start, stop - start)
                values = part.column(ids).flatten().to_numpy(zero_copy_only=False)
                back = pa.array(machine.decode(values, ends[start:stop] - before), pa.string())
                back = pc.if_else(part.column(ids).is_null(), pa.scalar(None, pa.string()), back)
                yield pa.record_batch([*(part.column(c) for c in kept), back], [*kept, text])
                start = stop

    return bounded(base).mapInArrow(work, schema)


def ids_sha256(ids: str = "ids"):
    """Digest of the ids, comma-joined."""
    return F.sha2(F.array_join(F.coalesce(F.col(ids), F.array().cast("array<int>")), ","), 256)
