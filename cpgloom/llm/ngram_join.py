"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows are texts with distinct n-gram sets (equal sets are one class from the start), columns are n-grams.
Two sets of sizes m and n reach a Jaccard similarity of t only if they share at least
``need = t / (1 + t) * (m + n)`` columns; so neither may be smaller than t times the other, and they
share a column among the first ``m - ceil(t m) + 1`` of each in any order common to all texts.  Only those
columns enter the product.  The order puts columns that recur in many texts last, by count, and the
others first, by hash: passages shared by texts that differ otherwise never meet.  The counts of all
texts feed the order; whichever columns it holds, the links found are the same.

Columns are blocks by hash (the shuffle).  A column of few classes gives all its pairs, whose overlaps are
summed over columns; in a column of many classes each first meets only two, which the column draws.
Sets that link share at least so many leading columns as ``_least_shared`` derives from their sizes, and
pairs that don't reach that are discarded before any whole set is read.  Whole sets decide about the
rest, and classes linked so far are components.  Columns of many classes that still hold several
components draw again, a few times, and then give the pairs across components, each in the columns where
two sets that link can first meet.  So each pair of texts has been compared, is ruled out by a bound, or
lies within one component already.

Documents: shingles of ``width`` lower-cased words, or all words as one where there are fewer; without
words the set is empty and links with nothing.  A null text is an empty one.  Rows that agree in text and
doc_id share a class; ties go to the smaller doc_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.llm.common import bounded, fold, remove_scratch, scratch_room, slices, utf8, word_hashes
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

WIDTH, PERCENT = 4, 85
# The order of columns knows the counts of at most this many n-grams, the most frequent ones: 4 MB.
KNOWN_COUNTS = 1 << 18
# Columns of at most this many classes give all their pairs; those of more first meet two classes only.
FEW = 16
# How often columns of many classes draw new leads before all pairs across components follow.
TURNS = 3
# Bytes of lists up to which the classes of some pairs are sent to every task, not shuffled with the pairs.
SMALL = 8 << 20
# Bytes of text whose sets a task holds at once, where the slices make no difference to the rows.
PART = 1 << 20


def _digest(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; fewer words than ``width`` are one shingle."""
    words, counts = word_hashes(data, bounds)
    every = fold(words, width) if len(words) >= width else words
    start = 0
    for n in counts.tolist():
        if n >= width:
            s = np.sort(every[start : start + n - width + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            yield fold(words[start : start + n], n) if n else words[:0]
        start += n


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    return shingle_sets(*utf8(batch.column("t")), width)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return bounded(docs).select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("t"))


def frequent(keyed: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that most texts hold, sorted by hash, and the ranks of their counts (rare first).

    Every text is counted; a count below two in a task's slice of some megabytes is not sent on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            every = list(_sets(batch, width))
            h, n = np.unique(np.concatenate(every), return_counts=True)
            yield pa.record_batch([_signed(h[n > 1]), n[n > 1].astype(np.int64)], ["h", "n"])

    counts = keyed.select("t").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.where("n > 3").orderBy(F.desc("n"), "h").limit(KNOWN_COUNTS).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], rank[order]


def leading(s: np.ndarray, n: int, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first ``n`` columns of a sorted set in the order that all texts share."""
    if not len(common):
        return s[:n]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    is_common = common[at] == s
    rare = s[~is_common]
    if len(rare) >= n:
        return rare[:n]
    rest = s[is_common][np.argsort(rank[at[is_common]], kind="stable")]
    return np.concatenate([rare, rest[: n - len(rare)]])


def _incidence(keyed: DataFrame, width: int, percent: int, label: str) -> DataFrame:
    """A row ``row`` per text: ``doc_id``, ``key``, set size ``n``, set digest ``a``, ``b``, and its leading columns."""
    common, rank = frequent(keyed, width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", PART):
            n, a, b, cols = [], [], [], []
            for s in _sets(batch, width):
                least = -(-percent * len(s) // 100)
                n.append(len(s))
                x, y = _digest(s) if len(s) else (0, 0)
                a.append(x)
                b.append(y)
                cols.append(_signed(leading(s, len(s) - least + 1, common, rank)) if len(s) else np.zeros(0, np.int64))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
                + [pa.array(cols, pa.list_(pa.int64()))],
                ["doc_id", "key", "n", "a", "b", "cols"],
            )

    found = keyed.mapInArrow(work, "doc_id long, key long, n long, a long, b long, cols array<long>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), label)


def components(edges: DataFrame, room: str = "components") -> DataFrame:
    """Smallest reachable node of every node of the undirected ``edges`` (u, v): ``node``, ``comp``.

    Alternates large-star and small-star steps, each a minimum by node and a join on one shuffle of its rows."""
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), f"{room}/edges")
    last = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == last or not mark[0]:
            break
        last = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").repartition("u")
        # Each row gives (v, m), and the one with the smallest v also (u, m).
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        now = materialize(small.distinct(), f"{room}/star")
    if not mark[0]:
        return spark.createDataFrame([], "node long, comp long")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops)


def _merged(comp: DataFrame, links: DataFrame, room: str, label: str) -> DataFrame:
    """The components ``comp`` after more ``links``, stored; the links join whole components, so only these are worked on."""
    if not links.head(1):
        return materialize(comp, label)
    ends = links
    for x in ("u", "v"):
        ends = ends.join(comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")), x, "left")
    ends = ends.select(*(F.coalesce(f"c{x}", x).alias(x) for x in ("u", "v")))
    more = materialize(components(ends, room), f"{room}/merged").select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    old = comp.join(more, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = more.select(F.col("comp").alias("node"), F.col("top").alias("comp"))
    return materialize(old.unionByName(new).distinct(), label)


def _fits(percent: int) -> Column:
    """Neither size is smaller than the threshold times the other."""
    return F.least("nu", "nv") * 100 >= percent * F.greatest("nu", "nv")


def _need(percent: int) -> Column:
    """The overlap that sets of sizes nu and nv need to link."""
    return F.ceil(F.lit(percent) * (F.col("nu") + F.col("nv")) / F.lit(100 + percent) - F.lit(1e-9))


def _least_shared(percent: int) -> Column:
    """How many columns sets of sizes nu and nv that link share at least among their leading columns.

    The k-th shared column lies at most k - 1 plus the unshared ones from the start of either set."""
    room = [F.lit(1) - F.ceil(F.lit(percent) * F.col(n) / F.lit(100) - F.lit(1e-9)) + _need(percent) for n in ("nu", "nv")]
    return F.greatest(F.lit(1), F.least(*room))


def _product(cells: DataFrame, percent: int) -> DataFrame:
    """A row (u, v), ``shared`` 1, for each column that both have, within the size bound."""
    a, b = (cells.withColumnsRenamed({"c": x, "n": f"n{x}"}) for x in ("u", "v"))
    both = a.join(b, "col").where((F.col("u") < F.col("v")) & _fits(percent))
    return both.select("u", "v", "nu", "nv", F.lit(1).cast("long").alias("shared"))


def _leads(cells: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each cell's class with two classes of its column, which each column and turn draws anew."""
    draw = F.struct(F.xxhash64("c", "col", F.lit(turn)).alias("draw"), "c", "n", "comp")
    two = cells.groupBy("col").agg(F.min(draw).alias("low"), F.max(draw).alias("high"))
    may = lambda x: (x["comp"] != F.col("comp")) & (F.least("n", x["n"]) * 100 >= percent * F.greatest("n", x["n"]))
    met = cells.join(two, "col").select("c", "n", F.filter(F.array("low", "high"), may).alias("met"))
    met = met.select("c", "n", F.explode("met").alias("x"))
    flip = F.col("c") > F.col("x.c")
    ends = ((F.col("c"), F.col("x.c"), "u", "v"), (F.col("n"), F.col("x.n"), "nu", "nv"))
    met = met.select(*(c for a, b, u, v in ends for c in (F.when(flip, b).otherwise(a).alias(u), F.when(flip, a).otherwise(b).alias(v))))
    return met.withColumn("shared", F.lit(0).cast("long"))


def _possible(pairs: DataFrame, n_hot: DataFrame, percent: int, room: str) -> DataFrame:
    """Pairs whose overlap counted so far and columns not counted yet can reach the least one."""
    for x in ("u", "v"):
        pairs = pairs.join(n_hot.select(F.col("c").alias(x), F.col("h").alias(f"h{x}")), x, "left")
    unseen = F.least(F.coalesce("hu", F.lit(0)), F.coalesce("hv", F.lit(0)))
    return materialize(pairs.where(F.col("shared") + unseen >= _least_shared(percent)).select("u", "v"), f"{room}/pairs")


def _mixed(hot: DataFrame, comp: DataFrame, room: str) -> DataFrame:
    """The cells of columns that hold several components, with ``comp``."""
    hot = hot.join(sized(comp.withColumnRenamed("node", "c")), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    several = hot.groupBy("col").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("col")
    return materialize(hot.join(sized(several), "col"), f"{room}/mixed")


def _heads(cells: DataFrame, room: str) -> DataFrame:
    """The leading columns of every class that others have too, as one list, and its size ``n``."""
    return materialize(cells.groupBy("c").agg(F.first("n").alias("n"), F.collect_list("col").alias("cols")), f"{room}/heads")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("c")).union(pairs.select("v")).distinct()


def _enough(pairs: DataFrame, heads: DataFrame, percent: int, place: str = "enough") -> DataFrame:
    """The pairs that share as many leading columns as sets of their sizes that link; the lists are short beside whole sets."""
    heads = sized(heads.join(sized(_ends(pairs), label=f"{place}/ends"), "c"), SMALL, f"{place}/heads")
    u, v = (heads.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("cols").alias(f"cols{x}")) for x in ("u", "v"))
    both = pairs.select("u", "v").join(v, "v").join(u, "u")
    return both.where(F.size(F.array_intersect("colsu", "colsv")) >= _least_shared(percent)).select("u", "v")


def _links(pairs: DataFrame, heads: DataFrame, keyed: DataFrame, firsts: DataFrame, width: int, percent: int, room: str) -> DataFrame:
    """The pairs (u, v) of classes whose whole sets reach the threshold, stored; the sets go again."""
    spark, place = pairs.sparkSession, f"{room}/{uuid.uuid4().hex}"
    pairs = materialize(_enough(pairs, heads, percent, place), f"{place}/pairs")
    if not pairs.head(1):
        return spark.createDataFrame([], "u long, v long")
    wanted = sized(firsts.join(sized(_ends(pairs), label=f"{place}/involved"), "c"), label=f"{place}/wanted")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", PART):
            sets = pa.array([_signed(s) for s in _sets(batch, width)], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("c"), sets], ["c", "s"])

    sets = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["_id"]) & (keyed["key"] == wanted["_key"])).select("c", "t")
    # Rows that agree in doc_id and text are one class.
    sets = sized(sets.mapInArrow(whole, "c long, s array<long>"), SMALL, f"{place}/sets").dropDuplicates(["c"])
    left = sets.select(F.col("c").alias("u"), F.col("s").alias("su"))
    right = sets.select(F.col("c").alias("v"), F.col("s").alias("sv"))
    both = pairs.select("u", "v").join(right, "v").join(left, "u")
    shared = F.size(F.array_intersect("su", "sv"))
    linked = both.where(100 * shared >= percent * (F.size("su") + F.size("sv") - shared)).select("u", "v")
    linked = materialize(linked, f"{room}/links")
    remove_scratch(spark, place)
    return linked


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``key`` of the text, ``n_shingles``, ``component_id`` (smallest doc_id
    reachable by links) and ``stays`` (the one document of its group that is kept; an empty set always)."""
    with scratch_room(docs.sparkSession) as room:
        return _groups(_keyed(docs, text), width, percent, room)


def _groups(keyed: DataFrame, width: int, percent: int, room: str) -> DataFrame:
    spark = keyed.sparkSession
    whole = _incidence(keyed, width, percent, f"{room}/incidence/whole")
    rows = materialize(whole.drop("cols"), "rows")
    by_set = rows.where("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("doc_id", "key", "row")).alias("first"), F.min("doc_id").alias("least"))
    classes = materialize(by_set.withColumn("c", F.col("first.row")), "classes")
    firsts = classes.select("c", F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))
    # The leading columns of every class; those of a single class link nothing.
    cells = whole.withColumnRenamed("row", "c").join(sized(firsts.select("c")), "c")
    cells = cells.select("c", F.col("n").cast("int").alias("n"), F.posexplode("cols").alias("pos", "col"))
    # Counted where they are dealt to, so that they are shuffled once and their counts not at all.
    cells = cells.withColumn("k", F.count("*").over(Window.partitionBy("col"))).where("k > 1")
    cells = materialize(cells.withColumn("hot", F.col("k") > FEW).drop("k"), f"{room}/cells")
    remove_scratch(spark, f"{room}/incidence")
    cold = cells.where("not hot").select("col", "c", "n")
    hot = cells.where("hot").select("col", "c", "n", "pos")
    heads = _heads(cells, room)
    n_hot = sized(hot.groupBy("c").agg(F.count("*").alias("h")), label=f"{room}/n_hot")
    # The product: overlaps over the columns of few classes, and candidates from the others.
    pairs = _product(cold, percent).unionByName(_leads(hot.withColumn("comp", F.col("c")), 0, percent))
    pairs = pairs.groupBy("u", "v", "nu", "nv").agg(F.sum("shared").alias("shared"))
    links = _links(_possible(pairs, n_hot, percent, room), heads, keyed, firsts, width, percent, room)
    comp = materialize(components(links, room), f"{room}/comp")
    # Columns of many classes that still hold several components: more leads while pairs would be many and leads make them fewer.
    before = None
    for turn in range(1, TURNS + 2):
        mixed = _mixed(hot, comp, room)
        if turn > TURNS:
            break
        sizes = mixed.groupBy("col", "comp").agg(F.count("*").alias("m")).groupBy("col")
        sizes = sizes.agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("across"), F.sum("m").alias("cells"))
        across, n_cells = sizes.agg(F.coalesce(F.sum("across"), F.lit(0)), F.coalesce(F.sum("cells"), F.lit(0))).first()
        if across <= 8 * n_cells or (before is not None and 4 * across > 3 * before):
            break
        before = across
        led = materialize(_leads(mixed, turn, percent).select("u", "v").distinct(), f"{room}/pairs")
        comp = _merged(comp, _links(led, heads, keyed, firsts, width, percent, room), room, f"{room}/comp")
    # Then all pairs across components, each in the columns where it can first meet.
    mixed = _mixed(hot, comp, room)
    other = mixed.withColumnsRenamed({"c": "v", "n": "nv", "pos": "posv", "comp": "compv"})
    mixed = mixed.withColumnsRenamed({"c": "u", "n": "nu", "pos": "posu", "comp": "compu"})
    need = _need(percent)
    across = mixed.join(other, "col").where(
        (F.col("u") < F.col("v"))
        & (F.col("compu") != F.col("compv"))
        & _fits(percent)
        & (F.col("posu") <= F.col("nu") - need)
        & (F.col("posv") <= F.col("nv") - need)
    )
    across = materialize(across.select("u", "v").distinct(), f"{room}/across")
    # Stored outside the room: the result below reads it.
    comp = _merged(comp, _links(across, heads, keyed, firsts, width, percent, room), room, "components")
    named = classes.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    tops = named.groupBy("comp").agg(F.min("least").alias("component_id"), F.min(F.struct("first.doc_id", "first.key")).alias("_top"))
    by_class = named.join(tops, "comp").select("a", "b", "n", "component_id", "_top")
    out = rows.join(by_class, ["a", "b", "n"], "left")
    stays = (F.col("n") == 0) | F.struct("doc_id", "key").eqNullSafe(F.col("_top"))
    return out.select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        stays.alias("stays"),
    )


def drop_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """One document of each group, with all its columns (the one with the smallest doc_id)."""
    gone = groups(docs, width, percent, text).where("not stays").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    gone = sized(gone)
    keyed = docs.withColumn("_row_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_id"]) & (keyed["_row_key"] == gone["_key"]), "left_anti").drop("_row_key")
