"""Exact copies, clusters in whole numbers and Merkle manifests against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgloom.llm import centroids, exact_dedup, merkle, queries
from cpgloom.operators import sizing


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_docs(n, seed=5):
    rng = random.Random(seed)
    texts = ["", None, "A", "a", "Hot copy", "\u00e9" * 50, "x" * 70_000, *[f"Text {i}" for i in range(n)]]
    rows = []
    for i in range(n):
        text = "Hot copy" if rng.random() < 0.3 else rng.choice(texts)
        source = None if rng.random() < 0.1 else rng.choice(["a", "a", "a", "b", "", "\uffee", "\U0001f600"])
        rows.append((i if rng.random() < 0.97 else None, text, rng.choice(["en", None, "-"]), source, rng.choice([None, i])))
    return rows + rows[:5]


# --- exact copies ---------------------------------------------------------------------------------


def copies(rows):
    """Id that stays and size of the group of every text."""
    top, size = {}, Counter(r[1] or "" for r in rows)
    for i, t, *_ in rows:
        t = t or ""
        top[t] = max([x for x in (top.get(t), i) if x is not None], default=None)
    return top, size


@pytest.mark.parametrize("broadcast", [None, -1])
def test_copies(spark, monkeypatch, broadcast):
    if broadcast:  # the filters meet the hashes by a shuffle, and the hottest groups their rows by a broadcast
        monkeypatch.setattr(sizing, "BROADCAST_BYTES", broadcast)
        monkeypatch.setattr(exact_dedup, "LARGE", 50)
    rows = some_docs(400)
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("kept", F.lit("mine")).withColumn("word", F.lit(1)).withColumn("bits", F.lit(2))
    top, size = copies(rows)
    got = exact_dedup.mark_copies(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    for r in got:
        t = r.text or ""
        assert (r.keep_id, r.group_size, r.text_sha256) == (top[t], size[t], sha(t))
        assert not r.kept or r.doc_id == top[t]
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({sha(t): 1 for t in size})
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(map(repr, (r.text or "" for r in left.collect()))) == sorted(map(repr, size))
    assert {r.kept for r in left.collect()} == {"mine"}


@pytest.mark.parametrize("words", [1, 7, 100])
def test_filter_misses_no_repeat(spark, words):
    rng = random.Random(words)
    hashes = [rng.randrange(60) for _ in range(90)]
    df = spark.createDataFrame([(h,) for h in hashes], "_h long")
    bits = exact_dedup.repeated_bits(df, 1, words)
    hit = {r._h for r in exact_dedup._passing(df, bits, 1, words).where("_hit").collect()}
    assert hit >= {h for h, c in Counter(hashes).items() if c > 1}
    if words == 100:  # and few others pass
        assert len(hit) < len(set(hashes))


def test_copies_of_nothing_and_of_singles(spark):
    assert exact_dedup.mark_copies(spark.createDataFrame([], DOCS)).count() == 0
    assert exact_dedup.drop_copies(spark.createDataFrame([], DOCS)).count() == 0
    alone = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")
    assert exact_dedup.mark_copies(alone).where("kept and group_size = 1 and keep_id = doc_id").count() == 3000


def test_native_plan(spark, small):
    plan = queries.QUERIES["op13_exact_dedup"](spark, small)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "PythonUDF"))


# --- clusters -------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, dim):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dim and all(y is not None and np.isfinite(y) and abs(y * 1024) < 2**26 for y in x):
            kept.append((i, [int(np.floor(y * 1024)) for y in x]))
    first = sorted((sha(f"3:{i}"), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (c, _) in zip(kept, found) if c == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, c, d) for (i, _), (c, d) in zip(kept, assign())] if centres else [], centres


def some_vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(y) for y in rng.normal(i % 3, 0.4, dim)]) for i in range(n)]
    rows += [(900, None), (901, [1.0] * (dim + 1)), (902, [None] + [0.0] * (dim - 1)), (903, [float("nan")] * dim), (904, [float("inf")] * dim)]
    rows += [(905, [1e300] * dim), (None, [0.5] * dim), (906, [0.0] * dim), (906, [0.0] * dim), (3, [2.0] * dim), (907, [-65535.9] * dim)]
    return rows


@pytest.mark.parametrize(("n", "k", "rounds"), [(60, 8, 10), (60, 3, 1), (60, 4, 0), (2, 8, 10)])
def test_clusters(spark, n, k, rounds):
    rows = some_vectors(n, 5, n + k)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    df = df.withColumn("v", F.lit("x")).withColumn("cluster", F.lit("y")).withColumn("distance", F.lit(1))
    found, centres = centroids.cluster(df, k=k, rounds=rounds, dim=5)
    want, want_centres = lloyd(rows, k, rounds, 5)
    assert centres.tolist() == want_centres
    got = centroids.summarised(found, centres).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == sha(",".join(map(str, want_centres[r.cluster])))


def test_clusters_stop_when_centroids_stand(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, centres = centroids.cluster(df, k=2, dim=2, rounds=50)
    want, want_centres = lloyd(rows, 2, 50, 2)
    assert (centres.tolist(), Counter(tuple(r) for r in found.drop("v").collect())) == (want_centres, Counter(want))


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    for df in (none, none.limit(0)):
        assert centroids.summarised(*centroids.cluster(df)).count() == 0


# --- manifests ------------------------------------------------------------------------------------


def plain_tree(nodes, fan):
    """Root, and for each node the flanks up to it."""
    place, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for j, p in enumerate(place):
            run = p // fan * fan
            paths[j].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + fan])))
        nodes = [sha("".join(nodes[a : a + fan])) for a in range(0, len(nodes), fan)]
        place = [p // fan for p in place]
    return nodes[0], paths


def plain_leaf(row, lower=False):
    i, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def plain_manifest(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in groups[s]], fan)
    root, over = plain_tree([trees[s][0] for s in names], fan)
    out = []
    for s, up in zip(names, over):
        for r, path in zip(groups[s], trees[s][1]):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = plain_leaf(r, cut)
            for before, after in path + up:
                h = sha(before + h + after)
            proof = sha("".join(a + b for a, b in path + up))
            out.append((r[0], plain_leaf(r), trees[s][0], root, proof, h))
    return out


@pytest.mark.parametrize(("n", "fan"), [(300, 16), (700, 16), (120, 2), (1, 16), (60, 3)])
def test_manifest(spark, monkeypatch, n, fan):
    monkeypatch.setattr(merkle, "FAN", fan)
    monkeypatch.setattr(merkle, "BLOCK", fan * fan)
    rows = some_docs(n)
    if n == 700:  # a source of more than one block of blocks' leaves
        rows = [(r[0], r[1], r[2], "a" if i % 10 else r[3], r[4]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("pos", F.lit("x")).withColumn("hash", F.lit("y"))
    got = merkle.manifest(df, tampered=merkle.lowered()).collect()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == sorted(map(repr, plain_manifest(rows, fan)))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096, 4097])
def test_one_source_of_every_shape(spark, n):
    rows = [(i, f"T{i}", "en", "only", i) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), tampered=merkle.lowered())
    assert sorted(tuple(r) for r in got.drop("source", "path").collect()) == sorted(plain_manifest(rows, 16))


def test_many_sources(spark):
    rows = [(i, "t", None, f"s{i}", None) for i in range(600)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), tampered=merkle.lowered())
    assert sorted(tuple(r) for r in got.drop("source", "path").collect()) == sorted(plain_manifest(rows, 16))


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_pairs_short_of_leading_columns_read_no_whole_set(spark):
    """Two sets of 100 that link at 85 % share 92 columns, so 8 of their 16 leading ones; pairs with 7 go before whole sets are read."""
    from cpgloom.llm import ngram_join

    cols = {1: range(16), 2: range(8, 24), 3: range(9, 25), 4: [*range(8, 16), *range(30, 50)]}
    heads = spark.createDataFrame([(c, 100, list(x)) for c, x in cols.items()], "c LONG, n INT, cols ARRAY<LONG>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "u LONG, v LONG")
    assert sorted(tuple(r) for r in ngram_join._enough(pairs, heads, 85).collect()) == [(1, 2), (1, 4)]


def _generated(node):
    """Rows that the Generate nodes of an executed plan made."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _generated(node.executedPlan())
    if "QueryStage" in name:
        return _generated(node.plan())
    own = node.metrics().apply("numOutputRows").value() if name == "Generate" else 0
    return own + sum(_generated(node.children().apply(i)) for i in range(node.children().size()))


def test_leads_are_made_only_where_sizes_may_link(spark):
    from cpgloom.llm import ngram_join

    cells = spark.createDataFrame([(1, i, 10 if i % 2 else 100, i) for i in range(40)], "col long, c long, n int, comp long")
    leads = ngram_join._leads(cells, 0, 85)
    rows = leads.collect()
    assert rows and all(r.u < r.v and r.nu == r.nv for r in rows)
    assert _generated(leads._jdf.queryExecution().executedPlan()) == len(rows)


def test_turns_that_join_nothing_are_the_last(spark, monkeypatch):
    from cpgloom.llm import ngram_join

    turns, leads = [], ngram_join._leads
    monkeypatch.setattr(ngram_join, "_leads", lambda cells, turn, percent: turns.append(turn) or leads(cells, turn, percent))
    monkeypatch.setattr(ngram_join, "FEW", 1)
    same = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"{same} own{i}") for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs, 4, 85).collect()}
    assert got == {i: (10, i) for i in range(60)}
    assert turns == [0, 1]


def test_later_links_join_whole_components(spark):
    from cpgloom.llm import ngram_join

    edges = lambda *x: spark.createDataFrame(x, "u long, v long")
    first = ngram_join.components(edges((5, 4), (4, 3), (9, 8), (20, 21)), "room-test")
    got = ngram_join._merged(first, edges((5, 9), (7, 8), (30, 31), (31, 31)), "room-test", "room-test/comp")
    assert sorted(map(tuple, got.collect())) == [(3, 3), (4, 3), (5, 3), (7, 3), (8, 3), (9, 3), (20, 20), (21, 20), (30, 30), (31, 30)]
    assert ngram_join._merged(first, edges((3, 3)), "room-test", "room-test/comp").count() == 7
