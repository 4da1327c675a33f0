"""Text operators against plain versions, with nulls, empty and long texts, repeats and clashing columns."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from cpgloom.llm import decontaminate, line_dedup, lm_score, ngram_join, quality, sentencepiece_fst, suffix_dedup  # noqa: E402
from cpgloom.llm.common import fold, utf8, word_hashes  # noqa: E402

SCHEMA = "doc_id long, text string, key string, n long, col string, c int, ids string, spans string, cells int"


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["été", "日本", "A!b"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(25)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i, b in enumerate(base):
        texts.append(b)
        if i % 3 == 0:  # near copies
            w = b.split()
            w[len(w) // 2] = "changed"
            texts += [" ".join(w), b.upper()]
        if i % 4 == 0:
            texts.append(f"{b}\n{shared}\nshort line\n\nlast {i}")
    texts += [shared, shared, None, "", " \n\t ", "one", "one", "two words", "a " * 3000, "x" * 5000, "ab" * 900]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", 1, "x", 2, "i", "s", 3) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["Ab aB  ab\tabc", "", "x" * 300 + " y", " longer-than-eight longer-than-eighu "]
    h, n = word_hashes(*utf8(pa.array(texts)))
    assert n.tolist() == [4, 0, 2, 2]
    assert h[0] == h[1] == h[2] and len(set(h.tolist())) == 6
    assert fold(h, 4)[0] != fold(h[::-1].copy(), 4)[-1]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 60)])
def test_near_groups(docs, width, percent):
    want = brute.near_groups(corpus(), width, percent)
    got = {r.doc_id: r for r in ngram_join.groups(docs, width, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(brute.shingles(t, width)) for i, t in corpus()}


def test_columns_of_many_classes_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 1)
    got = {r.doc_id: r.component_id for r in ngram_join.groups(docs, 4, 85).collect()}
    assert got == brute.near_groups(corpus(), 4, 85)


def test_one_of_each_group_stays(docs):
    want = {i for i, c in brute.near_groups(corpus(), 5, 80).items() if i == c}
    out = ngram_join.drop_near_copies(docs, 5, 80)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == want


def test_lines(docs):
    want = brute.kept_lines(corpus())
    out = line_dedup.drop_repeated_lines(docs)
    assert {r.doc_id: (r.text, r.n_removed, r.n_lines) for r in out.collect()} == want


def test_lines_in_runs_of_short_ones(spark):
    poem = "roses are red\nviolets are\nblue and so\non it goes"
    rows = [(1, poem), (2, "violets are\nother words here"), (3, "start\n" + poem + "\nend"), (4, "blue and so")]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t for i, (t, _, _) in brute.kept_lines(rows).items()}
    assert got[3] == "start\nend" and got[2] == rows[1][1]


def test_decontamination(spark, docs):
    texts = dict(corpus())
    items = [(1, texts[0]), (2, "one"), (3, None), (4, " ".join((texts[3] or "").split()[2:15])), (5, "never seen words " * 5), (None, "one"), (2, "one")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, table).collect()}
    known = [x for x in items if x[0] is not None]
    for i, t in corpus():
        n, places, found = brute.hits(t, known)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, len(places), sorted(found)), i
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, table).collect()}
    assert clean == {i for i, t in corpus() if not brute.hits(t, known)[1]}


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, t) for i, t in corpus()[:30]], "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "items"]
    whole = sorted(map(tuple, decontaminate.contamination(docs, items).select(*columns).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, decontaminate.contamination(docs, items).select(*columns).collect())) == whole


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "beta alpha"), (3, "gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    near = {r.doc_id: r["items"] for r in decontaminate.contamination(docs, items, slop=1).collect()}
    assert near == {1: [1], 2: [], 3: []}


@pytest.mark.parametrize("length", [40, 101])
def test_suffixes(docs, length):
    rows = corpus()
    want = dict(zip([i for i, _ in rows], brute.without_repeats([t for _, t in rows], length), strict=True))
    out = suffix_dedup.drop_repeats(docs, length).collect()
    assert {r.doc_id: bytes(r.kept) for r in out} == want
    assert all(r.n_bytes - r.n_removed == len(r.kept) and r.n_removed == sum(b - a for a, b in r.removed) for r in out)


def test_suffixes_in_stretches(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    rows = corpus()
    want = dict(zip([i for i, _ in rows], brute.without_repeats([t for _, t in rows], 60), strict=True))
    # The patched bound travels with the function.
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.drop_repeats(docs, 60).collect()} == want


def test_repeated_rows_and_null_ids(spark):
    line = "some ten words of text that stand here twice in rows"
    rows = [(1, line), (1, line), (None, line), (None, None), (2, line + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(docs).count() == 5
    got = ngram_join.groups(docs, 4, 85)
    assert got.count() == 5 and got.where("n_shingles > 0 and doc_id is null").first().component_id == 1
    cut = suffix_dedup.drop_repeats(docs, 20).orderBy("doc_id").collect()
    assert len(cut) == 5 and all(bytes(r.kept) in (b"", b" more") for r in cut)
    items = spark.createDataFrame([(1, line)], "item_id long, text string")
    assert decontaminate.contamination(docs, items).where("n_hit > 0").count() == 4


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality.scores(none, labels).count() == 0
    assert ngram_join.groups(none).count() == 0
    assert ngram_join.drop_near_copies(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert suffix_dedup.drop_repeats(none).count() == 0
    assert sentencepiece_fst.decode(sentencepiece_fst.encode(none)).count() == 0
    assert lm_score.score(none, F.lit(True)).count() == 0


def test_quality_without_labels_and_with(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scores(docs, labels).collect()} == {0.5}
    rows = [(i, f"Calm words number {i} follow, one by one, in good order." if i % 2 else "BUY!! NOW!! " * (3 + i % 5)) for i in range(120)]
    many = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(900, None), (5, 7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scores(many, known).collect()}
    assert all(got[i].predicted == i % 2 for i in range(120))
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    kept = {r.doc_id for r in quality.keep_good(many, known).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (60, 3)), rng.normal(1, 2, (90, 3))]
    count, sums = np.array([60.0, 90.0]), np.array([a.sum(0) for a in x])
    model = quality.discriminant(count, sums, np.array([a.T @ a for a in x]), 0.0, 0.0)

    def log_density(p, a):
        c, d = np.cov(a.T), p - a.mean(0)
        return -0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d) - 0.5 * np.log(np.linalg.det(c))

    p = rng.normal(0.5, 1, (40, 3))
    odds = log_density(p, x[1]) - log_density(p, x[0]) + np.log(91 / 61)
    np.testing.assert_allclose(model.score(p), 1 / (1 + np.exp(-odds)), rtol=1e-6, atol=1e-12)


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    more = ["  ", "a  b   c", "   x\n\n  y ", "日本語 漢字 😀☃", " " * 33 + "if (a):\n\treturn 'z'  ", "the" * 40, "1234567890 3.14", "▁▁ a▁b"]
    rows = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    for r in sentencepiece_fst.decode(sentencepiece_fst.encode(docs.select("doc_id", "text").unionByName(rows))).collect():
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert list(r.ids) == lib.encode(r.text)
            assert r.decoded == r.text.replace("▁", " ")


def test_losses_by_hand(spark):
    texts = [(1, "abab", True), (2, "abc", False), (3, "", True), (4, None, False)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, good boolean")
    got = {r.doc_id: r for r in lm_score.score(docs, F.col("good")).collect()}

    def loss(rows, text):
        grams = [("\0\0" + t)[i : i + 3] for t in rows for i in range(len(t))]

        def p(context, last):
            inner = p(context[1:], last) if context else 1 / 256
            seen = [g[2] for g in grams if g[2 - len(context) : 2] == context]
            if not seen:
                return inner
            return (seen.count(last) + len(set(seen)) * inner) / (len(seen) + len(set(seen)))

        padded = "\0\0" + text
        return float(np.mean([-np.log(p(padded[i : i + 2], padded[i + 2])) for i in range(len(text))]))

    for i, t, _ in texts[:2]:
        assert got[i].target_loss == pytest.approx(loss(["abab"], t), rel=1e-5)
        assert got[i].background_loss == pytest.approx(loss(["abab", "abc"], t), rel=1e-5)
    assert got[3].score is None and got[4].n_tokens == 0
