"""Chat format, search and archives on small inputs; registered queries against SQL; the pipeline."""

import os
import random
import sys

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from cpgloom.llm import chat, hash_forest, queries, warc  # noqa: E402
from cpgloom.session import scratch_path  # noqa: E402

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "<", "\\", "s>", "[", "INST]", "|", "a"]), max_size=8).map("".join))
def test_escapes_come_back(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


def test_chat_edges(spark):
    said = "<|turn|> <\\|end|> </s>"
    rows = [(1, 1, "assistant", said), (1, 0, None, None), (1, 1, "assistant", said), (None, None, "user", ""), (2, 0, "assistant", "x" * 9000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    made = chat.render(turns)
    codec = chat.Codec(chat.vocabulary())
    parts = {(r.conv_id, r.place): r for r in made.collect()}
    assert parts[1, 3].offset == len(parts[1, 1].ids) + len(parts[1, 2].ids)
    assert sum(parts[2, 1].mask) == len(parts[2, 1].ids) - 3 - len(codec.encode("assistant"))
    assert codec.segments(list(parts[1, 2].ids)) == [("assistant", said)]
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].loss_chars) == (3, 2 * len(said), 0)
    assert chat.read_back(chat.render(turns.limit(0))).count() == 0


def test_neighbours_found_and_edges(spark, small):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # equal vectors
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0] * 5), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = {}
    for r in hash_forest.neighbours(table, F.col("vec_id") % 50 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append(r)
    good = [(i, np.array(v)) for i, v in rows if i is not None and i < 2000]
    assert set(got) == {i for i, _ in good if i % 50 == 0}
    hit = 0
    for q, found in got.items():
        at = dict(good)[q]
        want = sorted((float(np.sqrt(((v - at) ** 2).sum())), i) for i, v in good if i != q)[:10]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        hit += len({i for _, i in want} & {r.vec_id for r in found})
    assert hit >= 0.9 * 10 * len(got)
    few = hash_forest.neighbours(table.where("vec_id < 4"), F.col("vec_id") == 0, k=10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert hash_forest.neighbours(table.limit(0), F.lit(True)).count() == 0


def test_nearest_rows_of_a_part():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(500, 6)), np.ones((30, 6))])
    asked = np.concatenate([x[:5], np.ones((1, 6)), rng.normal(size=(70, 6))])
    for scale in (1.0, 1e200, 1e-200, 1e307):
        for q, (near, dist) in zip(asked, hash_forest.nearest(x * scale, asked * scale, 11), strict=True):
            want = np.sqrt(((x - q) ** 2).sum(1))
            cut = np.sort(want)[10]
            assert set(near) >= set(np.flatnonzero(want < cut * (1 - 1e-12))) and len(near) >= 11
            assert np.allclose(dist / scale, want[near], rtol=1e-12, atol=0)
    near, dist = next(hash_forest.nearest(x[:3], x[:1], 11))
    assert list(near) == [0, 1, 2] and dist[0] == 0


def test_huge_components_and_number_types(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 4))
    rows = [(i, (v * 1e200).tolist()) for i, v in enumerate(base)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in hash_forest.neighbours(table, F.col("vec_id") == 0, k=5).collect()]
    dist = np.sqrt(((base - base[0]) ** 2).sum(1))
    assert [i for _, i, _ in sorted(got)] == np.argsort(dist)[1:6].tolist()
    assert np.allclose([s / 1e200 for _, _, s in sorted(got)], np.sort(dist)[1:6])
    for kind in ("float", "int", "decimal(9,3)"):
        cast = spark.createDataFrame([(i, (v * 8).round(0).tolist()) for i, v in enumerate(base)], table.schema)
        cast = cast.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        whole = (base * 8).round(0)
        want = sorted((float(np.sqrt(((v - whole[0]) ** 2).sum())), i) for i, v in enumerate(whole) if i and v.any())[:5]
        found = hash_forest.neighbours(cast, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
        assert [(r.score, r.vec_id) for r in found] == want


def test_recall_of_the_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in queries.QUERIES["op7_hash_prefix_forest"](spark, small).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit.append(len(got[ids[i]] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    assert np.mean(hit) >= 0.9


@pytest.mark.parametrize("range_bytes", [700, 1 << 20])
def test_archive_round_trip(spark, range_bytes):
    rng = random.Random(2)
    noise = rng.randbytes(30_000).decode("latin-1")
    pages = [(i, f"http://a/{i % 4}", "<p>" + "é" * (i % 5) * 50) for i in range(60)]
    pages += [(100, None, None), (101, "u", ""), (102, "b\r\nX: y", "\x1f\x8b\x08 WARC/1.0 " + noise), (None, "n", ""), (5, "again", "<p>")]
    pages += [(200, "big", "0" * (17 << 20))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    folder = scratch_path(spark, "warc-test")
    warc.write(table, folder)
    got = warc.read(spark, folder, range_bytes if range_bytes > 1000 else 5000).collect()
    assert len(got) == len(pages)
    top = {}
    for i, _, t in pages:
        if i is not None:
            top[t or ""] = max(i, top.get(t or "", i))
    for i, _, t in pages:
        kind = "response" if i is None or top[t or ""] == i else "revisit"
        record = f"<urn:page:{i}>" if i is not None else None
        match = [r for r in got if r.record_id == record and r.payload_digest == warc.sha1_base32((t or "").encode())]
        # Rows that repeat both id and payload are all what that page is.
        assert len(match) == sum(j == i and (u or "") == (t or "") for j, _, u in pages)
        for r in match:
            assert r.record_type == kind and r.payload_bytes == len((t or "").encode())
            assert bytes(r.payload) == (b"" if kind == "revisit" else (t or "").encode())
            if kind == "revisit":
                assert r.refers_to_id == f"<urn:page:{top[t or '']}>"


@pytest.mark.parametrize("range_bytes", [3000, 1 << 20])
def test_long_headers_are_read(spark, range_bytes):
    rng = random.Random(4)
    long_url = "http://a/" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400_000))
    pages = [(1, "u", "one"), (2, long_url, "two"), (3, "v", "three")]
    folder = scratch_path(spark, "warc-long")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), folder)
    got = {r.record_id: r for r in warc.read(spark, folder, range_bytes).collect()}
    assert sorted(got) == [f"<urn:page:{i}>" for i in (1, 2, 3)]
    assert got["<urn:page:2>"].target_uri == long_url and bytes(got["<urn:page:2>"].payload) == b"two"


@pytest.mark.parametrize("harm", ["cut", "damaged"])
def test_broken_members_are_reported(spark, tmp_path, harm):
    rng = random.Random(5)
    pages = [(i, "u", rng.randbytes(3000).hex()) for i in range(5)]
    raw = [warc._record(i, u, t.encode(), None) for i, u, t in pages]
    data = bytearray(b"".join(raw))
    if harm == "cut":  # in the last record
        data = data[: -len(raw[4]) // 2]
        broken = 4
    else:
        place = len(raw[0]) + len(raw[1]) + len(raw[2]) // 2
        data[place : place + 40] = b"\xff" * 40
        broken = 2
    (tmp_path / "a.warc.gz").write_bytes(bytes(data))
    got = warc.read(spark, str(tmp_path), 2000).collect()
    assert sorted(r.record_id for r in got if r.record_type == "response") == [f"<urn:page:{i}>" for i in range(5) if i != broken]
    assert [(r.offset, r.payload) for r in got if r.record_type == "broken"] == [(sum(map(len, raw[:broken])), None)]


def test_archive_of_nothing(spark):
    folder = scratch_path(spark, "warc-none")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0


def test_pipeline_by_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, small)
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns
    held = [r for i, r in labels.items() if docs.where(F.col("doc_id") == i).count() and r.quality is not None]
    assert np.mean([(r.doc_id in kept) == bool(r.quality) for r in held]) > 0.95
    lines = brute.kept_lines(list(kept.items()))
    texts = {i: t for i, (t, gone, n) in lines.items() if not gone or gone < n}
    groups = brute.near_groups(list(texts.items()), 5, 80)
    single = {i: t for i, t in texts.items() if groups[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {i: t for i, t in single.items() if not brute.hits(t, items)[1]}
    out = corpus_pipeline.run(spark, small)
    assert out.columns == [*docs.columns, "ids", "n_tokens"]
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == clean
    assert all(r.n_chars == len(r.text) and r.n_tokens == len(r.ids) for r in got.values())
