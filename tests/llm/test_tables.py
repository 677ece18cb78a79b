"""Archives and nearest neighbours against brute force, and the pipeline against its own invariants."""

import base64
import glob
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteloom.llm import neighbours, warc
from siteloom.llm.common import lookup, shared_path

PAGES = "page_id long, url string, html string"


@pytest.fixture
def splits(spark):
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_archives(spark, splits, tmp_path):
    rnd = random.Random(2)
    rows = [
        (i, f"http://x/{i}\r\nA: b é", "é" * rnd.randint(0, 5) + "".join(rnd.choice("abc <>\n") for _ in range(rnd.randint(0, 3000))) if i % 3 else "same")
        for i in range(300)
    ]
    rows += [(5000, None, None), (5001, "u", ""), (None, "z", "same"), (7000, "inc", base64.b64encode(rnd.randbytes(200_000)).decode())]
    rows += [(7001, "big", "x" * 17_000_000)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, PAGES).repartition(3).write.parquet(path)
    out = shared_path(spark, "warc")
    warc.write(warc.plan_records(spark.read.parquet(path)), out)
    # any gzip reader unpacks the files
    files = [gzip.open(f).read() for f in glob.glob(out.removeprefix("file:") + "/part*")]
    assert sum(f.count(b"WARC/1.1\r\nWARC-Type: ") for f in files) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(
        (
            str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
            *(("response", "None") if first[h or ""] == i else ("revisit", str(first[h or ""]))),
        )
        for i, _, h in rows
    )
    for size in ("128m", "50k"):
        splits(size)
        got = warc.read(spark, out).drop("payload", "url").collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    assert warc.archive(spark.read.parquet(path).limit(0)).count() == 0


def test_magic_inside_members_and_across_ranges(spark, splits, tmp_path):
    rnd = random.Random(4)
    with open(tmp_path / "a.warc", "wb") as file:
        for i in range(120):
            data = warc.record(i, "u", "x" * rnd.randint(0, 400), None, False).replace(b"x" * 20, warc.MAGIC + b"\0" + b"q" * 16)
            packer = zlib.compressobj(0, zlib.DEFLATED, 31)
            file.write(packer.compress(data) + packer.flush())
    for size in ("128m", "900"):
        splits(size)
        assert sorted(r.page_id for r in warc.read(spark, str(tmp_path)).collect()) == list(range(120))


def test_small_payloads_stay_responses(spark):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")]
    got = {r.page_id: r.record_type for r in warc.archive(spark.createDataFrame(rows, PAGES), least_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_neighbours(spark):
    rnd = np.random.default_rng(1)
    data = rnd.standard_normal((1500, 32)).astype(np.float32)
    data[100:140] = data[7]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, block=400, query_block=6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    exact, hits = data.astype(float), 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(s == d[v] for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
    assert hits >= 0.95 * 150


def test_unusable_vectors(spark):
    odd = [
        (0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]),
        (None, [1.0, 1.0]), (6, [1.0, 2.0]), (7, [float("inf"), 1.0]), (200, [3.0]), (8, []),
    ]
    rows = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    got = neighbours.search(rows, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 6, 0.0), (0, 2, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 6, 0.0)]
    assert neighbours.search(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_lookup_keeps_rows_and_matches_nulls(spark):
    many = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3) for i in range(30)], "a int, k int")
    small = spark.createDataFrame([(None, "n"), (1, "one")], "k int, v string")
    got = lookup(many, small, ["k"], salts=4).collect()
    assert sorted((r.a, r.v) for r in got) == [(i, "n" if i % 3 == 0 else "one" if i % 3 == 1 else None) for i in range(30)]


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rnd = random.Random(5)
    plain = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(240):
        words = [rnd.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            words[3:3] = ["grunk", "blorf", "grunk"]
        rows.append((i, " ".join(words), "en", rnd.choice("ab"), 0))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, rows[1][1] + " end" * (i % 2), "en", "a", 0) for i in range(4)]
    rows += [(2000, "key token=abcdefgh123 " + rows[2][1][::-1], "en", "b", 0), (2001, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"stage{k}")
        stage(spark, now, str(tmp_path)).write.parquet(out)
        now = spark.read.parquet(out)
        seen[name] = now.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    toxic = {i for i in range(0, 240, 5)}
    assert {r.doc_id for r in seen["toxicity"]} == {r[0] for r in rows} - toxic
    assert {r.doc_id for r in seen["near copies"]} == {r[0] for r in rows} - toxic - {1000, 1001, 1002, 1003}
    assert [r.text[:13] for r in seen["secrets"] if r.doc_id == 2000] == ["key [secret] "]
    texts = {r.doc_id: r.text or "" for r in seen["secrets"]}
    assert len(seen["tokens"]) == len(seen["mixture"])
    for r in seen["tokens"]:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
