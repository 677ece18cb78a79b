"""Tokens, toxicity, quality and near copies against brute force."""

import ctypes
import hashlib
import random
from collections import defaultdict

import numpy as np
import psutil
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteloom.llm import bpe, jaccard, mixture, quality, queries, toxicity
from siteloom.llm.common import give_back, save, tidy

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return bpe.read_ranks(None, tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN


@pytest.fixture
def saved(spark, tmp_path):
    def make(rows, schema="doc_id long, text string", parts=3):
        path = str(tmp_path / f"t{random.random()}")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make


def test_bpe_equals_the_library(saved, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = vocabulary
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    texts = [None, "", "a" * 20000, "  x  \n\n y \x1c\x1d z\x85 　q 's 'll I'LL don't", "ſK 12३४½ áb", " \t ", "the <|endoftext|> x", "•●∞" * 50]
    # characters of all planes; those newer than the libraries' tables are left out
    known = [c for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts += ["".join(chr(rnd.choice(known)) + rnd.choice(["", "a", " ", "1", "."]) for _ in range(1500)) for _ in range(6)]
    docs = saved(list(enumerate(texts)) + [(0, "again"), (None, "no id")])
    got = defaultdict(list)
    for r in bpe.encode(docs, ranks, pattern, block_words=700, buckets=5).collect():
        got[r.doc_id].append(list(r.ids))
    for i, text in enumerate(texts):
        assert library.encode_ordinary(text or "") in got[i], i
    assert sorted(got[0]) == sorted([[], library.encode_ordinary("again")]) and len(got[None]) == 1
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs.where("doc_id > 0"), ranks, pattern), ranks).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts) if i}
    assert bpe.encode(docs.limit(0), ranks, pattern).count() == 0


def test_a_round_trip_is_encode_and_decode(saved, vocabulary):
    ranks, pattern = vocabulary
    docs = saved([(0, None), (1, ""), (2, "don't  stop\n\n1234 ü世"), (2, "again"), (None, "no id"), (3, "ab 12 " * 70_000), (4, "x" * 3000)])
    for digests, with_ids in ((True, True), (True, False), (False, True), (False, False)):
        want = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, digests, with_ids)
        got = bpe.round_trip(docs, ranks, pattern, digests, with_ids, block_words=5000, buckets=7)
        assert got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert bpe.round_trip(docs.limit(0), ranks, pattern, digests=True).count() == 0


def test_decode_joins_pieces_of_any_list(spark):
    ranks = {b"a": 0, b"\xff": 1, b"long piece": 3}  # 2 is no token
    pieces, rnd = {0: b"a", 1: b"\xff", 2: b"", 3: b"long piece"}, random.Random(4)
    lists = [None, [], [2], [3, 1, 2, 0], [rnd.randrange(4) for _ in range(3 * bpe.PIECE)], *([rnd.randrange(4) for _ in range(rnd.randrange(5))] for _ in range(600))]
    encoded = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>").repartition(2)
    plain = {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, ranks).collect()}
    assert plain == {k: b"".join(pieces[i] for i in x or []) for k, x in enumerate(lists)}
    for r in bpe.decode(encoded, ranks, digests=True, with_ids=True).collect():
        x = lists[r.doc_id] or []
        assert r.ids == lists[r.doc_id] and r.n_tokens == len(x)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain[r.doc_id]).hexdigest()


def test_ids_are_decoded_where_they_are_made(spark, saved, vocabulary, tmp_path, capsys):
    """A second Python worker in each task of the last stage, and ids that go through the JVM, took the executor's memory and half of the time."""
    docs = saved([(0, "one text", "en", "a", 8)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for found in (corpus_pipeline.encode(spark, docs, ""), queries.op3_byte_bpe(spark, str(tmp_path))):
        found.explain()
        plan = capsys.readouterr().out
        assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_numbers_in_few_bytes_come_back():
    rnd = random.Random(9)
    for n in (0, 1, 7, bpe.PIECE, 2 * bpe.PIECE + 3):
        numbers = np.array([rnd.randrange(1 << rnd.choice([3, 7, 14, 21, 28, 31])) for _ in range(n)], np.int64)
        data = bpe._small(numbers)
        assert bpe._unsmall(data).tolist() == numbers.tolist() == bpe._unsmall(data, np.uint32).tolist()


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        k = min(words, len(w))
        sets.append(frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if k else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and 100 * o >= percent * (len(a) + len(sets[j]) - o):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def family_rows(seed, families, share):
    rnd, rows = random.Random(seed), []
    for _ in range(families):
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([1, 2, 3, 9, 12, 20, 45, 100, 130, 200, 400]))]
        for c in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // share))):
                k, op = rnd.randrange(len(w)), rnd.random()
                if op < 0.4:
                    w[k] = f"z{rnd.randint(0, 9999)}"
                elif op < 0.7:
                    w.insert(k, f"y{rnd.randint(0, 9999)}")
                elif len(w) > 1:
                    del w[k]
            rows.append((len(rows), " ".join(w).upper() if c == 3 else rnd.choice([" ", "\n"]).join(w)))
    return rows + [(9000, None), (9001, ""), (9002, " \n")]


@pytest.mark.parametrize("words, percent, tile, rare", [(3, 90, 1024, False), (5, 80, 4, False), (5, 80, 1024, True), (3, 90, 4, True)])
def test_jaccard_join(saved, words, percent, tile, rare):
    rows = family_rows(words, 40, 18 if percent == 90 else 30)
    # a passage in every third text
    rows += [(500 + i, " ".join(f"q{i}x{k}" for k in range(i)) + " shared passage " + " ".join(f"p{k}" for k in range(60))) for i in range(60)]
    got = jaccard.join(saved(rows), words, percent, tile, rare).select("doc_id", "n_shingles", "component_id")
    want = brute_components(rows, words, percent)
    assert sorted(map(tuple, got.collect())) == want
    assert len({w[2] for w in want}) < len(want) - 20


def test_keys_lose_no_pair():
    rnd = np.random.default_rng(5)
    for percent in (80, 90):
        bands = jaccard.Bands(percent, 100)
        for size in (130, 161, 200, 305, 800, 3000):
            a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
            most = bands.differ(int(np.searchsorted(bands.edges, len(a), side="right")) - 1)
            for removed in (0, most // 2, most):
                cut = int(removed * 0.9)
                b = np.unique(np.concatenate([a[cut:], rnd.integers(0, 1 << 63, removed - cut).astype(np.uint64)]))
                if jaccard._linked(a, b, bands) and max(len(a), len(b)) > bands.small:
                    assert np.intersect1d(bands.keys(a), bands.keys(b)).size, (percent, size, removed)


def test_tree_bound_is_safe():
    rnd, bands = np.random.default_rng(6), jaccard.Bands(9, 10)
    base = [np.unique(rnd.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(10)]
    sets = sorted((np.unique(np.concatenate([b[rnd.integers(0, 15) :], rnd.integers(0, 1 << 63, 5).astype(np.uint64)])) for b in base for _ in range(8)), key=len)
    points, sizes = jaccard._points(sets), np.array([len(s) for s in sets])
    tree = jaccard.RTree(points, sizes)
    for i, s in enumerate(sets):
        found = set(tree.search(points[i], len(s), bands).tolist())
        linked = {j for j, t in enumerate(sets) if jaccard._linked(s, t, bands)}
        assert linked <= found and len(found) < len(sets)


def test_one_of_each(saved):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (3, ""), (4, "x y z u v w"), (None, "x y z u v w"), (None, "lone text here")]
    kept = jaccard.one_of_each(saved(rows), 5, 80).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 3), (False, 4), (True, 0)]


def test_one_of_each_keeps_what_is_linked_with_nothing(saved):
    rows = [(None, "a b c d e f g"), (None, "A b c d e f g"), (None, "x y z u v w"), (None, "lone text here")]
    rows += [(7, "one text of its own"), (7, "quite another one that shares the id"), (7, "One text of its own")]
    rows += [(9, "p q r s t u v w"), (None, "P q r s t u v w"), (8, "p q r s t u v w"), (8, "k l m n o p")]
    kept = jaccard.one_of_each(saved(rows), 5, 80).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == [
        (0, "a b c d e f g"), (0, "lone text here"), (0, "x y z u v w"), (7, "one text of its own"), (7, "quite another one that shares the id"),
        (8, "k l m n o p"), (8, "p q r s t u v w"),
    ]


def test_whole_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Whatever the session says: a batch is held by the JVM and by Python, and near copies once went over an executor's memory."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    monkeypatch.setattr(jaccard, "save", lambda df, what="table", *size: seen.append((what, *size)) or save(df, what, *size))
    sized = tidy(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches))
    spark.conf.set(key, "10000")
    try:
        rows = save(spark.range(3000).coalesce(1).mapInArrow(sized, "n long"), "sizes", jaccard.ROWS).collect()
        docs = spark.createDataFrame([(i, f"one two three four five six seven {i // 2}") for i in range(20)], "doc_id long, text string")
        assert jaccard.one_of_each(docs).count() == 10
        assert spark.conf.get(key) == "10000"
    finally:
        spark.conf.set(key, before)
    assert sum(r.n for r in rows) == 3000 and max(r.n for r in rows) <= jaccard.ROWS
    assert {("nodes", jaccard.ROWS), ("rare", jaccard.ROWS), ("sets", jaccard.ROWS)} <= set(seen)


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the allocator has no such call")
def test_freed_memory_is_given_back():
    size = lambda: psutil.Process().memory_info().rss >> 20
    blocks = [np.ones(8000) for _ in range(3000)]  # small enough to stay with the allocator
    held, blocks = blocks[-1], None
    before = size()
    give_back()
    assert len(held) and size() < before - 100


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if root(i) != i}
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def test_quality(spark):
    rnd = random.Random(9)
    parts = ["a", "b", "é", "#", "\n", " ", "\t", "\x1c", "\xa0", "word ", "the cat sat on a mat by it ", "|| ", "😀 "]
    texts = [None, "", "x " * 30000] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 120))) for _ in range(300)]
    rows = [(i, t, rnd.choice(["en", None]), rnd.choice(["s", "t", None]), 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), i
        assert not (r.kept and r.base_failed)
    clean = ["".join(f"w{rnd.randint(0, 99999)} " for _ in range(60)) for _ in range(400)]
    rows = [(i, t, rnd.choice(["en", None]), rnd.choice(["s", "t", None]), 0) for i, t in enumerate(clean + [c.replace(" ", "%%% ") for c in clean[:40]])]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, DOCS)).where("kept").collect()}
    assert kept == set(range(400))
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_sketches_merge(spark):
    rows = [(i, f"{'x' * (i % 50 + 1)} " * 30, "en", "a" if i % 3 else "b", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    one = lambda d: quality.sketches(quality.measures(d))
    keys = ["lang", "source", "rule", "bucket"]
    parts = one(docs.where("doc_id < 100")).union(one(docs.where("doc_id >= 100"))).groupBy(*keys).agg(F.sum("docs").alias("docs"))
    assert sorted(parts.select(*keys, "docs").collect()) == sorted(one(docs).select(*keys, "docs").collect())
    lengths = sorted(i % 50 + 1 for i in range(300))
    median = quality.quantiles(one(docs).groupBy("rule", "bucket").agg(F.sum("docs").alias("docs")), [], {"q": 0.5}).where("rule = 'word_length'").first().q
    assert abs(median / lengths[149] - 1) < 0.02


def brute_targets(sums, weights=(3, 1, 2)):
    names = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [None] * (None in sums)
    weight, cap = {s: weights[i % 3] for i, s in enumerate(names)}, {s: 2 * sums[s] for s in names}
    total, full = 1.5 * sum(sums.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(cap[s] for s in full)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] > cap[s]}
        if not over:
            return {**{s: cap[s] for s in full}, **share}
        full |= over


def test_mixture(spark):
    rnd = random.Random(10)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)) if i % 50 else None, "en", rnd.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"]), 0) for i in range(1500)]
    rows = [r for r in rows if r[3] != "tiny" or r[0] < 40] + [(5, "w w", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixture.mix(docs).collect()
    sums = defaultdict(int)
    for r in rows:
        sums[r[3]] += len((r[1] or "").split())
    want = brute_targets(sums)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sums[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sums)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixture.mix(docs.repartition(7)).collect()), key=repr)
    assert mixture.mix(spark.createDataFrame([], DOCS)).count() == 0
    copies = mixture.repeats(docs.where("doc_id != 5")).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies) <= 2


def test_marginals_equal_enumeration():
    from itertools import product

    rnd = np.random.default_rng(11)
    tags, counts = np.array([[0.9, 0.1], [0.4, 0.7]]), np.array([3, 0, 1, 7, 60])
    scores = rnd.normal(size=int(counts.sum()))
    p, _, _ = toxicity.marginals(scores, counts, tags)
    for a, n in zip(np.cumsum(counts) - counts, counts):
        if 0 < n < 10:
            mass = np.zeros((n, 2))
            for path in product((0, 1), repeat=int(n)):
                w = np.prod([tags[x, y] for x, y in zip((0, *path), (*path, 0))]) * np.exp(sum(s for s, t in zip(scores[a : a + n], path) if t))
                for i, t in enumerate(path):
                    mass[i, t] += w
            assert np.allclose(p[a : a + n], mass[:, 1] / mass.sum(axis=1))


def test_toxicity(spark):
    rnd = random.Random(12)
    plain, bad = [f"word{i}" for i in range(300)], ["grunk", "blorf", "snerv"]
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        if i % 6 == 0:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(bad) + rnd.choice(["", ",", "s."])
        rows.append((i, " ".join(words).capitalize(), "en", "s", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "Word1 GRUNK word2", "en", "s", 0)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(3000, 1, None)], "doc_id long, quality int, toxic int")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, marks.where(~held))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [i for i in range(900) if got[i].predicted != int(i % 6 == 0)] == []
    assert got[2000].score < 0.5 and got[2001].score < 0.5
    assert [rows[-1][1][s.start : s.end] for s in got[2002].spans] == ["GRUNK"]
    left = toxicity.without_toxic(docs, marks)
    assert left.columns == docs.columns and left.where("doc_id < 900").count() == 750
    none = toxicity.score(docs, toxicity.train(docs, marks.limit(0)))
    assert none.where("predicted = 1").count() == 0 and toxicity.score(docs.limit(0), model).count() == 0


def test_without_toxic_judges_each_row(spark):
    rnd = random.Random(14)
    rows = [(i, " ".join(rnd.choice(["grunk", "blorf"] if i % 6 == 0 and k < 3 else [f"word{w}" for w in range(200)]) for k in range(30))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in rows], "doc_id long, toxic int")
    more = [(None, "word1 grunk blorf grunk"), (None, "word1 word2 word3"), (None, None), (5000, "word4 grunk blorf grunk"), (5000, "word4 word5 word6")]
    left = toxicity.without_toxic(spark.createDataFrame(rows + more, "doc_id long, text string"), labels)
    kept = [tuple(r) for r in left.where("doc_id is null or doc_id = 5000").collect()]
    assert sorted(kept, key=str) == sorted([more[1], more[2], more[4]], key=str)
    assert left.where("doc_id < 600").count() == 500


def test_rows_without_ids_are_joined_one_by_one(spark):
    """Near copies without an id, or with one id, meet their own text only: the work grows with the rows."""
    rnd = random.Random(9)
    rows = []
    for i in range(600):
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(60)]
        rows += [(None if i % 2 else 7, " ".join(words), "a", "b"), (None if i % 2 else 7, " ".join([*words[:59], "other"]), "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark string, _MARK_ string")
    assert jaccard.join(docs).where("n_shingles = 58").count() == 1200
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns and left.count() == 600
    assert left.select("_mark", "_MARK_").distinct().count() == 1
