"""The two audits and the phrase fingerprints against brute force."""

import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import divergence, interaction, phrases

DOCS = "doc_id long, text string, lang string, source string, mask int, part string, first long, bucket int, _to int, at int"


@pytest.fixture
def docs(spark):
    """Rows with nulls, repeats, shared ids and columns named like those that the operators use inside."""

    def make(rows, parts=3):
        return spark.createDataFrame([(*r, 7, "x", 1, 2, 3, 4) for r in rows], DOCS).repartition(parts)

    return make


def some_rows(seed=1, n=120):
    rnd = random.Random(seed)
    words = ["a", "Be", "CEE", "dé", "e$", "ÉT", "fünf", "g-h", "x1y"]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(words[: rnd.randint(1, 9)]) for _ in range(rnd.choice([0, 3, 20, 200, 260])))
        rows.append((i, text + rnd.choice(["", "\n", " ", " "]), rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s0", "s1", "é", None])))
    rows += [(i + n, rows[5][1], "en", "s1") for i in range(6)] + [rows[3]] * 2 + [(3, "other $", "en", "s0")]
    return rows + [(None, rows[5][1], "en", "s0"), (None, None, None, None), (n + 50, None, "de", "s1"), (n + 51, "", "de", "s1")]


def test_interaction(docs, spark):
    rows = some_rows()
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 90, 2)] + [(4, 0, 1), (6, None, None), (None, 1, 1)]
    got = interaction.audit(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}

    def fails(doc_id, text):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows)
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": copy,
        }

    failed = [(source or "", doc_id, fails(doc_id, text or "")) for doc_id, text, _, source in rows]
    want = {}
    for part in {p for p, *_ in failed}:
        own = [(i, f) for p, i, f in failed if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[k]]
                kept = [(i, f) for i, f in left if not f[k]]
                all_failing = sum(f[k] for _, f in own)
                shapley[k] += len(gone)
                want[part, "".join(order), step] = [
                    len(kept), len(gone), all_failing - len(gone), sum(f[k] and sum(f.values()) == 1 for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), k,
                ]
                left = kept
        for key in want:
            if key[0] == part:
                want[key].append(shapley[want[key][6]])
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert [*(r[k] for k in interaction.SUMS), r["filter"], r["shapley"]] == want[r["part"], r["filter_order"], r["step"]]


def test_interaction_broadcasts_no_copies(docs, spark):
    """The looked-up tables grow with the documents and are copied, however little room their files take."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    plan = interaction.cells(docs([(i, "a", "en", "s") for i in range(3)]), labels)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_interaction_of_nothing(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(docs([(1, "a", "en", "s")]).limit(0), labels).count() == 0
    got = interaction.audit(docs([(1, "word " * 300_000, "en", "s")]), labels).where("step = 5").agg(F.sum("kept"), F.max("shapley")).first()
    assert tuple(got) == (0, 120)


def brute_divergence(rows, least, top):
    import re

    named = [(text or "", lang or "", source or "") for _, text, lang, source in rows]
    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for lang in {x[1] for x in named}:
        own = [(source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(upper))) for text, l, source in named if l == lang]
        sources = sorted({s for s, _ in own}, key=lambda s: s.encode())
        kept = [t for t in {t for _, w in own for t in w} if sum(t in w for _, w in own) >= least]
        count = {s: {t: sum(w.count(t) for x, w in own if x == s) for t in kept} for s in sources}
        every = {t: sum(count[s][t] for s in sources) for t in kept}
        p = lambda n: {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        shares, q = {s: p(count[s]) for s in sources}, p(every)
        for s in sources:
            pair = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(shares[s][t], q[t]), t) for t in kept if count[s][t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 5, divergence.BLOCK])
def test_divergence(docs, block):
    rows = some_rows(2) + [(900, None, "fr", "s0"), (901, "x y", "fr", "s1"), (902, "", "it", "s9")]
    for least in (1, 10):
        got = divergence.audit(docs(rows), least=least, block=block)
        assert sorted(map(tuple, got.collect())) == brute_divergence(rows, least, 10)


def test_divergence_of_nothing_and_of_much(docs, spark):
    assert divergence.audit(docs([(1, "a", "en", "s")]).limit(0)).count() == 0
    rows = [(i, "ab " * 400_000 + "cd", "en", f"s{i % 2}") for i in range(2)]
    assert sorted(map(tuple, divergence.audit(docs(rows), least=1).collect())) == brute_divergence(rows, 1, 10)
    # the long division, where one product would pass 2**63
    rnd = random.Random(5)
    for _ in range(200):
        total = rnd.randrange(1, 9 * 10**15)
        count = rnd.randrange(0, total + 1)
        assert int(divergence.share(count, total)) == 1 + 10**9 * count // total
        big = spark.range(1).select(divergence._share(F.lit(count), F.lit(total)).alias("p")).first()["p"] if _ < 3 else None
        assert big is None or big == 1 + 10**9 * count // total


def phrase_set(text):
    seen, now = set(), ""
    for c in text:
        now += c
        if now not in seen:
            seen.add(now)
            now = ""
    return seen


@pytest.mark.parametrize("n", [7, 40, phrases.ROWS])
def test_fingerprints(docs, spark, n):
    rnd = random.Random(3)
    rows = some_rows(4) + [(1000 + i, "".join(rnd.choice("abcd é😀\n") for _ in range(rnd.randint(0, 90))), "en", "s") for i in range(60)]
    rows += [(77, f"shared {i % 30} " * 3, "en", "s") for i in range(90)] + [(None, f"none {i}" * 4, "en", "s") for i in range(60)]
    table = docs(rows)
    hashes = {r.text: r.h for r in table.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", phrases._hash(F.col("text"))).collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    want, near, seen_at = [], {}, {}
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]]):
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        a, b, c = map(phrase_set, (text, edited, following))
        row = (str(i), len(text), hashlib.sha256(edited.encode()).hexdigest())
        want.append(row)
        near.setdefault(row, []).append((len(a & b) / (len(a | b) or 1) if a | b else 1.0, len(a & c) / len(a | c) if a | c else 1.0, len(a | b) <= phrases.SIZE))
        seen_at[row] = text
    got = phrases.fingerprints(table, n).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = {}
    for r in got:
        row = (str(r.doc_id), r.n_chars, r.edited_sha256)
        # equal texts have equal fingerprints
        assert prints.setdefault(seen_at[row], r.fingerprint) == r.fingerprint
        assert any(abs(r.near_edited - e) < (1e-9 if small else 0.3) and abs(r.near_next - x) < 0.3 for e, x, small in near[row])
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_few_and_long_rows(docs):
    assert phrases.fingerprints(docs([(1, "a", "en", "s")]).limit(0)).count() == 0
    only = phrases.fingerprints(docs([(1, "abcdefgh", "en", "s")])).collect()
    assert len(only) == 1 and only[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and only[0].near_next == 1
    blank = phrases.fingerprints(docs([(1, None, "en", "s"), (2, "", "en", "s"), (3, "abc", "en", "s")])).orderBy("doc_id").collect()
    assert [(r.fingerprint == "", r.near_edited, r.near_next) for r in blank] == [(True, 1, 1), (True, 1, 0), (False, 1, 0)]
    long = phrases.fingerprints(docs([(1, "abcdefgh" * 200_000, "en", "s"), (2, "x", "en", "s")])).orderBy("doc_id").collect()
    assert long[0].n_chars == 1_600_000 and 0.5 < long[0].near_edited < 1
    # the same whatever the hash of the process: 64 values of 12 digits
    assert len(long[0].fingerprint) == phrases.SIZE * phrases.DIGITS


def test_bucket_order(spark):
    """Buckets follow the order of rows, also for ids that are several edges."""
    rnd = np.random.default_rng(1)
    rows = [(int(i), int(h)) for i, h in zip(rnd.integers(0, 12, 400), rnd.integers(0, 1 << 62, 400) * 2)] + [(None, int(h) * 2) for h in rnd.integers(0, 1 << 62, 80)]
    table = spark.createDataFrame(rows, "doc_id long, hash long").withColumn("bucket", phrases._bucket([2, 5, 5, 5, 9], 3))
    placed = table.orderBy(F.col("doc_id").asc_nulls_last(), "hash").collect()
    assert [r.bucket for r in placed] == sorted(r.bucket for r in placed)
    assert {r.bucket for r in placed} == set(range(9))
