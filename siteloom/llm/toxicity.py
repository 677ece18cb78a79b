"""Toxicity by a linear-chain conditional random field over words with two tags, plain and toxic.

The labels mark documents, so word tags for training come first: words and word beginnings that occur in far more toxic
than plain documents of the sample (a likelihood-ratio test) tag the words of toxic documents. The field learns weights
of words, beginnings and endings, and of tag pairs. Its forward-backward marginals give each word a probability; sums
and maxima of these over a document give its score by a logistic model, and words above one half are the offending spans.

The model is fitted on a bounded sample of labelled rows (``PER_CLASS`` documents of each class, chosen by hash, and
near copies among them once). Everything else is done for all documents, each whole text in its task.

Cases: a null or empty text has no words and gets the score of a text without toxic words; labels that are null are
left out, of several labels of a document the largest counts; if either class is absent every score is 0 (no toxic
label) or 1 (only toxic ones); repeated rows are scored each; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest, xxh64_intdigest

from siteloom.llm.common import slices, tidy

#: Documents of each class in the sample, and most characters of one: longer labelled rows are not sampled.
PER_CLASS = {1: 700, 0: 1600}
LONGEST = 10_000
SEGMENT = 48
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’¿¡…–—"
_WORD = re.compile(r"\S+")


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    tags: np.ndarray  # 2 x 2, tag before and tag after, as factors
    document: np.ndarray  # weights of document_features


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 letters and its ending; ``word`` is lower case without outer punctuation."""
    return ["=" + word] + ["^" + word[:k] for k in range(3, min(6, len(word) - 1) + 1)] + (["$" + word[-4:]] if len(word) > 5 else [])


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _scan(factor: np.ndarray, counts: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Forward messages of all chains at once: row n is proportional to the sums over all tag paths up to word n.

    Every chain starts after a virtual plain word. Chains are cut into segments; products inside all segments run side by
    side, then the segments of each chain are joined in order. So the work is linear and a long chain costs few steps.
    """
    n, starts = int(counts.sum()), np.cumsum(counts) - counts
    segments = -(-counts // SEGMENT)
    first = np.cumsum(segments) - segments
    chain = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - starts[chain]
    row, col = first[chain] + place // SEGMENT, place % SEGMENT
    total = int(segments.sum())
    grid = np.ones((SEGMENT, total))
    grid[col, row] = factor
    products = np.empty((SEGMENT, 4, total))
    now = np.zeros((4, total))
    now[0] = now[3] = 1.0
    (a, b), (c, d) = tags
    for k in range(SEGMENT):
        step = products[k]
        step[0], step[1] = now[0] * a + now[1] * c, (now[0] * b + now[1] * d) * grid[k]
        step[2], step[3] = now[2] * a + now[3] * c, (now[2] * b + now[3] * d) * grid[k]
        step /= step.max(axis=0)
        now = step
    # the message before each segment
    before = np.zeros((2, total))
    order = np.argsort(-segments, kind="stable")
    alive, state = len(order), np.zeros((2, len(order)))
    state[0] = 1.0
    sizes = segments[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        alive = int(np.searchsorted(-sizes, -k, side="left"))
        at, state = first[order[:alive]] + k, state[:, :alive]
        before[:, at] = state
        last = now[:, at]
        state = np.stack([state[0] * last[0] + state[1] * last[2], state[0] * last[1] + state[1] * last[3]])
        state = state / state.max(axis=0)
    own = products[col, :, row]
    left = before[:, row]
    out = np.stack([left[0] * own[:, 0] + left[1] * own[:, 2], left[0] * own[:, 1] + left[1] * own[:, 3]], axis=1)
    return out / out.sum(axis=1, keepdims=True)


def marginals(scores: np.ndarray, counts: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of the toxic tag of each word, with the forward and the backward messages (both with the word's factor)."""
    if not len(scores):
        return np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2))
    factor = np.exp(np.clip(scores, -30, 30))
    ahead = _scan(factor, counts, tags)
    back = _scan(factor[::-1], counts[::-1], tags.T)[::-1]
    both = ahead * back
    both[:, 1] /= factor
    return both[:, 1] / both.sum(axis=1), ahead, back


def document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document: one, the log odds of its most toxic word, its expected number of toxic words (log), and their share."""
    chain = np.repeat(np.arange(len(counts)), counts)
    top = np.full(len(counts), 1e-6)
    np.maximum.at(top, chain, p)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    mass = np.bincount(chain, weights=p, minlength=len(counts))
    return np.stack([np.ones(len(counts)), np.log(top / (1 - top)), np.log1p(mass), np.sqrt(mass / np.maximum(counts, 1))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _distinct(samples: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """Without texts that share one of four least word-window hashes with an earlier one: near copies would count as evidence."""
    seen: set[tuple[int, int]] = set()
    out = []
    for words, toxic in samples:
        grams = np.array([xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))], np.uint64)
        marks = {(k, int((grams * np.uint64(2 * k + 0x9E3779B97F4A7C15)).min())) for k in range(4)}
        if words and not marks & seen:
            out.append((words, toxic))
        seen |= marks
    return out


def _evidence(samples: list[tuple[list[str], int]], least: float = 18.0) -> tuple[set[str], set[str]]:
    """Features that mark toxic documents, and those worth a weight. ``least``: of the likelihood-ratio statistic."""
    seen = {0: Counter(), 1: Counter()}
    size = Counter(t for _, t in samples)
    found = lambda words: {f for w in set(words) for f in features(w.strip(_EDGES))}
    # most features occur in a text or two; counts of hash buckets tell which ones are worth their names in memory
    buckets = np.zeros(1 << 21, np.int32)
    place = lambda f: xxh32_intdigest(f) & ((1 << 21) - 1)
    for words, _ in samples:
        np.add.at(buckets, [place(f) for f in found(words)], 1)
    for words, toxic in samples:
        seen[toxic].update(f for f in found(words) if buckets[place(f)] >= 4)

    def term(k: int, n: int, rate: float) -> float:
        return (k * math.log(k / n / rate) if k else 0.0) + ((n - k) * math.log((n - k) / n / (1 - rate)) if n > k else 0.0)

    toxic, useful = set(), set()
    for f, k in seen[1].items():
        other = seen[0][f]
        rate = (k + other) / (size[0] + size[1])
        if k + other < size[0] + size[1] and k / size[1] > 4 * other / size[0]:
            if 2 * (term(k, size[1], rate) + term(other, size[0], rate)) >= least:
                toxic.add(f)
    for f, k in (seen[0] + seen[1]).items():
        if k >= 8 or f in toxic:
            useful.add(f)
    return toxic, useful


def fit(samples: list[tuple[str, int]], prior: float, rounds: int = 20) -> Model:
    """Trains on a sample of (text, toxic) with the share ``prior`` of toxic documents among all labelled ones."""
    shared: dict[str, str] = {}  # one object per distinct word
    rows = _distinct([([shared.setdefault(w, w) for w in words_of(text)], toxic) for text, toxic in samples])
    if len({t for _, t in rows}) < 2:
        return Model({}, -10.0, np.full((2, 2), 0.5), np.array([40.0 if prior > 0.5 else -40.0, 0, 0, 0]))
    toxic, useful = _evidence(rows)
    # plain documents with none of the marking features teach little but the bias; all are kept, as distinct words with counts
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w.strip(_EDGES), len(numbers)) for words, _ in rows for w in words])
    counts = np.array([len(w) for w, _ in rows])
    names: dict[str, int] = {}
    pairs = [(n, names.setdefault(f, len(names))) for w, n in numbers.items() for f in features(w) if f in useful]
    pairs += [(n, names.setdefault("bias", len(names))) for n in numbers.values()]
    word, feature = np.array(pairs).T
    marked = np.zeros(len(numbers))
    for w, n in numbers.items():
        marked[n] = any(f in toxic for f in features(w))
    label = np.repeat([t for _, t in rows], counts)
    y = marked[ids] * label
    weights, grads = np.zeros(len(names)), np.full(len(names), 1e-8)
    weights[names["bias"]] = -3.0
    logs, log_grads = np.log(np.array([[0.97, 0.03], [0.5, 0.5]])), np.full((2, 2), 1e-8)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(counts) - 1] = False
    inner = np.flatnonzero(inner)
    seen_pairs = np.bincount((2 * y[inner] + y[inner + 1]).astype(int), minlength=4).reshape(2, 2)
    per_word = np.bincount(ids, weights=y, minlength=len(numbers))
    for _ in range(rounds):
        scores = np.bincount(word, weights=weights[feature], minlength=len(numbers))
        tags = np.exp(logs)
        p, ahead, back = marginals(scores[ids], counts, tags)
        missing = per_word - np.bincount(ids, weights=p, minlength=len(numbers))
        grad = np.bincount(feature, weights=missing[word], minlength=len(names)) - 0.5 * weights
        grads += grad**2
        weights += 1.0 * grad / np.sqrt(grads)
        joint = ahead[inner][:, :, None] * tags * back[inner + 1][:, None, :]
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        log_grad = seen_pairs - expected - 0.5 * logs
        log_grads += log_grad**2
        logs += 0.3 * log_grad / np.sqrt(log_grads)
    scores = np.bincount(word, weights=weights[feature], minlength=len(numbers))
    p, _, _ = marginals(scores[ids], counts, np.exp(logs))
    x, t = document_features(p, counts), np.array([t for _, t in rows], float)
    share = t.mean()
    weight = np.where(t == 1, prior / share, (1 - prior) / (1 - share))
    document = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps
        q = _sigmoid(x @ document)
        slope = x.T @ (weight * (t - q)) - 0.05 * document
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        document += np.clip(np.linalg.solve(curve, slope), -2, 2)
    kept = {f: float(weights[i]) for f, i in names.items() if f != "bias" and abs(weights[i]) > 1e-3}
    return Model(kept, float(weights[names["bias"]]), np.exp(logs), document)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on the bounded sample of the labelled rows of ``docs``."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where(F.length("text").between(1, LONGEST))
    shares = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return fit([], 0.0)
    sample = None
    for toxic, most in PER_CLASS.items():
        part = marks.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.union(part)
    # at most sum(PER_CLASS) ids, so the broadcast is bounded
    rows = texts.join(F.broadcast(sample), texts["_id"] == sample["doc_id"]).groupBy("_id").agg(
        F.max("toxic").alias("toxic"), F.min("text").alias("text")
    )
    return fit([(r.text, r.toxic) for r in sorted(rows.collect(), key=lambda r: r._id)], shares.get(1, 0) / sum(shares.values()))


class _Tagger:
    """Scores of words as they are in texts; keeps those of recent words."""

    KEPT = 100_000

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [words_of(t) for t in texts]
        known, weights, bias = self.known, self.model.weights, self.model.bias
        if len(known) > self.KEPT:
            known.clear()
        for words in lists:
            for w in set(words).difference(known):
                known[w] = bias + sum(weights.get(f, 0.0) for f in features(w.strip(_EDGES)))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        scores = np.empty(int(counts.sum()))
        at = 0
        for words in lists:
            scores[at : at + len(words)] = list(map(known.__getitem__, words))
            at += len(words)
        return scores, counts


def _spans(text: str, p: np.ndarray) -> list[dict[str, int]]:
    """Runs of toxic words as code point offsets, end exclusive."""
    places = [m.span() for m in _WORD.finditer(text)]
    if len(places) != len(p):  # characters that change their number in lower case cannot split words; kept as a guard
        return []
    out: list[dict[str, int]] = []
    for i in np.flatnonzero(p >= 0.5).tolist():
        if out and out[-1]["word"] == i - 1:
            out[-1] |= {"end": places[i][1], "word": i}
        else:
            out.append({"start": places[i][0], "end": places[i][1], "word": i})
    return [{"start": s["start"], "end": s["end"]} for s in out]


def _judged(tag: _Tagger, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The score of each text, the probabilities of all words, and how many words each text has."""
    scores, counts = tag(texts)
    p, _, _ = marginals(scores, counts, tag.model.tags)
    return _sigmoid(document_features(p, counts) @ tag.model.document), p, counts


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_toxic (expected number of toxic words) and the offending spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = _Tagger(shared.value)
        for rows in slices(batches, "text", 2 << 20):
            texts = pc.fill_null(rows.column("text"), "").to_pylist()
            value, p, counts = _judged(tag, texts)
            ends = np.cumsum(counts)
            top = np.maximum.reduceat(np.append(p, 0), np.minimum(ends - counts, len(p))) if len(counts) else ends
            spans = [
                _spans(t, p[e - n : e]) if n and x >= 0.5 else [] for t, e, n, x in zip(texts, ends.tolist(), counts.tolist(), top)
            ]
            mass = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=p, minlength=len(counts))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(value),
                    pa.array((value >= 0.5).astype(np.int32)),
                    pa.array(mass),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "score", "predicted", "n_toxic", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), f"doc_id {kind}, score double, predicted int, n_toxic double, spans array<struct<start:int,end:int>>"
    )


def held_out(doc_id):
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not found toxic, with their columns. Each row is judged by its own text, whatever its id."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = _Tagger(shared.value)
        for rows in slices(batches, "text", 2 << 20):
            value, _, _ = _judged(tag, pc.fill_null(rows.column("text"), "").to_pylist())
            yield rows.filter(pa.array(value < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
