"""Quality classifier from weak labels.

Heuristic labellers vote on every document: good, bad, or nothing. Expectation-maximisation over how often each pattern
of votes occurs (all documents count; there are at most 3**labellers patterns) estimates each labeller's accuracy in
either class and every pattern's posterior. A bounded sample of documents, labelled by their posteriors, then trains a
linear scorer over hashed words and hashed buckets of statistics, which judges every document by itself.

The sample is the documents with the smallest hashed ids, SAMPLE at most; nothing else is bounded. What reaches the
driver of a sampled document is how often it has each of the DIMS hashed words, so a text of any length is taken whole
and its share of memory is bounded. Null and empty texts have no words and are judged bad. Repeated rows are judged alike.
Columns other than doc_id and text play no part and pass through ``keep_good``. If no pattern has a majority of bad
votes, all documents are good. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import document_features as feature_matrix
from .quality_rules import statistics
from .shared import cut, lean
from .textarrays import Texts, mixed, text_slices

DIMS, SAMPLE = 1 << 16, 4000
# columns of feature_matrix
_LOG, _CHARS, _SYMBOLS, _LINES, _REPEAT, _UPPER, _DISTINCT, _BANGS = range(8)
#: name, vote, and the ranges (column, from, below) that all have to hold for it; else the labeller gives no vote
_ALL = float("inf")
LABELLERS = (
    ("many symbols", -1, ((_SYMBOLS, 0.25, _ALL),)),
    ("some symbols", -1, ((_SYMBOLS, 0.08, _ALL), (_LOG, 1.0, _ALL))),
    ("capitals", -1, ((_UPPER, 0.3, _ALL), (_LOG, 1.0, _ALL))),
    ("exclamations", -1, ((_BANGS, 0.25, _ALL), (_LOG, 1.0, _ALL))),
    ("repeated windows", -1, ((_REPEAT, 0.5, _ALL), (_LOG, 3.4, _ALL))),
    ("few distinct words", -1, ((_DISTINCT, 0.0, 0.42), (_LOG, 3.4, 7.0))),
    ("no or hardly any words", -1, ((_LOG, 0.0, 1.0),)),
    ("reads as prose", 1, ((_SYMBOLS, 0.0, 0.05), (_UPPER, 0.0, 0.12), (_REPEAT, 0.0, 0.3), (_LOG, 1.5, _ALL))),
    ("varied words of usual length", 1, ((_DISTINCT, 0.42, _ALL), (_CHARS, 2.5, 12.0), (_BANGS, 0.0, 0.1), (_LOG, 1.5, _ALL))),
    ("few symbols or signs", 1, ((_SYMBOLS, 0.0, 0.02), (_BANGS, 0.0, 0.05), (_LOG, 1.5, _ALL))),
)
_BUCKETS = tuple(np.array(e) for e in ((1, 2, 3, 4, 5, 6, 7, 8, 9), (2, 3, 4, 5, 6, 7, 8, 10, 12), (0.02, 0.05, 0.1, 0.2, 0.4, 0.8), (0.002, 0.01, 0.03, 0.1), (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9), (0.02, 0.05, 0.1, 0.2, 0.35, 0.6), (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7), (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)))


def votes(x: np.ndarray) -> np.ndarray:
    """One row a document, one column a labeller: -1 bad, 1 good, 0 nothing."""
    out = np.zeros((len(x), len(LABELLERS)), np.int8)
    for k, (_, vote, ranges) in enumerate(LABELLERS):
        out[:, k] = vote * np.all([(x[:, j] >= low) & (x[:, j] < high) for j, low, high in ranges], 0)
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(1).astype(np.int64)


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3).astype(np.int8) - 1


@dataclass
class WeakLabels:
    """What EM found: the share of good documents, P(vote | class) of each labeller, and each pattern's posterior."""

    prior: float
    table: np.ndarray  # class x labeller x vote (-1, 0, 1)
    posterior: dict[int, float]

    @property
    def accuracies(self) -> np.ndarray:
        """For each labeller the probability that its vote is right."""
        share = np.array([1 - self.prior, self.prior])[:, None] * np.stack([self.table[:, :, 0], self.table[:, :, 2]]).transpose(0, 1, 2)
        bad, good = share
        vote = np.array([v for _, v, _ in LABELLERS])
        return np.where(vote < 0, bad[0] / bad.sum(0), good[1] / good.sum(0))


def estimate(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> WeakLabels:
    """EM from the vote of the majority."""
    v = votes_of(pattern)
    p = 1 / (1 + np.exp(-2.0 * v.sum(1) - 1.0))
    total = count.sum()
    for _ in range(rounds):
        weight = np.stack([count * (1 - p), count * p])
        table = np.stack([np.stack([(weight[c][:, None] * (v == k)).sum(0) for k in (-1, 0, 1)], 1) + 0.5 for c in (0, 1)])
        table /= table.sum(2, keepdims=True)
        prior = np.clip(weight[1].sum() / total, 1e-3, 1 - 1e-3)
        log = np.log(np.stack([np.full(len(v), 1 - prior), np.full(len(v), prior)]))
        for c in (0, 1):
            log[c] += np.log(table[c][np.arange(v.shape[1]), v + 1]).sum(1)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done, p = np.abs(new - p).max() < 1e-9, new
        if done:
            break
    return WeakLabels(float(prior), table, dict(zip(pattern.tolist(), p.tolist(), strict=True)))


def hashed_features(t: Texts, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of a slice, and for each text those of its buckets."""
    words = (t.hashes() % np.uint64(DIMS)).astype(np.int64)
    buckets = np.column_stack([(mixed(np.searchsorted(e, x[:, j], "right").astype(np.uint64) + np.uint64(1000 * (j + 1))) % np.uint64(DIMS)).astype(np.int64) for j, e in enumerate(_BUCKETS)])
    return words, buckets


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return np.diff(sums[bounds]) / np.maximum(np.diff(bounds), 1)


@dataclass
class Scorer:
    words: np.ndarray
    buckets: np.ndarray
    bias: float

    def probability(self, t: Texts) -> np.ndarray:
        x = feature_matrix(statistics(t))
        words, buckets = hashed_features(t, x)
        z = self.bias + _means(self.words[words], t.word_bounds) + self.buckets[buckets].sum(1)
        return np.where(np.diff(t.word_bounds) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def train(words: list[np.ndarray], counts: list[np.ndarray], buckets: np.ndarray, target: np.ndarray, epochs: int = 80, rate: float = 0.3, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft targets by full-batch Adagrad. Of each document its distinct hashed words and how often
    it has them."""
    flat = np.concatenate(words) if len(words) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    share = np.concatenate([c / max(1, c.sum()) for c in counts]) if len(words) else np.zeros(0)
    w, b, bias = np.zeros(DIMS), np.zeros(DIMS), 0.0
    sw, sb, s0 = np.full(DIMS, 1e-3), np.full(DIMS, 1e-3), 1e-3
    for _ in range(epochs):
        z = bias + np.bincount(owner, w[flat] * share, len(words)) + b[buckets].sum(1)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        gw = np.bincount(flat, g[owner] * share, DIMS) + ridge * w
        gb = np.bincount(buckets.ravel(), np.repeat(g, buckets.shape[1]), DIMS) + ridge * b
        sw, sb, s0 = sw + gw**2, sb + gb**2, s0 + g.sum() ** 2
        w, b, bias = w - rate * gw / np.sqrt(sw), b - rate * gb / np.sqrt(sb), bias - rate * g.sum() / np.sqrt(s0)
    return Scorer(w, b, float(bias))


def fitted(docs: DataFrame, sample: int = SAMPLE) -> tuple[WeakLabels | None, Scorer | None]:
    """The vote model of all documents and a scorer trained on a sample of them; none where nothing is voted bad."""

    @lean
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_slices(b):
                p = patterns(votes(feature_matrix(statistics(t))))
                yield pa.record_batch({"doc_id": b.column(0).slice(t.first, t.n), "pattern": pa.array(p)})

    voted = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(vote, "doc_id long, pattern long"))
    rows = voted.groupBy("pattern").count().orderBy("pattern").collect()
    count = np.array([r["count"] for r in rows], float)
    pattern = np.array([r["pattern"] for r in rows], np.int64)
    if not len(rows):
        return None, None
    weak = estimate(pattern, count)
    if not any(p < 0.5 for p in weak.posterior.values()):
        return weak, None
    few = voted.where("doc_id is not null").groupBy("doc_id").agg(F.min("pattern").alias("pattern")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @lean
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_slices(b):
                words, buckets = hashed_features(t, feature_matrix(statistics(t)))
                found = [np.unique(words[a:e], return_counts=True) for a, e in zip(t.word_bounds, t.word_bounds[1:], strict=False)]
                yield pa.record_batch({"doc_id": b.column(0).slice(t.first, t.n), "pattern": b.column(2).slice(t.first, t.n), "words": pa.array([w.astype(np.uint16).tobytes() for w, _ in found], pa.binary()),
                                       "counts": pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary()), "buckets": pa.array(buckets.tolist(), pa.list_(pa.int64()))})

    got = (docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "pattern")
           .mapInArrow(features, "doc_id long, pattern long, words binary, counts binary, buckets array<long>").orderBy("doc_id", "words").collect())
    if not got:
        return weak, None
    target = np.array([weak.posterior[r["pattern"]] for r in got])
    return weak, train([np.frombuffer(r["words"], np.uint16).astype(np.int64) for r in got], [np.frombuffer(r["counts"], np.uint32) for r in got], np.array([r["buckets"] for r in got]), target)


def _verdicts(b: pa.RecordBatch, scorer: Scorer | None) -> np.ndarray:
    parts = [scorer.probability(t) if scorer else np.ones(t.n) for t in text_slices(b)]
    return np.round(np.concatenate(parts), 6)


def classified(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id, score (the probability of good quality) and kept."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = _verdicts(b, scorer)
                yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(p), "kept": pa.array(p >= 0.5)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """The documents that are judged good, with all their columns."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_verdicts(b, scorer) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
