"""Quality rules: gradient-boosted trees over document statistics, scored as flat node arrays.

Null or empty texts count as texts without words: they fail the base rule. Rows that repeat are judged alike. Columns
other than doc_id and text play no part in a verdict and pass through ``keep_good`` untouched. Without labels of both
classes there is no model, and the base rule alone decides. Texts are taken whole, of any length; hashes of a long one
are made a part at a time. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .textarrays import Texts, mixed, ngram_hashes, span_hashes, text_slices, _P

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: what the trees see, and how a score may change with it: 1 only up, -1 only down, 0 either way
FEATURES = {"log_words": 0, "chars_per_word": 0, "symbols_per_word": -1, "dup_lines_per_word": -1, "repeat_share": -1, "upper_share": 0, "distinct_share": 0}
#: at most so many labelled documents, those of the smallest hashed ids, are collected to fit the trees
LABEL_ROWS = 20_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, t: Texts) -> np.ndarray:
    return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(t.bounds, t.bounds[1:], strict=False)], np.int64)


def _repeated_lines(t: Texts) -> np.ndarray:
    """Of each text, the lines with a word that equal an earlier line."""
    n = len(t.data)
    cuts = np.flatnonzero(t.data == 10)
    starts = np.union1d(t.bounds[:-1][t.bounds[:-1] < n], cuts[cuts + 1 < n] + 1)
    ends = np.append(starts[1:], n)
    ends = np.where((ends > starts) & (t.data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if n else ends
    worded = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends = starts[worded], ends[worded]
    text = np.searchsorted(t.bounds, starts, "right") - 1
    key = mixed(span_hashes(t.data, starts, ends) + text.astype(np.uint64) * np.uint64(_P))
    _, at = np.unique(key, return_index=True)
    return np.bincount(text, minlength=t.n) - np.bincount(text[at], minlength=t.n)


def statistics(t: Texts) -> dict[str, np.ndarray]:
    """The base statistics of each text, and some that only models use."""
    words, owner = t.hashes(), t.owners()
    key = mixed(words + owner.astype(np.uint64) * np.uint64(_P))
    _, at = np.unique(key, return_index=True)
    covered = np.zeros(len(words) + 2, bool)
    if len(words) >= 3:
        windows = np.flatnonzero(owner[2:] == owner[:-2])
        grams = mixed(ngram_hashes(words, 3)[windows] + owner[windows].astype(np.uint64) * np.uint64(_P))
        _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
        again = windows[counts[which] > 1]
        for k in range(3):
            covered[again + k] = True
    inside = np.zeros(len(t.data) + 1, np.int8)
    np.add.at(inside, t.starts, 1)
    np.add.at(inside, t.ends, -1)
    free = np.cumsum(inside[:-1]).astype(bool)
    return {
        "n_words": np.diff(t.word_bounds), "word_chars": _per_text(free & _LEAD[t.data], t), "n_symbols": _per_text(_SYMBOL[t.data], t),
        "n_dup_lines": _repeated_lines(t), "n_repeat_words": np.bincount(owner[covered[: len(words)]], minlength=t.n),
        "n_upper": _per_text(_UPPER[t.data], t), "n_distinct": np.bincount(owner[at], minlength=t.n), "n_bangs": _per_text(t.data == 33, t),
    }


def feature_matrix(s: dict[str, np.ndarray]) -> np.ndarray:
    n = np.maximum(s["n_words"], 1)
    return np.column_stack([np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbols"] / n, s["n_dup_lines"] / n, s["n_repeat_words"] / n, s["n_upper"] / np.maximum(s["word_chars"], 1), s["n_distinct"] / n])


def document_features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The trees' features, and exclamation marks per word."""
    return np.column_stack([feature_matrix(s), s["n_bangs"] / np.maximum(s["n_words"], 1)])


@dataclass
class Trees:
    """All trees' nodes end to end; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.low[node], self.high[node])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[node].sum(1), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, bins: int = 48, rate: float = 0.25, ridge: float = 1.0) -> Trees:
    """Boosting on the logistic loss over binned features; a split that breaks a sign, or its parents' bounds, is not taken."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    width = bins + 1
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score, nodes, roots = np.full(len(y), base), [], []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int, lo: float, hi: float) -> int:
        at = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + ridge), lo, hi))
        nodes.append([0, 0.0, at, at, value * rate])
        best = (1e-6, None)
        for j in range(x.shape[1] if left and len(rows) >= 20 else 0):
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], width))[: len(edges[j])]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], width))[: len(edges[j])]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
            gain[(hl < 1) | (hr < 1) | (signs[j] * (vr - vl) < 0)] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        if best[1]:
            j, k, vl, vr = best[1]
            mid = (vl + vr) / 2
            to_left = binned[rows, j] <= k
            low = grow(rows[to_left], g, h, left - 1, lo if signs[j] >= 0 else mid, mid if signs[j] > 0 else hi)
            high = grow(rows[~to_left], g, h, left - 1, mid if signs[j] > 0 else lo, hi if signs[j] >= 0 else mid)
            nodes[at][:4] = [j, float(edges[j][k]), low, high]
        return at

    every = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(every, p - y, p * (1 - p), depth, -np.inf, np.inf))
        score = score + _one(nodes, roots[-1], depth, x)
    return _flat(nodes, roots, depth, base)


def _one(nodes: list, root: int, depth: int, x: np.ndarray) -> np.ndarray:
    f, t, low, high, value = (np.array(c) for c in zip(*nodes, strict=True))
    node, rows = np.full(len(x), root), np.arange(len(x))
    for _ in range(depth):
        node = np.where(x[rows, f[node]] <= t[node], low[node], high[node])
    return value[node]


def _flat(nodes: list, roots: list[int], depth: int, base: float) -> Trees:
    f, t, low, high, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(np.array(roots), f, t, low, high, value, depth, base)


def judged(batch: pa.RecordBatch, model: Trees | None) -> dict[str, np.ndarray]:
    parts = []
    for t in text_slices(batch):
        s = statistics(t)
        failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        p = model.probability(feature_matrix(s)) if model else np.where(failed, 0.0, 1.0)
        parts.append({k: s[k] for k in BASE} | {"base_failed": failed, "score": np.round(p, 6), "kept": ~failed & (p >= 0.5)})
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]} if parts else {}


def fitted(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> Trees | None:
    """Trees fitted to the labels (doc_id, quality) of at most label_rows documents, those of the smallest hashed ids."""
    few = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows))

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_slices(b):
                x = feature_matrix(statistics(t))
                yield pa.record_batch({"quality": b.column(1).slice(t.first, t.n).cast(pa.int64())} | {f: pa.array(x[:, j]) for j, f in enumerate(FEATURES)})

    got = (docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "quality")
           .mapInArrow(rows, "quality long, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().sort_values(list(FEATURES)))
    y = got["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    return fit_trees(got[list(FEATURES)].to_numpy(float), y, list(FEATURES.values()))


def quality_rules(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The statistics and the verdict of every document."""

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch({"doc_id": b.column(0)} | {k: pa.array(v) for k, v in judged(b, model).items()})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, score double, kept boolean").select("doc_id", *BASE, "base_failed", "kept", "score")


def keep_good(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The documents whose verdict is good, with all their columns."""

    @lean
    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(judged(b, model)["kept"]))

    return docs.mapInArrow(good, docs.schema)
