"""Language identification of words, spans and documents.

A word is a longest run of letters (and of marks that go on one) of one script. The ranges of scripts narrow its candidates:
the languages that wrote at least MIN_SHARE of their learned letters in that script. A candidate's score for the word is the
log-probability of the word's code point trigrams, its edges included, in that language, add-one smoothed over a table of
hashed trigrams. Viterbi then chooses the languages of all words of a document so that the sum of scores, less SWITCHING for
every change of language, is greatest. Words that follow one another in a language are a span; a document's language is the
one with most letters in spans (ties: the first by name) and its score their share of all letters.

Viterbi runs over the words of many documents at once, in chunks that advance side by side: the best way through each
chunk from every language to every other, then the language at each chunk's beginning, then the ways back. Between documents
a change is free. So a text of any length is taken whole and a batch takes no step for each word.

What is learned is one count for each language and hashed trigram, of all texts that are learned from; the driver holds
BUCKETS counts for each of at most LANGUAGES languages (those of most documents, ties by name; others are not learned).

Null texts and texts without letters are `und` with score 0; so is all if nothing was learned. Words in a script of no
learned language are open to all of them. Texts without a language teach nothing. A null doc_id counts as an empty text
when documents are held out. Rows that repeat teach again and are answered again; an empty table has no rows. Columns other
than doc_id, text and (for learning) lang are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .textarrays import in_slices

BUCKET_BITS, LANGUAGES, MIN_SHARE, SWITCHING = 16, 200, 0.01, 8.0
BUCKETS = 1 << BUCKET_BITS
#: Chunks that Viterbi advances together, and the numbers they may hold.
CHUNKS, HELD = 2048, 1 << 20
UNKNOWN = "und"

# Blocks of the Unicode standard by script.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER = len(SCRIPTS) + 1


@lru_cache(1)
def code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: its script if it is a letter or a mark (else 0), whether it is a letter, its lower case."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    script = np.where(letter | np.array([k == "M" for k in kinds]), OTHER, 0).astype(np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            part = script[low : high + 1]
            part[part > 0] = k
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        if len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
    return script, letter, lower


@dataclass
class Words:
    """The words of some texts: where each begins and ends (code points of its text), its text, script and letters, and
    the trigram bucket of each letter with the word it is in."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    bucket: np.ndarray
    first: np.ndarray


def words_of(texts: list[str]) -> Words:
    script, letter, lower = code_points()
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    kind = script[codes]
    at = np.flatnonzero(kind)
    kind = kind[at]
    fresh = np.append(True, (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1]))[: len(at)]
    first = np.flatnonzero(fresh)
    low = lower[codes[at]]
    before = np.where(fresh, np.uint32(0), np.append(np.uint32(0), low[:-1])[: len(low)])
    after = np.where(np.append(fresh[1:], True)[: len(low)], np.uint32(0), np.append(low[1:], np.uint32(0))[: len(low)])
    bucket = ((before * np.uint32(0x9E3779B1) + low * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKET_BITS)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    text = np.searchsorted(bounds, at[first], "right") - 1
    letters = np.add.reduceat(letter[codes[at]].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    # a run of marks alone is no word
    real = letters > 0
    if not real.all():
        keep = np.repeat(real, np.diff(np.append(first, len(at))))
        bucket = bucket[keep]
        size = np.diff(np.append(first, len(at)))[real]
        text, begin, stop, kinds, letters = text[real], at[first][real], at[last][real], kind[first][real], letters[real]
        first = np.append(0, np.cumsum(size)[:-1]).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    else:
        begin, stop, kinds = at[first], at[last], kind[first]
    return Words(text, begin - bounds[text], stop + 1 - bounds[text], kinds, letters, bucket, first)


@dataclass
class Model:
    """languages (in order of names), log-probabilities of trigram buckets, and which languages write in each script."""

    languages: list[str]
    table: np.ndarray
    writes: np.ndarray

    def scores(self, w: Words) -> np.ndarray:
        """For each word and language the score, 0 for the best candidate and less for others."""
        out = np.zeros((len(w.first), len(self.languages)))
        if not len(w.first):
            return out
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.table[k][w.bucket], w.first)
        can = self.writes[w.script]
        out[~can] = -1e6
        out[~can.any(1)] = 0.0
        return out - out.max(1, keepdims=True)


def viterbi(scores: np.ndarray, fresh: np.ndarray, switching: float, chunks: int = CHUNKS) -> np.ndarray:
    """The language of each word so that scores less switching costs are greatest; before words that begin a text (fresh) a
    change is free. Of equal ways: stay, else come from the first language; end in the first."""
    n, m = scores.shape
    if not n or m == 1:
        return np.zeros(n, np.int64)
    chunks = max(1, min(chunks, HELD // (m * m), -(-n // 16)))
    steps = -(-n // chunks)
    s = np.zeros((chunks * steps, m))
    s[:n] = scores
    cost = np.zeros(chunks * steps)
    cost[:n] = np.where(fresh, 0.0, switching)
    s, cost = s.reshape(chunks, steps, m), cost.reshape(chunks, steps)
    # the best way through each chunk, from each language before it to each at its end
    through = np.where(np.eye(m, dtype=bool), 0.0, -np.inf) + np.zeros((chunks, 1, 1))
    for t in range(steps):
        through = np.maximum(through, through.max(2, keepdims=True) - cost[:, t, None, None]) + s[:, t, None, :]
    v, enters = np.zeros(m), np.zeros((chunks, m))
    for c in range(chunks):
        enters[c] = v
        v = (v[:, None] + through[c]).max(0)
        v = v - v.max()
    stay, best, v = np.zeros((steps, chunks, m), bool), np.zeros((steps, chunks), np.int16), enters
    for t in range(steps):
        best[t] = v.argmax(1)
        change = v.max(1) - cost[:, t]
        stay[t] = v >= change[:, None]
        v = np.maximum(v, change[:, None]) + s[:, t]
        v = v - v.max(1, keepdims=True)
    # the ways back from every language at a chunk's end, then which end each chunk has
    ways = np.zeros((steps, chunks, m), np.int16)
    end, row = np.tile(np.arange(m, dtype=np.int16), (chunks, 1)), np.arange(chunks)[:, None]
    for t in range(steps - 1, -1, -1):
        ways[t] = end
        end = np.where(stay[t][row, end], end, best[t][:, None])
    last = np.zeros(chunks, np.int64)
    at = int(v[-1].argmax())
    for c in range(chunks - 1, -1, -1):
        last[c] = at
        at = int(end[c, at])
    return ways[:, np.arange(chunks), last].T.reshape(-1)[:n].astype(np.int64)


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def fitted(labelled: DataFrame) -> Model:
    """The model of all texts with a language. labelled: text, lang."""
    known = labelled.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    # at most LANGUAGES rows
    languages = sorted(r["lang"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    number = {name: k for k, name in enumerate(languages)}

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((len(languages), BUCKETS), np.int64), np.zeros((len(languages), OTHER + 1), np.int64)
        for whole in batches:
            for b in in_slices(whole, most=1 << 20):
                rows = [(number[name], t or "") for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if name in number]
                w = words_of([t for _, t in rows])
                of = np.array([k for k, _ in rows], np.int64)[w.text] if rows else np.zeros(0, np.int64)
                size = np.diff(np.append(w.first, len(w.bucket)))
                grams += np.bincount(np.repeat(of, size) * BUCKETS + w.bucket, minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(of * (OTHER + 1) + w.script, weights=w.letters, minlength=scripts.size).reshape(scripts.shape).astype(np.int64)
        for lang, at, kind in ((*np.nonzero(grams), 0), (*np.nonzero(scripts), 1)):
            if len(lang):
                n = (scripts if kind else grams)[lang, at]
                yield pa.record_batch({"lang": pa.array(lang, pa.int32()), "place": pa.array(at + kind * BUCKETS, pa.int32()), "n": pa.array(n, pa.int64())})

    grams, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), OTHER + 1))
    if languages:
        # one row for each language and bucket
        got = known.mapInArrow(count, "lang int, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
        lang, place, n = (got.column(k).to_numpy() for k in range(3))
        gram = place < BUCKETS
        grams[lang[gram], place[gram]] = n[gram]
        scripts[lang[~gram], place[~gram] - BUCKETS] = n[~gram]
    table = np.log((grams + 1) / (grams.sum(1, keepdims=True) + BUCKETS)).astype(np.float32)
    return Model(languages, table, (scripts >= np.maximum(1, MIN_SHARE * scripts.sum(1, keepdims=True))).T)


def identified(docs: DataFrame, model: Model, switching: float = SWITCHING, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and n_spans; with_spans, also the spans: start, end (code points) and lang."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers of 4 bytes a language
    schema = "doc_id long, lang_pred string, score double, n_spans int" + ", spans array<struct<start: int, end: int, lang: string>>" * with_spans

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        m = len(model.languages)
        for whole in batches:
            for b in in_slices(whole, most=1 << 21):
                w = words_of([t or "" for t in b.column(1).to_pylist()])
                rows = b.num_rows
                if not m or not len(w.first):
                    out = {"doc_id": b.column(0), "lang_pred": [UNKNOWN] * rows, "score": pa.array([0.0] * rows), "n_spans": pa.array([0] * rows, pa.int32())}
                    yield pa.record_batch(out | ({"spans": pa.array([[]] * rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))} if with_spans else {}))
                    continue
                fresh = np.append(True, w.text[1:] != w.text[:-1])
                label = viterbi(model.scores(w), fresh, switching)
                letters = np.bincount(w.text * m + label, weights=w.letters, minlength=rows * m).reshape(rows, m)
                total, best = letters.sum(1), letters.argmax(1)
                begins = np.flatnonzero(fresh | np.append(True, label[1:] != label[:-1]))
                out = {"doc_id": b.column(0), "lang_pred": [model.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), total.tolist(), strict=True)], "score": pa.array(letters.max(1) / np.maximum(total, 1)), "n_spans": pa.array(np.bincount(w.text[begins], minlength=rows), pa.int32())}
                if with_spans:
                    stops = np.append(begins[1:], len(label)) - 1
                    spans: list[list[dict]] = [[] for _ in range(rows)]
                    for i, a, e, k in zip(w.text[begins].tolist(), w.start[begins].tolist(), w.end[stops].tolist(), label[begins].tolist(), strict=True):
                        spans[i].append({"start": a, "end": e, "lang": model.languages[k]})
                    out["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
                yield pa.record_batch(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
