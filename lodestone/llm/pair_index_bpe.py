"""Byte-pair encoding by an index from each pair to all its places in a partition, and decoding.

All distinct words of a partition (of each PART bytes of a larger one) that the worker does not know yet are laid end to
end as symbols. The index holds the places of every adjacent pair that has a rank; ranks are taken in ascending order,
each merged wherever it still stands, and the pairs that a merge makes join the lists of their own ranks. Merges of a
trained vocabulary only ever make pairs of later ranks, which is checked when it is loaded, so all words can share one
order. Decoding starts from the ids alone.

Null texts are empty ones: no ids, an empty decoded text. Rows that repeat are encoded alike; texts of any length are
taken whole. Columns other than doc_id and text are not read. Special tokens in a text become their ids, as the public
library has them. An empty table gives an empty result. Bounded memory: a worker holds PART bytes of texts (or one
longer batch) and at most twice KEPT pieces and as many words; of a part with more than KEPT new pieces, the rest are
indexed slice by slice.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .textarrays import in_slices
from .tokens import BEYOND_LATIN, CLIP_PATTERN, LATIN_WORDS, Recent, byte_characters, _ODD_CHARACTERS

KEPT, PART = 250_000, 64 << 20


class PairIndexBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split != CLIP_PATTERN or spec["decoder"] or model.get("byte_fallback"):
            raise ValueError("this vocabulary's rules are not the ones implemented here")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.bytes = byte_characters()
        self.first = {c: vocab[c] for c in self.bytes}
        self.last = {c: vocab[c + self.suffix] for c in self.bytes}
        self.token = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.digits = {i: str(i) for i in self.token}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.rank: dict[int, int] = {}
        self.merge: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, new = vocab[a], vocab[b], vocab[a + b]
            if max(made.get(x, -1), made.get(y, -1)) >= r:
                raise ValueError("merges have to come after those that make their parts")
            made.setdefault(new, r)
            self.rank.setdefault(x * self.size + y, r)
            self.merge.append((x, y, new))
        self.words = regex.compile(split)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: Recent = Recent()
        self.word_ids: Recent = Recent()

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by one pass over the ranks that occur in any of them."""
        symbol: list[int] = []
        begin: list[int] = []
        after: list[int] = []
        before: list[int] = []
        names, first, last, size, rank = self.bytes, self.first, self.last, self.size, self.rank
        for w in words:
            at = len(symbol)
            begin.append(at)
            chars = [names[b] for b in w.encode()]
            n = len(chars)
            symbol += [first[c] for c in chars[:-1]]
            symbol.append(last[chars[-1]])
            after += range(at + 1, at + n)
            after.append(-1)
            before.append(-1)
            before += range(at, at + n - 1)
        places: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (r := rank.get(symbol[i] * size + symbol[j])) is not None:
                places.setdefault(r, []).append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = self.merge[r]
            for i in sorted(places.pop(r)):
                if symbol[i] != a or (j := after[i]) < 0 or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = new, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (q := rank.get(new * size + symbol[k])) is not None:
                        if q not in places:
                            places[q] = []
                            heapq.heappush(active, q)
                        places[q].append(i)
                if (h := before[i]) >= 0 and (q := rank.get(symbol[h] * size + new)) is not None:
                    if q not in places:
                        places[q] = []
                        heapq.heappush(active, q)
                    places[q].append(h)
        begin.append(len(symbol))
        return [[s for s in symbol[a:b] if s >= 0] for a, b in zip(begin, begin[1:], strict=False)]

    def _parts(self, piece: str) -> list:
        """The words of a piece, and the special tokens in it as ids."""
        if (piece.isascii() or not BEYOND_LATIN.search(piece)) and "<|" not in piece and piece.split() == [piece]:
            low = piece.lower()
            return [low] if low.isalpha() else LATIN_WORDS.findall(low)
        out: list = []
        for part in self.specials.split(piece) if self.specials else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += self.words.findall(plain)
        return out

    def learn(self, pieces: set[str]) -> None:
        known, words = self.known, self.word_ids
        parts = {}
        for p in pieces:
            if (old := known.older.get(p)) is not None:
                known[p] = old
            else:
                parts[p] = self._parts(p)
        new = []
        for w in {w for ws in parts.values() for w in ws}.difference(words):
            if (old := words.older.get(w)) is not None:
                words[w] = old
            elif isinstance(w, int):
                words[w] = (w,)
            else:
                new.append(w)
        words.update(zip(new, map(tuple, self.encode_words(new)), strict=True))
        for p, ws in parts.items():
            known[p] = words[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable([words[w] for w in ws]))

    @staticmethod
    def _cut(text: str) -> list[str]:
        return ([text] if text else []) if any(c in text for c in _ODD_CHARACTERS) else text.split()

    def index_part(self, slices: Iterator[list[str]]) -> None:
        """One index over the new words of a part of a partition, so that encoding finds them known."""
        self.known, self.word_ids = self.known.aged(KEPT), self.word_ids.aged(KEPT)
        new: set[str] = set()
        for texts in slices:
            new |= set().union(*map(self._cut, texts)).difference(self.known)
            if len(new) > KEPT:
                break
        if new:
            self.learn(new)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Each text's ids."""
        self.known, self.word_ids = self.known.aged(KEPT), self.word_ids.aged(KEPT)
        cut = list(map(self._cut, texts))
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, ps))) for ps in cut]

    def encode(self, text: str) -> list[int]:
        return self.ids([text])[0]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes with a vocabulary that names no decoder: tokens with a space between them."""
        try:
            return " ".join(map(self.token.__getitem__, ids))
        except KeyError:
            return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(2)
def pair_index(name: str) -> PairIndexBpe:
    import os

    import public_tokenizers

    return PairIndexBpe(name if os.path.sep in name else public_tokenizers.path(name))


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """A partition's batches in parts of about PART bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded_slices(batches: Iterator[pa.RecordBatch], bpe: PairIndexBpe) -> Iterator[tuple[pa.Array, list[list[int]]]]:
    """doc_id and ids of the rows of a partition, slice by slice, each part of it indexed once."""
    texts = lambda b: [t or "" for t in b.column(1).to_pylist()]
    for part in _parts_of(batches):
        bpe.index_part(texts(b) for whole in part for b in in_slices(whole, most=1 << 20))
        for whole in part:
            for b in in_slices(whole, most=1 << 20):
                yield b.column(0), bpe.ids(texts(b))


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of every document."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, ids in _encoded_slices(batches, pair_index(tokenizer)):
            yield pa.record_batch({"doc_id": names, "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text that its ids decode to."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pair_index(tokenizer)
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "text": pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())})

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: its number of ids, and digests of the ids and of what decoding these ids gives."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pair_index(tokenizer)
        digits = bpe.digits.__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for names, got in _encoded_slices(batches, bpe):
            yield pa.record_batch({"doc_id": names, "n_tokens": pa.array(list(map(len, got)), pa.int64()), "ids_sha256": pa.array([sha(" ".join(map(digits, x))) for x in got]), "decoded_sha256": pa.array([sha(bpe.decode(x)) for x in got])})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
