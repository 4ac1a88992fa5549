"""Ids of whole texts from a public tokenizer, taken white-space piece by piece.

The tokenizer drops white space and never looks across it, so a text's ids are those of its pieces end to end. Each
Python worker keeps the ids of the pieces and words it met last, up to twice KEPT of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

KEPT = 400_000
_ODD_CHARACTERS = "\x1c\x1d\x1e\x1f"  # str.split() cuts at these, the tokenizer does not

# The pre-tokenizer's pattern of the public file, and what it is over lower-case Latin-1 without spaces.
CLIP_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")
BEYOND_LATIN = re.compile("[^\x00-\xff]")


def byte_characters() -> list[str]:
    """The printable character for each byte: itself where printable, else those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


BYTE_CHARACTERS = dict(enumerate(byte_characters()))
chr_of_byte = byte_characters().__getitem__


@lru_cache(1)
def _four_bytes() -> list[bytes]:
    return [i.to_bytes(4, "little") for i in range(1 << 17)]


def _packed(ids: list[int]) -> bytes:
    known = _four_bytes()
    if len(ids) == 1 and ids[0] < len(known):
        return known[ids[0]]
    return b"".join([known[i] if i < len(known) else i.to_bytes(4, "little") for i in ids])


@lru_cache(4)
def library_tokenizer(name: str):
    """A tokenizers.Tokenizer from a file name or path; found in each worker by itself."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    t = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def splits_at_space(name: str) -> bool:
    """Whether ids depend on nothing across white space, as with a pre-tokenizer that drops it."""
    t = library_tokenizer(name)
    ids = lambda s: t.encode(s, add_special_tokens=False).ids
    return all(ids(f"{a}{s}{b}") == ids(a) + ids(b) for a in ("Ab", "1", "é,") for b in ("cd", "'s", "2") for s in (" ", "\n", "\t  ", " "))


class PieceIds:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str):
        self.tokenizer, self.by_piece = library_tokenizer(name), splits_at_space(name)
        self.model = self.tokenizer.model  # a new wrapper each time it is asked for
        self.by_word = self.by_piece and CLIP_PATTERN in [str(p) for p in _patterns(self.tokenizer)]
        self.known = Learning(self._learned)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 1000):
            out += [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
        return out

    def _word(self, word: str) -> bytes:
        """A word that normalization and pre-tokenization leave whole goes to the library's model as they would give it."""
        if not word.isascii():
            word = "".join(map(chr_of_byte, word.encode()))
        elif not word.isalnum():
            word = word.translate(BYTE_CHARACTERS)
        tokens = self.model.tokenize(word)
        return _packed([t.id for t in tokens])

    def _learned(self, piece: str) -> bytes:
        """The ids of a piece met for the first time. A word alone has the ids that it has within a piece."""
        if not self.by_word or "<|" in piece or not piece.isascii() and BEYOND_LATIN.search(piece):
            return self._encoded([piece])[0]
        low = piece.lower()
        if low.isalpha():
            return self._word(low) if low == piece else self.known[low]
        words = LATIN_WORDS.findall(low)
        return self._word(low) if len(words) == 1 else b"".join(map(self.known.__getitem__, words))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._encoded(texts)
        self.known = self.known.aged(KEPT)
        get = self.known.__getitem__
        return [b"".join(map(get, t.split())) if not any(c in t for c in _ODD_CHARACTERS) else self._encoded([t])[0] for t in texts]


class Recent(dict):
    """A cache of two ages: once it is full, it becomes the older one of a new one, and what was older goes."""

    older: dict = {}

    def aged(self, most: int) -> "Recent":
        if len(self) <= most:
            return self
        new = self.fresh()
        new.older, self.older = self, {}
        return new

    def fresh(self) -> "Recent":
        return Recent()


class Learning(Recent):
    """Such a cache that asks for what it does not have, and keeps the answer."""

    def __init__(self, learned: Callable[[str], bytes]):
        self.learned = learned

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key) if self.older else None
        if value is None:
            value = self.learned(key)
        self[key] = value
        return value

    def fresh(self) -> "Learning":
        return Learning(self.learned)


def _patterns(tokenizer) -> list[str]:
    import json

    def walk(x):
        if isinstance(x, dict):
            if isinstance(x.get("Regex"), str):
                yield x["Regex"]
            x = list(x.values())
        if isinstance(x, list):
            for y in x:
                yield from walk(y)

    spec = json.loads(tokenizer.to_str())
    same = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    return list(walk(spec["pre_tokenizer"])) if same else []


@lru_cache(4)
def piece_ids(name: str) -> PieceIds:
    return PieceIds(name)
