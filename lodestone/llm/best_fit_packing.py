"""Packing of documents into sequences of a fixed number of tokens.

Linear grouping: pieces longer than SMALL are sorted and cut into groups of equal cardinality, each rounded up to its
longest. Over these few sizes, configurations (which sizes share a sequence) are chosen, each the fullest that has the
longest size left, and used as often as the groups last. Actual pieces then take the places, and the small ones go,
longest first, where they leave least room. Sequences that rounding left loose are opened and packed again by their
exact lengths.

Pieces are dealt by hash into buckets of about BUCKET, each packed in one task, so a sequence more per bucket is the
price of any size of input. The hash takes the row's place in its partition too, so rows that repeat or have no doc_id
are dealt over all buckets. Null and empty texts are packed as their end id alone. Texts of any length are cut into full
pieces and a rest. Repeated rows are packed apart. Columns other than doc_id and text are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .textarrays import in_slices
from .tokens import piece_ids

CAPACITY, SMALL, GROUPS, BUCKET = 2048, 48, 320, 10_000


def _fullest(room: int, sizes: np.ndarray, counts: np.ndarray) -> dict[int, int]:
    """Which sizes, within their counts, fill room best: reachable sums, with the size that first reached each."""
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.full(room + 1, -1)
    for g in np.flatnonzero((counts > 0) & (sizes <= room)):
        s = int(sizes[g])
        for _ in range(min(int(counts[g]), room // s)):
            new = np.zeros(room + 1, bool)
            new[s:] = reached[:-s]
            new &= ~reached
            if not new.any():
                break
            reached |= new
            by[new] = g
        if reached[room]:
            break
    at, used = int(np.flatnonzero(reached)[-1]), {}
    while at:
        g = int(by[at])
        used[g] = used.get(g, 0) + 1
        at -= int(sizes[g])
    return used


def _best_fit(lengths: list[int], rooms: list[int], capacity: int) -> list[int]:
    """A bin for each length, in the order given: the one with the least room that is enough, else a new one."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(rooms):
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    out, bins = [], len(rooms)
    for n in lengths:
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            b, r = bins, capacity
            bins += 1
        out.append(b)
        left = r - n
        if left:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left
    return out


def pack(lengths: np.ndarray, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> np.ndarray:
    """The sequence (from 0) of each piece of 1 to capacity tokens."""
    order = np.argsort(-lengths, kind="stable")
    n_large = int((lengths > small).sum())
    large, few = order[:n_large], order[n_large:]
    bins: list[list[int]] = []
    if n_large:
        parts = np.array_split(large, min(groups, n_large))
        sizes = np.array([int(lengths[p[0]]) for p in parts])
        left = [list(p[::-1]) for p in parts]
        counts = np.array([len(p) for p in parts])
        g0 = 0
        while True:
            while g0 < len(parts) and not counts[g0]:
                g0 += 1
            if g0 == len(parts):
                break
            counts[g0] -= 1
            used = _fullest(capacity - int(sizes[g0]), sizes, counts)
            counts[g0] += 1
            used[g0] = used.get(g0, 0) + 1
            for _ in range(min(int(counts[g]) // k for g, k in used.items())):
                bins.append([left[g].pop() for g, k in used.items() for _ in range(k)])
                for g, k in used.items():
                    counts[g] -= k
    fill = lambda b: int(lengths[b].sum())
    rooms = [capacity - fill(b) for b in bins]
    for item, b in zip(few, _best_fit(lengths[few].tolist(), rooms, capacity), strict=True):
        if b == len(bins):
            bins.append([])
        bins[b].append(item)
    # open the sequences with room, and keep what takes fewer
    loose = [b for b in bins if fill(b) < capacity]
    items = np.array(sorted((i for b in loose for i in b), key=lambda i: (-lengths[i], i)), int)
    again = _best_fit(lengths[items].tolist(), [], capacity) if len(items) else []
    out = np.zeros(len(lengths), np.int64)
    kept = bins
    if len(items) and max(again) + 1 < len(loose):
        kept = [b for b in bins if fill(b) == capacity]
        out[items] = len(kept) + np.array(again)
    for k, b in enumerate(kept):
        out[b] = k
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""
    end = np.array([end_id], "<u4").tobytes()

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_ids(tokenizer)
        for whole in batches:
            for b in in_slices(whole, most=1 << 20):
                rows = []
                for name, got in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                    got += end
                    rows += [(name, k, k * capacity, len(x := got[4 * k * capacity : 4 * (k + 1) * capacity]) // 4, zlib.crc32(x)) for k in range(-(-len(got) // (4 * capacity)))]
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.record_batch({"doc_id": pa.array(c[0], pa.int64()), "piece": pa.array(c[1], pa.int32()), "start": pa.array(c[2], pa.int64()), "length": pa.array(c[3], pa.int64()), "ids_crc32": pa.array(c[4], pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """Every piece with its sequence and its place there."""
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    buckets = max(1, math.ceil((size["n"] + (size["b"] or 0) / 4 / capacity) / bucket))

    def fill(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        df["sequence_id"] = pack(df["length"].to_numpy(), capacity) * np.int64(buckets) + int(key[0])
        df = df.sort_values("sequence_id", kind="stable")
        df["offset"] = df.groupby("sequence_id")["length"].cumsum() - df["length"]
        return df[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    found = pieces(docs, tokenizer, end_id, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(buckets)))
    return found.groupBy("bucket").applyInPandas(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
