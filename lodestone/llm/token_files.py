"""Token ids in bit-packed blocks: every id takes as many bits as the vocabulary needs.

A file is a Parquet table in ascending document order, one row a block: ``part`` (the sorted range it belongs to) and
``block`` in it, ``first`` (ids of the part before it), the documents that it holds whole (``doc_ids``, ``starts``:
where each begins in the block, and the end), ``bits`` and ``payload``. Id k of a block is at bit k * bits, least
significant first, so any id or document can be unpacked alone. A block is closed once it has BLOCK ids; a longer
document has a block of its own.

Null texts are empty ones and hold the end id alone. Rows whose doc_id is null come first; rows of one id stay apart, in
the order of a hash of their texts and of their places, so however many they are they fill more than one range. Columns other than doc_id and text are not read. An empty table gives files without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discarded, lean, staged
from .textarrays import in_slices
from .tokens import library_tokenizer, piece_ids

BLOCK = 1 << 14
BLOCKS = "part int, block int, first long, bits int, doc_ids array<long>, starts array<int>, payload binary"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a block, without touching the others."""
    low = start * bits // 8
    raw = np.frombuffer(payload, np.uint8)[low : -(-stop * bits // 8)]
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype(np.uint32)
    flat = np.unpackbits(raw, bitorder="little")[start * bits - low * 8 :][: (stop - start) * bits].reshape(-1, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The blocks of all documents, written to the shared folder and read again. Texts are encoded where they lie; what is
    sorted are their ids."""
    bits = max(1, int(max(library_tokenizer(tokenizer).get_vocab_size(True) - 1, end_id)).bit_length())
    kind = "<u2" if bits <= 16 else "<u4"
    end = np.array([end_id], kind).tobytes()

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = piece_ids(tokenizer)
        for whole in batches:
            for b in in_slices(whole, most=1 << 20):
                ids = [np.frombuffer(got, "<u4").astype(kind).tobytes() + end for got in of([t or "" for t in b.column(3).to_pylist()])]
                yield pa.record_batch([*b.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "text_hash", "place", "ids"])

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def closed() -> pa.RecordBatch:
            nonlocal block, first
            starts = np.concatenate([[0], np.cumsum([len(x) // np.dtype(kind).itemsize for x in ids])])
            row = pa.record_batch({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "first": pa.array([first], pa.int64()), "bits": pa.array([bits], pa.int32()), "doc_ids": pa.array([names], pa.list_(pa.int64())), "starts": pa.array([starts.tolist()], pa.list_(pa.int32())), "payload": pa.array([pack_bits(np.frombuffer(b"".join(ids), kind), bits)], pa.binary())})
            block, first = block + 1, first + int(starts[-1])
            return row

        size = 0
        for b in batches:
            for name, got in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = got.as_py()
                n = len(raw) // np.dtype(kind).itemsize
                if ids and size + n > BLOCK:
                    yield closed()
                    ids, names, size = [], [], 0
                ids.append(raw)
                names.append(name)
                size += n
        if ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.monotonically_increasing_id().alias("place"), "text")
    encoded = staged(rows.mapInArrow(encode, "doc_id long, text_hash long, place long, ids binary"), "token-ids")
    # rows of one id, or of one id and text, are spread over ranges too
    out = staged(encoded.orderBy("doc_id", "text_hash", "place").select("doc_id", "ids").mapInArrow(pack, BLOCKS), "token-blocks")
    discarded(encoded)
    return out


def document_digests(blocks: DataFrame) -> DataFrame:
    """From the files: where each document's ids begin among all, how many they are, and their checksum."""
    # one row for each sorted range, as many as there are partitions
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum(F.element_at("starts", -1).cast("long")).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(totals):
        before[part], total = total, total + totals[part]

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, bits, names, starts, payload in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                ids = unpack_bits(payload, bits, 0, starts[-1]).astype("<u4").tobytes()
                at = np.array(starts, np.int64)
                yield pa.record_batch({"doc_id": pa.array(names, pa.int64()), "start": pa.array(before[part] + first + at[:-1]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array([zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts, starts[1:], strict=False)], pa.int64())})

    return blocks.select("part", "first", "bits", "doc_ids", "starts", "payload").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
