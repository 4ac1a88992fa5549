"""GIF media columns: encode samples, decode LZW streams, compose timed frames, and describe them by colour.

A text's samples are its UTF-8 bytes and spaces up to a positive multiple of 192, as rows of 192 palette indices, at
most 64 rows a frame. Null texts are empty ones, so equal texts (and null and "") have equal media. Very long texts have
more frames; a frame's size is bounded. ``with_media`` makes the GIFs, ``decoded`` reads their bytes: every frame with its
time and colour histogram as a nested column, and digests of the samples. For null, empty or damaged bytes ``decoded``
has the frames before the damage, null digests and the reason in ``error``; ``frames`` gives the same as a row for each
frame, and one row with the error. Columns of the input other than the named ones are not read, whatever their names.
Rows that repeat are encoded alike; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .textarrays import in_slices

WIDTH, ROWS, DELAY = 192, 64, 10
_GREY = bytes(x for v in range(256) for x in (v, v, v))


def _widths(first: int, n: int, base: int) -> np.ndarray:
    """Bits of codes first.. after a clear code; base is the first free code then."""
    free = np.minimum(base - 1 + np.arange(first, first + n), 4095)
    return np.maximum(np.frexp(free.astype(float))[1], int(base - 2).bit_length()).astype(np.int64)


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """An LZW code stream of samples below 2**size, cleared whenever the table is full."""
    clear, base = 1 << size, (1 << size) + 2
    parts, widths = [np.array([clear])], [np.array([size + 1])]
    table: dict[int, int] = {}
    codes: list[int] = []
    free, full = base, 4096
    add = codes.append
    prefix = samples[0] if samples else None
    for c in samples[1:]:
        key = prefix << 8 | c
        known = table.get(key)
        if known is not None:
            prefix = known
            continue
        add(prefix)
        prefix = c
        if free < full:
            table[key] = free
            free += 1
        else:
            add(clear)
            parts.append(np.array(codes))
            widths.append(_widths(0, len(codes), base))
            codes.clear()
            table.clear()
            free = base
    if prefix is not None:
        add(prefix)
    add(clear + 1)
    parts.append(np.array(codes))
    widths.append(_widths(0, len(codes), base))
    code, width = np.concatenate(parts), np.concatenate(widths)
    bits = (code[:, None] >> np.arange(12)) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """At most `most` samples of an LZW code stream. Codes between two clear codes are cut out at once: their widths
    depend on their places alone. A table string is a piece of the output already there."""
    clear, base = 1 << size, (1 << size) + 2
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, out, ended = len(stream) * 8, 0, bytearray(), False
    while not ended and len(out) < most:
        begin: list[int] = []
        length: list[int] = []
        m, run = 0, True
        while run:
            width = _widths(m, 4096, base)
            place = at + np.cumsum(width) - width
            width, place = width[place + width <= bits], place[place + width <= bits]
            if not len(place):
                ended = True
                break
            byte = place >> 3
            code = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7)) & ((1 << width) - 1)
            stops = np.flatnonzero((code == clear) | (code == clear + 1))
            stop = int(stops[0]) if len(stops) else len(code)
            for c in code[:stop].tolist():
                here = len(out)
                if c < clear:
                    out.append(c)
                    length.append(1)
                else:
                    j = c - base
                    if j >= m:
                        raise ValueError("a code that is not in the table yet")
                    source, n = begin[j], length[j]
                    if j == m - 1:
                        out += out[source:here]
                        out.append(out[source])
                    else:
                        out += out[source : source + n + 1]
                    length.append(n + 1)
                begin.append(here)
                m += 1
            if len(stops):
                at = int(place[stop] + width[stop])
                ended, run = bool(code[stop] == clear + 1), False
            else:
                at = int(place[-1] + width[-1])
                run = len(out) < most
    return bytes(out[:most])


def gif_of(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A grey GIF whose frames hold the samples, a multiple of width, in order."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, len(samples) // width), 0xF7, 0, 0), _GREY]
    for at in range(0, len(samples), width * rows):
        part = samples[at : at + width * rows]
        code = lzw_encode(part)
        out += [b"\x21\xf9\x04\x04", struct.pack("<HB", delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08"]
        out += [bytes([len(code[k : k + 255])]) + code[k : k + 255] for k in range(0, len(code), 255)] + [b"\0"]
    return b"".join([*out, b"\x3b"])


def _blocks(gif: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := gif[at]:
        parts.append(gif[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def gif_frames(gif: bytes) -> Iterator[dict]:
    """Each frame: indices (its own samples, rows in order), canvas (height x width x RGBA after drawing it) and delay.

    A frame is drawn over what the one before left: disposal 2 clears that one's area, 3 brings back what it covered.
    """
    try:
        if gif[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF")
        wide, high, flags, _, _ = struct.unpack("<HHBBB", gif[6:13])
        at, palette = 13, None
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            palette, at = np.frombuffer(gif, np.uint8, n, at).reshape(-1, 3), at + n
        canvas = np.zeros((high, wide, 4), np.uint8)
        delay, clear_to, disposal, undo = 0, None, 0, None
        while (kind := gif[at]) != 0x3B:
            if kind == 0x21:
                label = gif[at + 1]
                data, at = _blocks(gif, at + 2)
                if label == 0xF9 and len(data) >= 4:
                    disposal, delay = data[0] >> 2 & 7, data[1] | data[2] << 8
                    clear_to = data[3] if data[0] & 1 else None
                continue
            if kind != 0x2C:
                raise ValueError("an unknown block")
            x, y, w, h, flags = struct.unpack("<HHHHB", gif[at + 1 : at + 10])
            at += 10
            local = palette
            if flags & 0x80:
                n = 3 << ((flags & 7) + 1)
                local, at = np.frombuffer(gif, np.uint8, n, at).reshape(-1, 3), at + n
            if local is None:
                raise ValueError("no palette")
            if not 1 < gif[at] < 12:
                raise ValueError("a wrong code size")
            size = gif[at]
            stream, at = _blocks(gif, at + 1)
            got = lzw_decode(stream, size, w * h)
            if len(got) < w * h:
                raise ValueError("too few samples")
            indices = np.frombuffer(got, np.uint8).reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                indices = indices[np.argsort(order)]
            if undo is not None:
                (a, b, c, d), what = undo
                canvas[b:d, a:c] = what
            area = (x, y, min(x + w, wide), min(y + h, high))
            part = canvas[area[1] : area[3], area[0] : area[2]]
            undo = (area, np.zeros_like(part)) if disposal == 2 else (area, part.copy()) if disposal == 3 else None
            shown = indices[: part.shape[0], : part.shape[1]]
            if int(shown.max(initial=0)) >= len(local):
                raise ValueError("a sample beyond the palette")
            draw = shown != clear_to if clear_to is not None else np.ones(shown.shape, bool)
            part[draw] = np.concatenate([local[shown[draw]], np.full((int(draw.sum()), 1), 255, np.uint8)], 1)
            yield {"indices": indices, "canvas": canvas.copy(), "delay": delay, "width": w, "height": h}
            delay, clear_to, disposal = 0, None, 0
    except (IndexError, struct.error) as e:
        raise ValueError("the data end early") from e


def colour_histogram(canvas: np.ndarray, levels: int = 4) -> np.ndarray:
    """Opaque pixels in each cell of a levels x levels x levels cube."""
    seen = canvas.reshape(-1, canvas.shape[-1])
    if not (opaque := seen[:, 3] > 0).all():
        seen = seen[opaque]
    cell = (np.arange(256) * levels // 256).astype(np.int32)
    return np.bincount((cell[seen[:, 0]] * levels + cell[seen[:, 1]]) * levels + cell[seen[:, 2]], minlength=levels**3)


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's bytes as a GIF."""

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in in_slices(whole):
                texts = [(t or "").encode() for t in b.column(1).to_pylist()]
                media = [gif_of(t + b" " * (-len(t) % WIDTH or (0 if t else WIDTH))) for t in texts]
                yield pa.record_batch({"doc_id": b.column(0), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


FRAME = "struct<frame:int,start_cs:int,delay_cs:int,width:int,height:int,colours:array<int>>"


def decoded(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns in keep and what the bytes in media hold: timed frames with colour histograms, their number, length
    and digests of the samples and of the bytes, and an error."""
    names = [f"_k{k}" for k in range(len(keep))]
    kinds = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keep, strict=True))

    @lean
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("frame", pa.int32()), ("start_cs", pa.int32()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("colours", pa.list_(pa.int32()))])
        for b in batches:
            rows, times, colours, bounds = [], [], [], [0]
            for gif in b.column(len(names)).to_pylist():
                samples, clock, n, error = [], 0, 0, None
                try:
                    for f in gif_frames(gif or b""):
                        samples.append(f["indices"].tobytes())
                        colours.append(colour_histogram(f["canvas"]))
                        times.append((n, clock, f["delay"], f["width"], f["height"]))
                        clock, n = clock + f["delay"], n + 1
                except ValueError as e:
                    error = str(e)
                bounds.append(len(times))
                payload = None if error else b"".join(samples)
                rows.append((n, clock, None, None, None, None, None, error) if error else (n, clock, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), None))
            if not rows:
                continue
            each = list(zip(*times, strict=True)) or [()] * 5
            cells = np.concatenate(colours).astype(np.int32) if colours else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(colours) + 1, dtype=np.int32) * 64), pa.array(cells))
            found = pa.StructArray.from_arrays([*(pa.array(c, pa.int32()) for c in each), lists], fields=list(kind))
            columns = {n: b.column(k) for k, n in enumerate(names)} | {"frames": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)}
            kinds = (("n_frames", pa.int32()), ("length_cs", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string()))
            yield pa.record_batch(columns | {name: pa.array(c, t) for (name, t), c in zip(kinds, zip(*rows, strict=True), strict=True)})

    read = df.select(*[F.col(k).alias(n) for n, k in zip(names, keep, strict=True)], F.col(media).alias("_media"))
    got = read.mapInArrow(decode, f"{kinds}, frames array<{FRAME}>, n_frames int, length_cs int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string")
    return got.select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)], *got.columns[len(names) :])


def frames(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each frame of each GIF, in order, with its time and colours."""
    got = decoded(df, media, (key,))
    last = F.struct(F.col("n_frames").alias("frame"), F.col("length_cs").alias("start_cs"), F.lit(None).cast("int").alias("delay_cs"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("array<int>").alias("colours"))
    rows = F.when(F.col("error").isNull(), F.col("frames")).otherwise(F.concat("frames", F.array(last)))
    out = got.select(key, "error", F.explode(rows).alias("f"))
    return out.select(key, "f.*", F.when(F.col("f.colours").isNull(), F.col("error")).alias("error"))


def media_digests(df: DataFrame) -> DataFrame:
    """What the stored media hold, read back from them: digests of the samples, and a feature string from the frames'
    times and colours; with the reason in error, and null digests, for what is no GIF."""
    pixels = lambda cell: F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + F.get(f["colours"], F.lit(cell)))
    greys = [pixels(v * 21).cast("string") for v in range(4)]
    feature = F.concat(F.lit("frames="), F.col("n_frames").cast("string"), F.lit(";cs="), F.col("length_cs").cast("string"), F.lit(";grey="), F.concat_ws("-", *greys))
    return decoded(df).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.when(F.col("error").isNull(), feature).alias("feature"), "error")
