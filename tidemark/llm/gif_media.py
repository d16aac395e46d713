"""Media columns: GIF files with LZW code streams, palettes, disposal, transparency and timed frames."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import column, materialize, nonempty, settled

MAX_BITS = 12
WIDTH, FRAME_ROWS, DELAY_CS = 64, 1024, 10
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
#: Samples of all images of a file, and of its canvas, beyond which it is refused: headers may claim any size.
MOST_SAMPLES = 1 << 26
#: The palette index that stands for "as before" in files of samples that don't use it, as UTF-8 never does.
CLEAR = 255


def _widths(min_bits: int, n: int) -> np.ndarray:
    """Bits of the code that comes j codes after a clear code: the decoder's table then has 2**min_bits + 2 + max(0, j - 1) entries."""
    entries = (1 << min_bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, MAX_BITS)


_schedules: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(min_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the first codes after a clear code and the bits before each."""
    if min_bits not in _schedules:
        w = _widths(min_bits, 1 << MAX_BITS)
        _schedules[min_bits] = w, np.cumsum(w) - w
    return _schedules[min_bits]


def lzw_encode(samples: bytes, min_bits: int = 8) -> bytes:
    """The code stream of samples below 2**min_bits: greedy longest matches, a clear code when the table is full."""
    clear = 1 << min_bits
    full = 1 << MAX_BITS
    codes: list[int] = [clear]
    begins = [1]  # where the codes after each clear code begin
    emit = codes.append
    table: dict[int, int] = {}
    find = table.get
    following = clear + 2
    if samples:
        stream = iter(samples)
        prefix = next(stream)
        for sample in stream:
            key = prefix << 8 | sample
            longer = find(key)
            if longer is not None:
                prefix = longer
                continue
            emit(prefix)
            table[key] = following
            following += 1
            prefix = sample
            if following == full:
                emit(clear)
                begins.append(len(codes))
                table.clear()
                following = clear + 2
        emit(prefix)
    emit(clear + 1)
    code = np.array(codes, dtype=np.uint16)
    place = np.arange(len(code)) - np.repeat(begins, np.diff([*begins, len(code)], prepend=0)[1:] if begins[0] == 0 else np.diff([0, *begins[1:], len(code)]))
    place[0] = 0
    width = _schedule(min_bits)[0][place]
    bits = (code[:, None] >> np.arange(MAX_BITS, dtype=np.uint16)) & 1
    return np.packbits(bits.astype(np.uint8)[np.arange(MAX_BITS) < width[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, min_bits: int) -> bytes:
    """The samples of a code stream; it ends at the end code, at the end of data or at a code that no table can hold."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    widths, before = _schedule(min_bits)
    n_bits = len(stream) * 8
    raw = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    window = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, previous = base.copy(), b""
    out: list[bytes] = []
    bit, place = 0, 0
    while True:
        # Widths depend only on the number of codes since the last clear code, so a run up to the next one is read at once.
        if place < len(widths):
            at, w = bit + before[place:] - before[place], widths[place:]
        else:
            at, w = bit + np.arange(4096) * MAX_BITS, np.full(4096, MAX_BITS)
        inside = int(np.searchsorted(at + w, n_bits, side="right"))
        if not inside:
            break
        at, w = at[:inside], w[:inside]
        codes = window[at >> 3] >> (at & 7).astype(np.uint32) & ((1 << w) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        run = int(stops[0]) if len(stops) else inside
        size = len(table)
        for code in codes[:run].tolist():
            if code < size:
                entry = table[code]
            elif code == size and previous:
                entry = previous + previous[:1]
            else:
                return b"".join(out)
            out.append(entry)
            if previous and size < 4096:
                table.append(previous + entry[:1])
                size += 1
            previous = entry
        if len(stops):
            if codes[run] == end:
                break
            bit, place = int(at[run] + w[run]), 0
            table, previous = base.copy(), b""
        else:
            bit, place = int(at[-1] + w[-1]), place + run
    return b"".join(out)


@dataclass
class Frame:
    """One image of a file as stored: palette indices, before composition."""

    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay_cs: int
    disposal: int
    transparent: int | None


@dataclass
class Gif:
    width: int
    height: int
    loops: int | None
    frames: list[Frame]


def _palette(raw: bytes) -> np.ndarray:
    rgb = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.uint32)
    return rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def parse_gif(data: bytes, most: int = MOST_SAMPLES) -> Gif:
    """Reads the structure of a file and decodes its images; raises ValueError if it is no GIF, is cut off in a header, has codes
    of other than 2 to 11 bits at first or more than `most` samples. Images whose code stream ends early are filled up with 0."""
    try:
        return _parse(data, most)
    except (struct.error, IndexError) as short:
        raise ValueError("not a whole GIF file") from short


def _parse(data: bytes, most: int) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared, at = _palette(data[at : at + size]), at + size
    gif, delay, disposal, transparent = Gif(width, height, None, []), 0, 0, None
    held = width * height
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, following = _blocks(data, at + 2)
            if label == 0xF9:
                packed, delay = struct.unpack_from("<BH", body)
                disposal, transparent = packed >> 2 & 7, body[3] if packed & 1 else None
            elif label == 0xFF and body.startswith(b"NETSCAPE2.0") and len(body) >= 14:
                gif.loops = struct.unpack_from("<H", body, 12)[0]
            at = following
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if flags & 0x80:
                size = 3 << ((flags & 7) + 1)
                palette, at = _palette(data[at : at + size]), at + size
            min_bits = data[at]
            held += w * h
            if not 2 <= min_bits < MAX_BITS or held > most:
                raise ValueError("no sound image")
            body, at = _blocks(data, at + 1)
            samples = lzw_decode(body, min_bits)[: w * h].ljust(w * h, b"\0")
            indices = np.frombuffer(samples, dtype=np.uint8).reshape(h, w)
            if flags & 0x40:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                straight = np.empty_like(indices)
                straight[order] = indices
                indices = straight
            gif.frames.append(Frame(left, top, indices, palette if palette is not None else _palette(GREY), delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            at += 1
    return gif


def compose(gif: Gif) -> Iterator[np.ndarray]:
    """The canvas (0xRRGGBB) shown with each frame, by the disposal and transparency rules; the background is black."""
    canvas = np.zeros((gif.height, gif.width), dtype=np.uint32)
    for f in gif.frames:
        kept = canvas.copy() if f.disposal == 3 else None
        rows, cols = slice(f.top, f.top + f.indices.shape[0]), slice(f.left, f.left + f.indices.shape[1])
        part = f.indices[: max(0, gif.height - f.top), : max(0, gif.width - f.left)]
        colours = f.palette[np.minimum(part, len(f.palette) - 1)]
        if f.transparent is None:
            canvas[rows, cols] = colours
        else:
            canvas[rows, cols] = np.where(part == f.transparent, canvas[rows, cols], colours)
        yield canvas.copy() if f.disposal in (2, 3) else canvas
        if f.disposal == 2:
            canvas[rows, cols] = 0
        elif kept is not None:
            canvas = kept


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 4 x 4 x 4 cells of the RGB cube."""
    return np.bincount(((canvas >> 22 & 3) << 4 | (canvas >> 14 & 3) << 2 | canvas >> 6 & 3).ravel(), minlength=64)


def encode_gif(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS, palette: bytes = GREY) -> bytes:
    """A GIF89a file of 8-bit samples, row by row, width to a row and at most frame_rows rows to a frame.

    samples must fill whole rows. The last frame has the rows that are left; frames stay on the canvas (disposal 1). Where a frame
    shows what the one before has shown, it is transparent, if no sample is CLEAR.
    """
    if not samples or len(samples) % width:
        raise ValueError("samples must fill one row or more")
    height = min(frame_rows, len(samples) // width)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    frame = width * frame_rows
    clear = CLEAR not in samples
    shown = None
    for at in range(0, len(samples), frame):
        own = samples[at : at + frame]
        stored = own
        if clear and len(samples) > frame:
            now = np.frombuffer(own, dtype=np.uint8)
            if shown is not None:
                stored = np.where(now == shown[: len(now)], np.uint8(CLEAR), now).tobytes()
            shown = now
        control = struct.pack("<BHB", 1 << 2 | (stored is not own), delay_cs, CLEAR if stored is not own else 0)
        parts.append(b"\x21\xf9\x04" + control + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(own) // width, 0) + b"\x08")
        stream = lzw_encode(stored)
        parts += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes and media: each whole text (null: empty) as UTF-8, filled up with bytes 0 to a positive multiple of unit, as GIF.

    Narrow; equal texts give equal files. A file has one frame for each 64 x 1024 samples, so its size follows the text's.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            texts, at = column(batch, "text"), 0
            while at < len(texts):  # a few MB at once
                media, sizes, first, held = [], [], at, 0
                while at < len(texts) and held < 4 << 20:
                    raw = (texts[at] or "").encode("utf-8", "surrogatepass")
                    media.append(encode_gif(raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0"), width=unit))
                    sizes.append(len(raw))
                    held, at = held + len(raw), at + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(media)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(settled(encode), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", most: int = MOST_SAMPLES) -> DataFrame:
    """The timed frames of each file: id_col, frame (from 0), start_cs, delay_cs, width, height, histogram (64 colour cells) of the shown canvas.

    Null media, media that are no sound GIF and files of more than `most` samples give no rows. Other columns play no part. Narrow.
    """

    def frames(key: object, raw: bytes | None) -> list[tuple]:
        try:
            gif = parse_gif(raw or b"", most)
            shown = [colour_histogram(canvas).tolist() for canvas in compose(gif)]
        except (ValueError, IndexError):
            return []
        ends = np.cumsum([f.delay_cs for f in gif.frames]).tolist()
        return [(key, i, end - f.delay_cs, f.delay_cs, gif.width, gif.height, h) for i, (f, end, h) in enumerate(zip(gif.frames, ends, shown, strict=True))]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            for key, raw in zip(range(batch.num_rows), batch.column(1), strict=True):
                if rows := frames(key, raw.as_py()):
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(cols[0]), *cols[1:]], names)

    source = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    names = ["id", "frame", "start_cs", "delay_cs", "width", "height", "histogram"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    decoded = source.mapInArrow(settled(decode), f"id {source.schema['id'].dataType.simpleString()}, frame int, start_cs long, delay_cs int, width int, height int, histogram array<long>")
    return decoded.withColumnRenamed("id", id_col)


def media_digest(media: DataFrame) -> DataFrame:
    """Reads stored files back: payload size and digests, the file's size and digest, its features as a string and its timed frames.

    feature: JSON of the number of frames, the playing time and the colour histogram summed over frames. frames: an array of
    (start_cs, delay_cs, histogram of the 64 colour cells of the shown canvas). The payload is what the frames show, so palettes,
    disposal and transparency count. Null media give nulls; media that are no file of encode_gif fail. Narrow.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            rows, frames = [], []
            for raw in column(batch, "media"):
                if raw is None:
                    rows.append((None,) * 6)
                    frames.append(None)
                    continue
                gif = parse_gif(raw)
                payload, shown = [], []
                for f, canvas in zip(gif.frames, compose(gif), strict=True):
                    payload.append(canvas[: f.indices.shape[0]].astype(np.uint8).tobytes())
                    shown.append(colour_histogram(canvas))
                payload, seen = b"".join(payload), sum(shown)
                delays = np.array([f.delay_cs for f in gif.frames])
                feature = json.dumps({"frames": len(gif.frames), "time_cs": int(delays.sum()), "histogram": seen[seen > 0].tolist(), "cells": np.flatnonzero(seen).tolist()})
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
                frames.append([{"start_cs": a, "delay_cs": d, "histogram": h.tolist()} for a, d, h in zip((np.cumsum(delays) - delays).tolist(), delays.tolist(), shown, strict=True)])
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, pa.array(frames, timed)], ["doc_id", "n_bytes", *names, "frames"])

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    timed = pa.list_(pa.struct([("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("histogram", pa.list_(pa.int64()))]))
    source = media.select("doc_id", "n_bytes", "media")
    return source.mapInArrow(
        settled(digest),
        f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "frames array<struct<start_cs: long, delay_cs: int, histogram: array<long>>>",
    )


def text_media_roundtrip(docs: DataFrame, **options) -> DataFrame:
    """Stores every text as GIF in the shared folder and returns the digest of what is read back. No shuffle."""
    return media_digest(materialize(text_media(docs, **options), "gif", compression="uncompressed"))
