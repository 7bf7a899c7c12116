"""Media columns: payloads as AVI motion-JPEG (lossless intra frames), read back through the RIFF index, cut into shots.

A frame is 64 x 48 grey samples in a lossless Huffman JPEG (SOF3, predictor 1). Its code table gives difference
category s a code of 9 - s bits, so every sample takes exactly nine bits; the table is a legal JPEG one (the all-ones
code stays free) and lets whole batches of frames be coded and decoded as array operations.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import baseline_jpeg
from .common import prepare

WIDTH, HEIGHT, FPS = 64, 48, 10
FRAME = WIDTH * HEIGHT
UNIT = 192
PAD = 32
_BATCH = 4 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit field of each difference (index + 255), and the difference of each field (-512: no such field)."""
    field, back = np.zeros(511, np.uint16), np.full(512, -512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2
        field[d + 255] = code << s | (d if d > 0 else d + (1 << s) - 1)
        back[field[d + 255]] = d
    return field, back


_FIELD, _DIFF = _tables()
_DHT = b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
_HEAD = (
    b"\xff\xd8\xff\xc4" + struct.pack(">H", 2 + len(_DHT)) + _DHT
    + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG image of each (HEIGHT, WIDTH) array of bytes."""
    x = samples.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d += 255
    f = _FIELD[d].reshape(-1, 8)
    out = np.empty((len(f), 9), np.uint8)
    out[:, 0] = f[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (f[:, k - 1] << (8 - k)) & 255 | f[:, k] >> (k + 1)
    out[:, 8] = f[:, 7] & 255
    size, data = FRAME * 9 // 8, out.tobytes()
    return [_HEAD + data[k : k + size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for k in range(0, len(data), size)]


def _segments(jpeg: bytes) -> tuple[tuple[int, int], dict[int, bytes], int, bytes]:
    """((height, width), code tables by number, table in use, entropy-coded bytes) of a lossless image of one component."""
    if jpeg[:2] != b"\xff\xd8" or jpeg[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG image")
    at, shape, tables = 2, None, {}
    while True:
        mark, size = struct.unpack_from(">HH", jpeg, at)
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xFFC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[:n], body[n:]
        elif mark == 0xFFC3:
            precision, height, width, components = struct.unpack_from(">BHHB", body)
            if (precision, components) != (8, 1):
                raise ValueError("only 8-bit images of one component")
            shape = height, width
        elif 0xFFC0 <= mark <= 0xFFCF:
            raise ValueError("only lossless Huffman images (SOF3)")
        elif mark == 0xFFDA:
            if shape is None or body[0] != 1 or body[3:6] != b"\x01\x00\x00":
                raise ValueError("only one scan of predictor 1")
            return shape, tables, body[2] >> 4, jpeg[at:-2].replace(b"\xff\x00", b"\xff")


def _codes(table: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> difference category, by the canonical rule of a DHT segment."""
    out, code, at = {}, 0, 17
    for length in range(1, 17):
        for _ in range(table[length]):
            out[length, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _read_bits(data: bytes, table: bytes, count: int) -> np.ndarray:
    """``count`` differences by any code table, bit by bit."""
    codes, out, at = _codes(table), np.empty(count, np.int32), 0
    bits = "".join(f"{b:08b}" for b in data)
    for k in range(count):
        length = 1
        while (size := codes.get((length, int(bits[at : at + length], 2)))) is None:
            length += 1
            if length > 16 or at + length > len(bits):
                raise ValueError("no such code")
        at += length
        value = int(bits[at : at + size] or "0", 2)
        at += size
        out[k] = value if not size or value >> (size - 1) else value - (1 << size) + 1
    return out


def _summed(d: np.ndarray) -> np.ndarray:
    """Samples of (images, height, width) differences: predictor 1, the first column from above."""
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


def _baseline(jpeg: bytes) -> bool:
    """Whether an image's frame header is a baseline one."""
    at = 2
    while at + 4 <= len(jpeg):
        mark, size = struct.unpack_from(">HH", jpeg, at)
        if 0xFFC0 <= mark <= 0xFFCF and mark not in (0xFFC4, 0xFFC8, 0xFFCC):
            return mark in (0xFFC0, 0xFFC1)
        at += 2 + size
    return False


def decode_image(jpeg: bytes) -> np.ndarray:
    """(height, width) samples of a baseline image (its first component), or of any lossless one of one component and predictor 1, whatever its size and code table."""
    if _baseline(jpeg):
        return baseline_jpeg.decode(jpeg)
    (height, width), tables, used, data = _segments(jpeg)
    return _summed(_read_bits(data, tables[used], height * width).reshape(1, height, width))[0]


def decode_frames(images: list[bytes]) -> np.ndarray:
    """(frames, HEIGHT, WIDTH) samples; images with the nine-bit code are read as one array, others bit by bit."""
    parts = [_segments(x) for x in images]
    if any(shape != (HEIGHT, WIDTH) for shape, *_ in parts):
        raise ValueError("frames of one file have one size")
    even = np.array([tables[used] == _DHT and len(data) == FRAME * 9 // 8 for _, tables, used, data in parts], bool)
    out = np.empty((len(images), HEIGHT, WIDTH), np.uint8)
    b = np.frombuffer(b"".join(data for (*_, data), e in zip(parts, even, strict=True) if e), np.uint8).reshape(-1, 9).astype(np.uint16)
    f = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        f[:, k] = (b[:, k] & ((1 << (8 - k)) - 1)) << (k + 1) | b[:, k + 1] >> (7 - k)
    out[even] = _summed(_DIFF[f].reshape(-1, HEIGHT, WIDTH))
    for k in np.flatnonzero(~even).tolist():
        out[k] = decode_image(images[k])
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(images: list[bytes], payload_bytes: int) -> bytes:
    most = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(images), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(images), most, 0, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\x00" % payload_bytes))
    at, index, movi = 4, [], [b"movi"]
    for x in images:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        movi.append(c := _chunk(b"00dc", x))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> tuple[list[bytes], int]:
    """Images in index order, and the payload's bytes; they are found through ``idx1``, not by scanning ``movi``."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, payload, todo = 0, b"", 0, [(12, 8 + struct.unpack_from("<I", media, 4)[0])]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", media, at)
            kind = media[at + 8 : at + 12] if name == b"LIST" else b""
            if kind == b"movi":
                movi = at + 8
            elif kind == b"INFO":
                todo.append((at + 12, at + 8 + size))
            elif name == b"ICMT":
                payload = int(media[at + 8 : at + 8 + size].rstrip(b"\x00").partition(b"=")[2])
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    return [media[movi + o + 8 : movi + o + 8 + n] for _, _, o, n in struct.iter_unpack("<4sIII", index)], payload


def shots(frames: np.ndarray, reach: int = 4, factor: float = 3.0, floor: float = 0.05) -> list[tuple[int, int]]:
    """(first, end) frame of each shot.

    A cut stands before a frame whose grey histogram (16 bins) differs from the last one's by more than ``floor`` and
    by more than mean + ``factor`` deviations of the differences up to ``reach`` frames around it.
    """
    n = len(frames)
    if n < 2:
        return [(0, n)]
    bins = (np.arange(n)[:, None] * 16 + (frames.reshape(n, -1) >> 4)).ravel()
    hist = np.bincount(bins, minlength=16 * n).reshape(n, 16)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * frames[0].size)
    cuts = [0]
    for k, x in enumerate(diff):
        near = np.concatenate([diff[max(0, k - reach) : k], diff[k + 1 : k + 1 + reach]])
        if x > floor and x > (near.mean() + factor * near.std() if len(near) else 0):
            cuts.append(k + 1)
    return list(zip(cuts, [*cuts[1:], n], strict=True))


class Clip(NamedTuple):
    clip: int
    start_ms: int
    end_ms: int
    first_frame: int
    frames: int


def timed(cut: list[tuple[int, int]], frame_us: int = 1_000_000 // FPS) -> list[Clip]:
    """The clip of each shot, of frames of ``frame_us`` microseconds."""
    return [Clip(k, a * frame_us // 1000, b * frame_us // 1000, a, b - a) for k, (a, b) in enumerate(cut)]


def foreign_clips(media: bytes) -> list[Clip]:
    """Clips of any motion-JPEG AVI file of baseline or lossless frames: images through its index, timed by its header."""
    images = [x for x in read_avi(media)[0] if x]  # an empty chunk repeats the frame before it
    at = media.find(b"avih")
    frame_us = (struct.unpack_from("<I", media, at + 8)[0] if at >= 0 else 0) or 1_000_000 // FPS
    own = images and all(x.startswith(_HEAD) for x in images)
    frames = list(decode_frames(images)) if own else [decode_image(x) for x in images]
    if len({f.shape for f in frames}) > 1:
        raise ValueError("frames of one file have one size")
    return timed(shots(np.array(frames)), frame_us) if frames else []


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def _slices(values: list, weight) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, v in enumerate(values):
        if total and total + weight(v) > _BATCH:
            yield start, k
            start, total = k, 0
        total += weight(v)
    if start < len(values):
        yield start, len(values)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in _slices(texts, lambda t: 4 * len(t or "")):
            pays = [payload_of(t) for t in texts[a:b]]
            counts = [-(-len(p) // FRAME) for p, _ in pays]
            images = encode_frames(np.frombuffer(b"".join(p.ljust(n * FRAME, bytes([PAD])) for (p, _), n in zip(pays, counts, strict=True)), np.uint8))
            media, at = [], 0
            for (p, _), n in zip(pays, counts, strict=True):
                media.append(write_avi(images[at : at + n], len(p)))
                at += n
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([n for _, n in pays], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8 bytes of the text), ``media`` (its AVI file); null text counts as empty.

    The payload is the text with spaces up to a positive multiple of 192 bytes; the last frame is filled with spaces
    and the payload's length stands in the file's INFO list. One output row per input row, also for repeated rows and
    null ids; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col]).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _decoded(media: list[bytes]) -> Iterator[tuple[bytes, bytes, list[tuple[int, int]], int]]:
    for a, b in _slices(media, len):
        files = [read_avi(m) for m in media[a:b]]
        frames, at = decode_frames([x for images, _ in files for x in images]), 0
        for m, (images, size) in zip(media[a:b], files, strict=True):
            own = frames[at : at + len(images)]
            at += len(images)
            yield m, own.tobytes()[:size], shots(own), len(images)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for m, pay, cut, n in _decoded(batch.column(2).to_pylist()):
            feature = f"frames={n};fps={FPS};clips_ms=" + ",".join(f"{c.start_ms}-{c.end_ms}" for c in timed(cut))
            rows.append((len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(media: DataFrame) -> DataFrame:
    """Digests of what :func:`store_media` stored, read back from ``media``, and its timed clips as one string; a row per row, also for repeats and null ids.

    An empty table gives an empty result; further columns of ``media`` are not read.
    """
    prepare(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, *c) for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if m is not None for c in foreign_clips(m)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", *Clip._fields])


def clip_rows(media: DataFrame) -> DataFrame:
    """One timed row per shot: ``doc_id``, ``clip``, ``start_ms``, ``end_ms``, ``first_frame``, ``frames``.

    ``media``: doc_id and files of :func:`store_media` or any motion-JPEG AVI of baseline or lossless frames of whatever
    size and rate. A null file and one without frames have no clips; rows that repeat an id have theirs each; an empty
    table gives no rows; further columns are not read. A broken file raises.
    """
    prepare(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_clips, "doc_id long, clip long, start_ms long, end_ms long, first_frame long, frames long")
