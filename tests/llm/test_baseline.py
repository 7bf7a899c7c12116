"""Baseline images against streams made by hand: cosine transforms, Huffman codes and markers written out here."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import baseline_jpeg, mjpeg_avi

#: A code of eight bits for every symbol but one (the all-ones code stays free).
SYMBOLS = [run << 4 | size for run in range(16) for size in range(11)] + list(range(11, 12))
LENGTHS = bytes([0] * 7 + [min(255, len(SYMBOLS))] + [0] * 8)
CODE = {s: f"{k:08b}" for k, s in enumerate(SYMBOLS)}


def bits_of(value):
    size = abs(value).bit_length()
    return size, f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""


def coded(block, quant, last):
    """Bits of an 8 x 8 block of samples, its first coefficient, and the samples that a decoder should find."""
    raw = np.rint(baseline_jpeg.BASIS @ (block - 128.0) @ baseline_jpeg.BASIS.T / quant.reshape(8, 8)).astype(int)
    flat = raw.ravel()[baseline_jpeg.ZIGZAG].tolist()
    size, text = bits_of(flat[0] - last)
    out, run = CODE[size] + text, 0
    for v in flat[1:]:
        if v == 0:
            run += 1
            continue
        while run > 15:
            out, run = out + CODE[0xF0], run - 16
        size, text = bits_of(v)
        out, run = out + CODE[run << 4 | size] + text, 0
    out += CODE[0] if run else ""
    found = baseline_jpeg.BASIS.T @ (raw * quant.reshape(8, 8)) @ baseline_jpeg.BASIS
    return out, flat[0], np.clip(np.rint(found + 128), 0, 255).astype(np.uint8)


def segment(mark, body):
    return struct.pack(">HH", mark, len(body) + 2) + body


def image(planes, sampling, quant, every=0):
    """(JPEG image, samples of the first plane) of planes whose sizes fit whole units."""
    height, width = planes[0].shape
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    if len(planes) == 1:
        sampling, h, v = [(1, 1)], 1, 1
    units = [(y, x) for y in range(height // (8 * v)) for x in range(width // (8 * h))]
    text, last, data, want = "", [0] * len(planes), [], np.zeros_like(planes[0])
    for n, (y, x) in enumerate(units):
        if every and n and n % every == 0:
            data.append(text)
            text, last = "", [0] * len(planes)
        for k, (plane, (a, d)) in enumerate(zip(planes, sampling, strict=True)):
            for j in range(d):
                for i in range(a):
                    r, c = 8 * (y * d + j), 8 * (x * a + i)
                    more, last[k], found = coded(plane[r : r + 8, c : c + 8].astype(float), quant, last[k])
                    text += more
                    if k == 0:
                        want[r : r + 8, c : c + 8] = found
    data.append(text)
    packed = [int(t.ljust(-(-len(t) // 8) * 8, "1"), 2).to_bytes(-(-len(t) // 8)).replace(b"\xff", b"\xff\x00") for t in data]
    body = b"".join(p + (b"\xff" + bytes([0xD0 + k % 8]) if k < len(packed) - 1 else b"") for k, p in enumerate(packed))
    table = LENGTHS + bytes(SYMBOLS)
    head = b"\xff\xd8" + segment(0xFFE0, b"AVI1\x00\x00") + segment(0xFFDB, b"\x00" + bytes(quant[baseline_jpeg.ZIGZAG].tolist())) + segment(0xFFC4, b"\x00" + table) + segment(0xFFC4, b"\x10" + table)
    head += segment(0xFFDD, struct.pack(">H", every)) if every else b""
    head += segment(0xFFC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([k + 1, a << 4 | d, 0]) for k, (a, d) in enumerate(sampling)))
    return head + segment(0xFFDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + b"\x00\x3f\x00") + body + b"\xff\xd9", want


def smooth(rng, height, width):
    y, x = np.mgrid[:height, :width]
    return np.clip(128 + 60 * np.sin(x / 5 + rng.uniform(0, 6)) + 50 * np.cos(y / 4) + rng.normal(0, 6, (height, width)), 0, 255).astype(np.uint8)


QUANT = np.array([3 + r + c for r in range(8) for c in range(8)])


def test_zigzag_and_basis():
    assert baseline_jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and baseline_jpeg.ZIGZAG[-1] == 63
    assert np.allclose(baseline_jpeg.BASIS @ baseline_jpeg.BASIS.T, np.eye(8))


@pytest.mark.parametrize(("sampling", "every"), [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2)], 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2), ([(1, 1), (1, 1), (1, 1)], 0)])
def test_baseline_images(sampling, every):
    """Grey and coloured, sampled alike and less, with restarts; as near the picture as the quantiser allows."""
    rng = np.random.default_rng(len(sampling) + every)
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    planes = [smooth(rng, 32 * d // v, 48 * a // h) for a, d in sampling]
    jpeg, want = image(planes, sampling, QUANT, every)
    got = mjpeg_avi.decode_image(jpeg)
    assert got.shape == planes[0].shape and (got == want).all() and np.abs(got.astype(int) - planes[0]).mean() < 6


def test_size_that_is_no_multiple_of_a_block():
    jpeg, want = image([smooth(np.random.default_rng(1), 32, 48)], [(1, 1)], QUANT)
    at = jpeg.index(b"\xff\xc0")
    cut = jpeg[: at + 5] + struct.pack(">HH", 27, 41) + jpeg[at + 9 :]
    assert (baseline_jpeg.decode(cut) == want[:27, :41]).all()


def test_images_that_are_refused():
    jpeg, _ = image([smooth(np.random.default_rng(2), 16, 16)], [(1, 1)], QUANT)
    for broken, why in ((jpeg[2:], "not a JPEG"), (jpeg.replace(b"\xff\xc0", b"\xff\xc2"), "baseline"), (jpeg[: jpeg.index(b"\xff\xda") + 14] + b"\xff\xd9", "cut off")):
        with pytest.raises(ValueError, match=why):
            baseline_jpeg.decode(broken)
    at = jpeg.index(b"\xff\xc4")
    with pytest.raises(ValueError, match="without its tables"):
        baseline_jpeg.decode(jpeg[:at] + jpeg[jpeg.index(b"\xff\xc0") :])


def test_clips_of_ordinary_files(spark):
    """An AVI of baseline frames at 25 a second, with a cut; beside it a file of our own, null and an empty table."""
    rng = np.random.default_rng(3)
    scenes = [np.full((16, 24), 40, np.uint8), np.full((16, 24), 200, np.uint8)]
    images = [image([np.clip(scenes[k >= 7] + rng.integers(-3, 4, (16, 24)), 0, 255).astype(np.uint8)], [(1, 1)], QUANT)[0] for k in range(12)]
    avi = mjpeg_avi.write_avi(images, 0)
    at = avi.index(b"avih") + 8
    avi = avi[:at] + struct.pack("<I", 40_000) + avi[at + 4 :]
    own = mjpeg_avi.store_media(spark.createDataFrame([(5, "one text")], "doc_id long, text string")).first().media
    rows = spark.createDataFrame([(1, avi, "x"), (1, avi, "y"), (None, bytes(own), "z"), (3, None, "z")], "doc_id long, media binary, clip string")
    got = sorted(map(tuple, mjpeg_avi.clip_rows(rows).collect()), key=str)
    assert got == sorted([*[(1, 0, 0, 280, 0, 7), (1, 1, 280, 480, 7, 5)] * 2, (None, 0, 0, 100, 0, 1)], key=str)
    assert mjpeg_avi.clip_rows(rows.where(F.lit(False))).count() == 0
