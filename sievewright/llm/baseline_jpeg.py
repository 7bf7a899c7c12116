"""Baseline (DCT, Huffman, 8 bit) JPEG images, as ordinary motion-JPEG files hold them: samples of the first component.

Grey images and images of several components with any sampling, one interleaved scan, restart markers. Frames that
leave out their code tables, as some recorders do, are refused: they do not say how they are coded.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    """Place (row * 8 + column) of each coefficient: diagonals, every other one upwards."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([r * 8 + c for r, c in sorted(cells, key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])


def _basis() -> np.ndarray:
    """Rows of the 8-point cosine transform."""
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


ZIGZAG, BASIS = _zigzag(), _basis()


@dataclass
class Component:
    """How a component is sampled, which tables it uses, and its coefficients by block."""

    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0
    last: int = 0
    blocks: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)


class _Bits:
    """Bits of entropy-coded bytes, without the zeros that follow 255s."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise ValueError("cut off image")
            self.held, self.n, self.at = self.held << 8 | self.data[self.at], self.n + 8, self.at + 1
        self.n -= n
        value = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := codes.get((length, code))) is not None:
                return found
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[length, code] = values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _block(bits: _Bits, own: Component, dc: dict, ac: dict) -> np.ndarray:
    out, k = np.zeros(64, np.int64), 1
    own.last += bits.signed(bits.symbol(dc))
    out[0] = own.last
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if not size and run < 15:
            break
        k += run
        if k > 63:
            raise ValueError("coefficients beyond a block's end")
        out[k] = bits.signed(size)
        k += 1
    return out


def decode(jpeg: bytes) -> np.ndarray:
    """(height, width) samples of the first component (grey, or luminance)."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, quant, codes, parts, shape, every = 2, {}, {}, {}, None, 0
    while True:
        mark, size = struct.unpack_from(">HH", jpeg, at)
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xFFDB:
            while body:
                wide, number = divmod(body[0], 16)
                quant[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (2 if wide else 1) :]
        elif mark == 0xFFC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]], body = _codes(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif mark == 0xFFDD:
            every = struct.unpack(">H", body)[0]
        elif mark in (0xFFC0, 0xFFC1):
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit samples")
            shape = height, width
            parts = {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
        elif 0xFFC2 <= mark <= 0xFFCF:
            raise ValueError("only baseline images")
        elif mark == 0xFFDA:
            break
    if shape is None or body[0] != len(parts):
        raise ValueError("only one interleaved scan")
    scan = []
    for k in range(body[0]):
        own = parts[body[1 + 2 * k]]
        own.dc, own.ac = body[2 + 2 * k] >> 4, 16 + (body[2 + 2 * k] & 15)
        if own.dc not in codes or own.ac not in codes or own.quant not in quant:
            raise ValueError("an image without its tables")
        scan.append(own)
    # An image of one component has no interleaving, whatever its sampling.
    across, down = (1, 1) if len(scan) == 1 else (max(c.across for c in scan), max(c.down for c in scan))
    columns, rows = -(-shape[1] // (8 * across)), -(-shape[0] // (8 * down))
    end = jpeg.rfind(b"\xff\xd9")
    stretches, start = [], at
    for k in range(at, end - 1 if end > 0 else len(jpeg) - 1):
        if jpeg[k] == 0xFF and 0xD0 <= jpeg[k + 1] <= 0xD7:
            stretches.append(jpeg[start:k])
            start = k + 2
    stretches.append(jpeg[start : end if end > 0 else len(jpeg)])
    bits = None
    for unit in range(columns * rows):
        if bits is None or (every and unit % every == 0):
            bits = _Bits(stretches[unit // every if every else 0])
            for own in scan:
                own.last = 0
        for own in scan:
            wide, high = (1, 1) if len(scan) == 1 else (own.across, own.down)
            for y in range(high):
                for x in range(wide):
                    own.blocks[unit // columns * high + y, unit % columns * wide + x] = _block(bits, own, codes[own.dc], codes[own.ac])
    first = scan[0]
    wide, high = (1, 1) if len(scan) == 1 else (first.across, first.down)
    plane = np.zeros((rows * high * 8, columns * wide * 8))
    for (y, x), found in first.blocks.items():
        square = np.zeros(64)
        square[ZIGZAG] = found * quant[first.quant]
        plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = BASIS.T @ square.reshape(8, 8) @ BASIS
    # A first component that is sampled less than others is spread to the image's size.
    plane = np.repeat(np.repeat(plane, down // high, axis=0), across // wide, axis=1)
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[: shape[0], : shape[1]]
