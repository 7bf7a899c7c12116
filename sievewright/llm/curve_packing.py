"""Packing along a space-filling curve: documents in the order of the Hilbert key of their projected vectors, packed as one stream."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import library_memory, text_portions
from .common import prepare, stored, tidy
from .files import task_number

#: Buckets of the hashed vectors, axes they are projected to, bits of each axis in the key (60 together).
BUCKETS, AXES, DEPTH = 1024, 4, 15
#: Tokens of a partition of the curve at most, about; more partitions than this asks for are made where Spark is set to more.
PART_TOKENS = 128_000_000


def projection(seed: int = 13) -> np.ndarray:
    """BUCKETS x AXES signs; a unit vector's coordinates then are about normal."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (BUCKETS, AXES))


def coordinates(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """A document's place on each axis, 0 to 2^DEPTH - 1: damped counts of its ids by hash, as a unit vector, projected; no ids stand in the middle."""
    buckets = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)
    v = np.sqrt(np.bincount(buckets, minlength=BUCKETS))
    z = v @ signs / max(float(np.sqrt(v @ v)), 1.0)
    return np.minimum((1 << DEPTH) - 1, ((1 << DEPTH) / (1 + np.exp(-1.702 * z))).astype(np.int64))


def hilbert_keys(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Places on the Hilbert curve of ``points`` (rows of whole numbers below 2^depth); depth times axes stays below 64.

    Bits of the axes are turned from the highest down into the curve's, Gray-decoded, and woven into one number.
    """
    x = [c.astype(np.int64) for c in points.T]
    for b in range(depth - 1, 0, -1):
        bit, below = 1 << b, (1 << b) - 1
        for k in range(len(x)):
            high = (x[k] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    for b in range(depth - 1, 0, -1):
        turn = np.where(x[-1] & (1 << b), turn ^ ((1 << b) - 1), turn)
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ turn) >> b & 1)
    return key


def curve_keys(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key``, ``n_tokens``, ``ids`` (with ``end_id``; little-endian, of two bytes each where all ids fit, else four); ``width`` tells."""
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id) < 1 << 16 else 4
    prepare(docs.sparkSession)
    names = ["doc_id", "key", "n_tokens", "ids", "width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, signs, end = library_memory(tokenizer_path, "glued"), projection(), np.array([end_id], "<u4")
        for batch in batches:
            for a, b, data, offsets in text_portions(batch.column(1)):
                found, ends = memory(data, offsets)
                cut = [0, *ends.tolist()]
                own = [found[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
                keys = hilbert_keys(np.array([coordinates(x, signs) for x in own]))
                raw = [np.concatenate([x, end]).astype(f"<u{width}").tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys), pa.array([len(x) + 1 for x in own], pa.int64()), pa.array(raw, pa.binary()), pa.array([width] * len(own), pa.int32())], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(tidy(run), "doc_id long, key long, n_tokens long, ids binary, width int")


class Stream:
    """Documents laid end to end in sequences of ``capacity`` ids.

    What the last sequence holds is cut into sequences whose lengths are powers of two, largest first, as those need no
    padding: at most one for each bit of the capacity.
    """

    def __init__(self, capacity: int, base: int, ids: bool):
        self.capacity, self.next, self.ids = capacity, base, ids
        self.open, self.filled, self.rows = [], 0, []

    def add(self, doc_id: int | None, found: np.ndarray) -> None:
        at = 0
        while at < len(found):
            part = found[at : at + self.capacity - self.filled]
            self.open.append((doc_id, at, part, len(found)))
            at, self.filled = at + len(part), self.filled + len(part)
            if self.filled == self.capacity:
                self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, part, whole in pieces:
            raw = part.tobytes()
            self.rows.append((doc_id, start, len(part), zlib.crc32(raw), whole, self.next, offset, *([raw] if self.ids else [])))
            offset += len(part)
        self.next += 1

    def finish(self) -> None:
        rest, left = self.open, self.filled
        while left:
            size = 1 << (left.bit_length() - 1)
            left, mine = left - size, []
            while size:
                doc_id, start, part, whole = rest[0]
                mine.append((doc_id, start, part[:size], whole))
                rest = rest[1:] if len(part) <= size else [(doc_id, start + size, part[size:], whole), *rest[1:]]
                size -= len(mine[-1][2])
            self._close(mine)
        self.open, self.filled = [], 0


def pack_along_curve(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (with ``ids`` the ids too, as little-endian unsigned 32-bit).

    Documents are sorted by their key on the curve, so neighbours in a sequence are alike, and laid end to end; they are
    cut only where a sequence is full. Each range of the curve is packed by one task, which holds one sequence at a
    time. Ids are stored once, before the exchange by ranges looks for its bounds, so texts are encoded once.

    Copies have one key and are told apart by id, so a hot group of them spreads over ranges. Null text counts as empty
    (the end id alone), repeated rows are packed as often as they occur, null ids stay null, an empty table gives an
    empty result; further columns are not read.
    """
    held = stored(curve_keys(docs, tokenizer_path, end_id, id_col, text_col), "curve-ids")
    total = held.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]
    kinds = [*[pa.int64()] * 7, *([pa.binary()] if ids else [])]

    def told(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(capacity, task_number() << 40, ids)
        for batch in batches:
            for doc_id, raw, width in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                stream.add(doc_id, np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4"))
                if len(stream.rows) >= 10_000:
                    yield told(stream.rows)
                    stream.rows = []
        stream.finish()
        if stream.rows:
            yield told(stream.rows)

    ranged = held.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "ids", "width")
    return ranged.mapInArrow(tidy(run), ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))
