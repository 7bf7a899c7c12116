"""Token ids in wavelet-matrix shards: succinct bit-planes with rank and select, one file per shard."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import library_memory, text_portions
from .common import prepare, shared_dir
from .files import read_file, task_number, write_file

_MAGIC = b"WVM2"
_CHUNK = 1 << 17


class WaveletMatrix:
    """A sequence of ids as bit-planes, most significant first, each stably parted by the one before.

    ``to_bytes`` holds per plane its zeros and its bits in compressed chunks of _CHUNK bits, with the ones before each
    chunk. Access, counting and occurrence lookup open the few chunks they need and never unpack the sequence; places
    may be given as arrays. As many planes are kept as the largest id has bits.
    """

    def __init__(self, n: int, bits: int, zeros: list[int], ranks: list[np.ndarray], ends: list[np.ndarray], blobs: list[memoryview]):
        self.n, self.bits, self.zeros, self.ranks, self.ends, self.blobs = n, bits, zeros, ranks, ends, blobs
        self.opened: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        bits, press = max(1, top.bit_length()), zstandard.ZstdCompressor(level=1).compress
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64)
        zeros, ranks, ends, blobs = [], [], [], []
        for b in range(bits - 1, -1, -1):
            one = (x >> x.dtype.type(b) & x.dtype.type(1)).astype(bool)
            full = np.zeros(-(-len(x) // _CHUNK) * _CHUNK // 8, np.uint8)
            full[: -(-len(x) // 8)] = np.packbits(one, bitorder="little")
            counts = np.bitwise_count(full.view("<u8")).reshape(-1, _CHUNK // 64).sum(axis=1, dtype=np.uint64)
            parts = [press(full[k : k + _CHUNK // 8]) for k in range(0, len(full), _CHUNK // 8)]
            zeros.append(int(len(x) - one.sum()))
            ranks.append(np.concatenate([[np.uint64(0)], np.cumsum(counts, dtype=np.uint64)]))
            ends.append(np.cumsum([0, *map(len, parts)]).astype(np.uint64))
            blobs.append(memoryview(b"".join(parts)))
            x = np.concatenate([x.take(np.flatnonzero(~one)), x.take(np.flatnonzero(one))])  # faster than masks of random bits
        return cls(len(ids), bits, zeros, ranks, ends, blobs)

    def to_bytes(self) -> bytes:
        out = [_MAGIC, struct.pack("<QB", self.n, self.bits)]
        for z, rank, end, blob in zip(self.zeros, self.ranks, self.ends, self.blobs, strict=True):
            out += [struct.pack("<Q", z), rank.astype("<u8").tobytes(), end.astype("<u8").tobytes(), blob]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> WaveletMatrix:
        if data[at : at + 4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits = struct.unpack_from("<QB", data, at + 4)
        at, chunks, zeros, ranks, ends, blobs = at + 13, -(-n // _CHUNK), [], [], [], []
        for _ in range(bits):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            ranks.append(np.frombuffer(data, "<u8", chunks + 1, at + 8))
            ends.append(np.frombuffer(data, "<u8", chunks + 1, at + 16 + 8 * chunks))
            at += 24 + 16 * chunks
            blobs.append(memoryview(data)[at : at + int(ends[-1][-1])])
            at += int(ends[-1][-1])
        return cls(n, bits, zeros, ranks, ends, blobs)

    def _chunk(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of 64 bits of a chunk, and the ones before each within it."""
        found = self.opened.get((level, k))
        if found is None:
            if len(self.opened) >= 4 * self.bits:
                self.opened.clear()
            a, b = int(self.ends[level][k]), int(self.ends[level][k + 1])
            words = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blobs[level][a:b], _CHUNK // 8), "<u8")
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            found = self.opened[level, k] = words, np.concatenate([[0], ones])
        return found

    def _seen(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit at, ones before) each place of a plane; the place behind the last has no bit."""
        bit, ones, chunk = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64), places // _CHUNK
        order = np.argsort(chunk, kind="stable")
        cut = [0, *(np.flatnonzero(np.diff(chunk[order])) + 1).tolist(), len(places)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = order[a:b]
            if a == b:
                continue
            k = int(chunk[own[0]])
            ones[own] = int(self.ranks[level][k])
            if k * _CHUNK >= self.n:
                continue
            words, before = self._chunk(level, k)
            inside = places[own] - k * _CHUNK
            word, shift = words[inside >> 6], (inside & 63).astype(np.uint64)
            bit[own] = (word >> shift & np.uint64(1)).astype(np.int64)
            ones[own] += before[inside >> 6] + np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
        return bit, ones

    def access(self, i):
        """The id at place ``i``, or at each of an array of places."""
        places = np.atleast_1d(np.asarray(i, np.int64))
        if len(places) and not 0 <= int(places.min()) <= int(places.max()) < self.n:
            raise IndexError(i)
        value = np.zeros(len(places), np.int64)
        for level in range(self.bits):
            bit, ones = self._seen(level, places)
            value = value << 1 | bit
            places = np.where(bit == 1, self.zeros[level] + ones, places - ones)
        return value if np.ndim(i) else int(value[0])

    def _range(self, value: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for level in range(self.bits):
            a, b = self._seen(level, start)[1], self._seen(level, end)[1]
            if value >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start=0, end=None):
        """How often ``value`` stands in places ``start`` up to ``end``, or in each of two arrays of them."""
        a, b = np.atleast_1d(np.asarray(start, np.int64)), np.atleast_1d(np.asarray(self.n if end is None else end, np.int64))
        found = np.zeros(len(a), np.int64)
        if not value >> self.bits:
            low, high = self._range(value, a, b)
            found = high - low
        return found if np.ndim(start) else int(found[0])

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane: binary search over chunks, then over words, then inside one."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks), dtype=np.int64) * _CHUNK, self.n) - ranks
        chunk = int(np.searchsorted(before, k, "right")) - 1
        words, ones = self._chunk(level, chunk)
        rest, inside = k - int(before[chunk]), ones if bit else np.arange(len(ones)) * 64 - ones
        word = int(np.searchsorted(inside, rest, "right")) - 1
        here = np.unpackbits(words[word : word + 1].view(np.uint8), bitorder="little")
        return chunk * _CHUNK + word * 64 + int(np.flatnonzero(here == bit)[rest - int(inside[word])])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = int(self._range(value, np.zeros(1, np.int64), np.full(1, self.n))[0][0]) + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def all(self) -> np.ndarray:
        """The whole sequence: planes are unparted from the last to the first."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32 if self.bits <= 32 else np.uint64)
        press = zstandard.ZstdDecompressor()
        for level in range(self.bits - 1, -1, -1):
            ends = self.ends[level].tolist()
            plane = b"".join(press.decompress(self.blobs[level][a:b], _CHUNK // 8) for a, b in zip(ends[:-1], ends[1:], strict=True))
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            z, up = self.zeros[level], np.empty_like(x)
            up[np.flatnonzero(~one)] = x[:z]
            up[np.flatnonzero(one)] = x[z:] | x.dtype.type(1 << (self.bits - 1 - level))
            x = up
        return x


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard's file: the documents' ids and lengths, then the matrix of all their tokens."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = struct.pack("<Q", len(doc_ids)) + known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes()
    return head + WaveletMatrix.build(ids).to_bytes()


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    (n,) = struct.unpack_from("<Q", data)
    known = np.frombuffer(data, np.uint8, n, 8)
    doc_ids = np.frombuffer(data, "<i8", n, 8 + n)
    lengths = np.frombuffer(data, "<u8", n, 8 + 9 * n).astype(np.int64)
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], lengths, WaveletMatrix.from_bytes(data, 8 + 17 * n)


def write_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = 2_000_000, partitions: int | None = None) -> DataFrame:
    """Encode, append ``end_id`` to each document and write shards in ascending id order; returns their stored list.

    The list has a row per file: ``path``, ``part``, ``seq``, ``tokens``, ``start`` (tokens of all files before it).
    Texts are exchanged once, by ranges of the id; a task writes its range as files of about ``shard_tokens`` tokens,
    and the stored list names those of the attempts that counted. Null ids come first, null
    text counts as empty, rows that repeat an id follow each other in any order; an empty table makes no file.
    """
    spark = prepare(docs.sparkSession)
    folder = shared_dir(spark, "wavelet")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, part, seq = library_memory(tokenizer_path, "glued", 1_500_000), task_number(), 0
        doc_ids, lengths, held, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, total
            path = write_file(f"{folder}/part-{part:06d}-{seq:06d}", ".wvm", pack_shard(doc_ids, lengths, np.concatenate(held)))
            row = pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "tokens": pa.array([total], pa.int64())})
            doc_ids.clear(), lengths.clear(), held.clear()
            seq, total = seq + 1, 0
            return row

        for batch in batches:
            own = batch.column(0).to_pylist()
            for a, b, data, offsets in text_portions(batch.column(1)):
                ids, ends = memory(data, offsets)
                at = 0
                for d, e in zip(own[a:b], ends.tolist(), strict=True):
                    doc_ids.append(d), lengths.append(e - at + 1), held.extend((ids[at:e], end))
                    total, at = total + e - at + 1, e
                    if total >= shard_tokens:
                        yield flush()
        if doc_ids:
            yield flush()

    ordered = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col]).repartitionByRange(partitions, "id").sortWithinPartitions("id")
    files = shared_dir(spark, "wavelet-list")
    ordered.mapInArrow(run, "path string, part long, seq long, tokens long").write.parquet(files)
    listed = spark.read.schema("path string, part long, seq long, tokens long").parquet(files)
    sums = listed.groupBy("part").agg(F.sum("tokens").alias("_all"))
    before = sums.select("part", (F.sum("_all").over(Window.orderBy("part")) - F.col("_all")).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq")
    return listed.withColumn("_in", F.sum("tokens").over(inside) - F.col("tokens")).join(before, "part").select("path", "part", "seq", "tokens", (F.col("_before") + F.col("_in")).alias("start"))


def read_shards(listed: DataFrame, end_id: int = 0) -> DataFrame:
    """Per document of the shards in ``listed``: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, ``last_id``, ``n_end_ids``, from the files alone.

    ``last_id`` is looked up by access at each document's last place, ``n_end_ids`` (occurrences of ``end_id``) by
    ranks at its two ends; the checksums take the whole sequence. An empty list gives an empty result.
    """
    partitions = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, lengths, matrix = unpack_shard(read_file(path))
                data, ends = matrix.all().astype("<u4"), np.cumsum(lengths)
                crcs = [zlib.crc32(data[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = doc_ids, start + ends - lengths, lengths, crcs, matrix.access(ends - 1), matrix.count(end_id, ends - lengths, ends)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32", "last_id", "n_end_ids"])

    return listed.select("path", "start").repartition(partitions, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, last_id long, n_end_ids long")
