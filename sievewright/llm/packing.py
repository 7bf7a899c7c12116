"""Best-fit packing by sum of squares: a piece goes where the squared counts of open bins per residual gap become smallest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import library_memory, text_portions
from .common import prepare, tidy
from .files import task_number


class SumOfSquares:
    """Open bins by residual gap. ``place`` picks, among the gaps that fit, the one that leaves the least sum of squared counts (on ties the smallest); a bin is opened only where none fits."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        cap, n = self.capacity, self.counts
        fit = np.flatnonzero(n[size:cap]) + size
        if len(fit):
            change = 2 - 2 * n[fit] + 2 * n[fit - size]
            if fit[0] == size:  # the bin closes, and closed bins do not count
                change[0] = 1 - 2 * n[size]
            gap = int(fit[change.argmin()])
            bin_ = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, bin_ = cap, self.bins
            self.bins += 1
        left = gap - size
        if left:
            self.open[left].append(bin_)
            n[left] += 1
        return bin_, cap - gap


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (with ``ids`` also the ids, little-endian unsigned 32-bit).

    Ids are those of the tokenizers library, ``end_id`` follows them. Only documents longer than ``capacity`` are cut.
    """
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = library_memory(tokenizer_path, "bare")
        for batch in batches:
            own = batch.column(0).to_pylist()
            for a, b, data, offsets in text_portions(batch.column(1)):
                found, ends = memory(data, offsets)
                rows, at = [], 0
                for d, e in zip(own[a:b], ends.tolist(), strict=True):
                    mine = np.concatenate([found[at:e], end])
                    for k in range(0, len(mine), capacity):
                        x = mine[k : k + capacity]
                        rows.append((d, k // capacity, k, len(x), zlib.crc32(x), *([x.tobytes()] if ids else [])))
                    at = e
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if ids else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def pack(pieces: DataFrame, packers: int, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Pieces are dealt by (doc_id, piece) to ``packers`` tasks, each of which packs its own by falling length. What a
    task leaves open is a handful of bins, so with tens of thousands of pieces a task the loss is far below one per
    mille, and no task sees more than its share.
    """
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, base = SumOfSquares(capacity), task_number() << 40
        placed = [bins.place(n) for n in rows.column("length").to_pylist()]
        rows = rows.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        yield from rows.to_batches(max_chunksize=10_000)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(packers, "doc_id", "piece").select(*names).mapInArrow(tidy(run), kinds + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, per_packer: int = 40_000, **options) -> DataFrame:
    """Tokenize and pack ``docs``: a row per piece with its sequence and place.

    Null text counts as empty (the end id alone), repeated rows are packed as often as they occur, null ids stay null,
    an empty table gives an empty result; further columns of ``docs`` are not read.
    """
    packers = max(1, -(-docs.count() // per_packer))
    return pack(token_pieces(docs, tokenizer_path, capacity, **options), packers, capacity)
