"""Sharding by histogram sort: splitters from exact byte counts, refined until they meet a tolerance; one exchange (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

_LOW = -(1 << 63)


@dataclass
class Splitter:
    """A boundary in key order: rows with (hash, id) at or above it lie in a later shard."""

    target: float
    hash: int = _LOW
    id: int | None = None
    depth: int = 0
    prefix: int = 0
    below: int = 0
    done: bool = False


def _cells(rows: DataFrame, cell) -> list:
    return rows.groupBy(*cell).agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"), F.min("_hash").alias("low")).collect()


def _refine_hash(rows: DataFrame, open_: list[Splitter], bits: int, slack: float) -> None:
    """One round of probes on the hash: every open splitter's interval is cut into 2**bits cells whose exact bytes are counted."""
    depth = open_[0].depth
    cell = F.shiftright("_hash", 64 - depth - bits)
    here = rows if depth == 0 else rows.where(F.shiftright("_hash", 64 - depth).isin(sorted({s.prefix for s in open_})))
    counted = sorted((r["cell"], r["bytes"], r["n"], r["low"]) for r in _cells(here, [cell.alias("cell")]))
    for s in open_:
        below = s.below
        for prefix, size, n, low in counted:
            if depth and prefix >> bits != s.prefix:
                continue
            if below + size > s.target:
                s.prefix, s.below, s.depth = prefix, below, depth + bits
                s.hash = prefix << (64 - s.depth)
                if s.target - below <= slack:
                    s.done = True
                elif below + size - s.target <= slack:
                    s.done, s.below, s.hash = True, below + size, (prefix + 1) << (64 - s.depth)
                elif n == 1:  # exact to the row: it goes to the nearer side
                    after = s.target - below <= below + size - s.target
                    s.done, s.below, s.hash = True, below + size * (not after), low + (not after)
                break
            below += size
        else:  # nothing lies above the target
            s.done, s.hash = True, (1 << 63) - 1
            s.id = None


def _refine_id(rows: DataFrame, s: Splitter, cells: int, slack: float) -> None:
    """A single hash outweighs the tolerance: go on inside it by row id, with evenly spaced probes."""
    same = rows.where(F.col("_hash") == s.hash)
    low, high = same.agg(F.min("_id"), F.max("_id")).first()
    high += 1
    while True:
        step = max(1, -(-(high - low) // cells))
        here = same.where((F.col("_id") >= low) & (F.col("_id") < high))
        cell = F.expr(f"cast((cast(_id as decimal(20,0)) - {low}) div {step} as bigint)")
        below = s.below
        for k, size in sorted((r["cell"], r["bytes"]) for r in _cells(here, [cell.alias("cell")])):
            if below + size > s.target:
                break
            below += size
        s.below, low = below, low + k * step
        high = min(high, low + step)
        s.id = low
        if s.target - below <= slack or step == 1:
            s.done = True
            return


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001, bits: int = 10) -> list[Splitter]:
    """``shards`` - 1 boundaries over ``rows`` (_hash, _id, _size), each within ``tolerance`` of a shard of its target or exact to a row.

    The driver sees at most 2**bits counts per splitter and round, whatever the input.
    """
    total = rows.agg(F.sum("_size")).first()[0] or 0
    slack = tolerance * total / shards
    found = [Splitter(total * k / shards) for k in range(1, shards)]
    for depth in range(0, 64, bits):
        if open_ := [s for s in found if not s.done]:
            _refine_hash(rows, open_, min(bits, 64 - depth), slack)
    for s in found:
        if not s.done:
            _refine_id(rows, s, 1 << bits, slack)
    return found


def histogram_sort(rows: DataFrame, shards: int = 24, size_col: str = "size", hash_col: str = "key_hash", id_col: str = "doc_id", tolerance: float = 0.001, range_rows: int = 20_000, most_heavy: int = 4096) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: shards of near-equal bytes that are contiguous in key order (hash, id).

    With the text's hash as first part of the key, equal texts lie side by side and share a shard unless a splitter
    has to fall among them; a text that outweighs the tolerance is split by id. Splitters come from repeated exact
    counts over a narrow table of (hash, id, size), then the rows are exchanged once, by sub-range of their shard.
    A slot is its sub-range's offset plus the row's place in it, so no task ever sorts a whole shard. Sub-ranges are
    slices of the hash domain of about ``range_rows`` rows, and every text with more rows than that (and than one in
    ``most_heavy`` of all, so there are no more such texts than that) is cut further by id.

    Null ids come first in key order, null sizes count as 0. Repeated rows get a slot each. An empty table stays empty.
    Columns named ``shard`` or ``slot``, whatever their case, are refused; others are carried as they are, whatever
    their names.
    """
    if taken := [c for c in rows.columns if c.lower() in ("shard", "slot")]:
        raise ValueError(f"columns that sharding names itself: {', '.join(taken)}")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW))
    narrow = stored(rows.select(F.coalesce(F.col(hash_col), F.lit(0)).alias("_hash"), key.alias("_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_size")), "histogram")
    cuts, total = splitters(narrow, shards, tolerance), narrow.count()
    shard = F.lit(0)
    for s in cuts:
        after = F.col("_hash") > s.hash if s.id is not None else F.col("_hash") >= s.hash
        shard = shard + (after | ((F.col("_hash") == s.hash) & (F.col("_id") >= s.id)) if s.id is not None else after).cast("int")
    cell = F.shiftright("_hash", 64 - min(24, max(12, (total // range_rows).bit_length())))
    # Texts that one task should not sort alone: their ids are cut into even steps.
    each = max(range_rows, total // most_heavy)
    heavy = narrow.groupBy("_hash").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.max("_id").alias("_last")).where(F.col("_n") > each)
    step = F.expr(f"cast((cast(_last as decimal(20,0)) - _first) div ceil(_n / {each // 2}) + 1 as decimal(20,0))")
    heavy = stored(heavy.groupBy(cell.alias("_cell")).agg(F.array_sort(F.collect_list(F.struct("_hash", F.col("_first").alias("first"), step.alias("step")))).alias("_heavy")), "histogram-heavy")

    def ranged(df: DataFrame) -> DataFrame:
        known = df.withColumn("shard", shard).withColumn("_cell", cell).join(F.broadcast(heavy), "_cell", "left")
        below = F.coalesce(F.size(F.filter("_heavy", lambda x: x["_hash"] < F.col("_hash"))), F.lit(0)) * F.when(F.col("_heavy").isNull(), 0).otherwise(2)
        own = F.filter("_heavy", lambda x: x["_hash"] == F.col("_hash"))
        known = known.withColumn("_own", F.when(F.size(own) > 0, own[0]))
        inside = F.expr("cast((cast(_id as decimal(20,0)) - _own.first) div _own.step as bigint)")
        return known.withColumn("_part", below + F.col("_own").isNotNull().cast("int")).withColumn("_in", F.coalesce(inside, F.lit(0))).drop("_heavy", "_own")

    order = Window.partitionBy("shard").orderBy("_cell", "_part", "_in")
    at = "shard", "_cell", "_part", "_in"
    offsets = ranged(narrow).groupBy(*at).agg(F.count("*").alias("_n")).select(*at, (F.sum("_n").over(order) - F.col("_n")).alias("_offset"))
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row")  # so that no name of theirs meets an inner one
    keyed = ranged(rows.select(row, F.coalesce(F.col(hash_col), F.lit(0)).alias("_hash"), key.alias("_id")))
    place = Window.partitionBy(*at).orderBy("_hash", "_id")
    return keyed.withColumn("_place", F.row_number().over(place)).join(offsets, list(at)).withColumn("slot", F.col("_offset") + F.col("_place") - 1).select("_row.*", "shard", "slot")
