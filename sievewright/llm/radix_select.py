"""The largest rows of every group by radix selection: histograms over value bits, then over bytes of the items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, small, stored

#: Bits of a value and bytes of an item that a round looks at; a group has that many cells at most.
BITS, BYTES = 10, 2
#: Once a group's boundary cell holds so few rows, they are ranked as they are.
FEW = 1024
#: Tables of thresholds up to so many groups are broadcast; larger ones are joined by exchange.
MOST_GROUPS = 200_000


def _same(a: str, b: str, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by))


def _cut(cells: DataFrame, by: list[str], state: list[str], order: Column) -> DataFrame:
    """Of each group's ``cells`` (``_cell``, ``_n``) in ``order`` the one with the row that is still needed."""
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    run = cells.withColumn("_above", F.coalesce(before, F.lit(0)))
    return run.where((F.col("_above") < F.col("_need")) & (F.col("_above") + F.col("_n") >= F.col("_need"))).select(*by, *state, "_cell", "_n", (F.col("_need") - F.col("_above")).alias("_need"))


def thresholds(rows: DataFrame, by: list[str], value: str, item: str, most: int) -> DataFrame:
    """Per group ``_low`` and ``_bound``: rows above ``_low``, or at it with items up to the prefix ``_bound``, hold its first ``most``.

    ``rows`` (stored) has values of 0 or more. Each round counts a group's rows per cell of BITS value bits, highest
    bits first, beginning at its largest value's; the cell with the row at place ``most`` is split in the next one.
    A group whose boundary cell is one value with more than FEW rows goes on over BYTES bytes of the items a round.
    Counts are summed up before they are exchanged, so the rows of a hot group never meet.
    """
    whole = F.lit(None).cast("binary")
    bits = lambda x: F.length(F.bin(x))
    begun = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.max(value).alias("_top"))
    begun = stored(begun.select(*by, "_n", F.lit(0).cast("long").alias("_low"), F.greatest(F.lit(0), bits(F.col("_top")) - BITS).cast("int").alias("_shift"), F.lit(most).cast("long").alias("_need"), whole.alias("_bound")), "radix")
    wide = F.col("_n") > most + FEW
    state = ["_low", "_shift", "_need", "_bound"]
    done, made, open_, ties = [begun.where(~wide)], [begun], begun.where(wide), []
    while not open_.isEmpty():
        held = rows.alias("r").join(small(open_.select(*by, *state), MOST_GROUPS).alias("o"), _same("r", "o", by))
        inside = held.select(*(F.col(f"r.{c}") for c in by), *state, F.expr(f"shiftright(r.{value} - _low, _shift)").alias("_cell")).where(F.col("_cell").between(0, (1 << BITS) - 1))
        cells = inside.groupBy(*by, *state, "_cell").agg(F.count("*").alias("_n"))
        step = _cut(cells, by, ["_low", "_shift", "_bound"], F.desc("_cell"))
        step = stored(step.select(*by, "_n", F.expr("_low + shiftleft(_cell, _shift)").alias("_low"), F.greatest(F.lit(0), F.col("_shift") - BITS).cast("int").alias("_shift"), "_need", "_bound", (F.col("_shift") == 0).alias("_exact")), "radix")
        made.append(step)
        many = F.col("_n") > FEW
        done.append(step.where(~many))
        ties.append(step.where(many & F.col("_exact")))
        open_ = step.where(many & ~F.col("_exact"))
    names = [*by, "_low", "_bound"]
    told = reduce(lambda a, b: a.unionByName(b), (d.select(*names) for d in done))
    if ties:
        open_ = reduce(lambda a, b: a.unionByName(b), ties).withColumn("_bound", F.encode(F.lit(""), "UTF-8"))
        while not open_.isEmpty():
            raw = F.encode(F.col(f"r.{item}"), "UTF-8")
            size = F.octet_length("_bound")
            held = rows.alias("r").join(small(open_.select(*by, *state), MOST_GROUPS).alias("o"), _same("r", "o", by) & (F.col(f"r.{value}") == F.col("_low")))
            inside = held.where(F.substring(raw, F.lit(1), size) == F.col("_bound")).select(*(F.col(f"r.{c}") for c in by), *state, F.substring(raw, F.lit(1), size + BYTES).alias("_cell"))
            cells = inside.groupBy(*by, *state, "_cell").agg(F.count("*").alias("_n"))
            step = _cut(cells, by, ["_low", "_shift", "_bound"], F.asc("_cell"))
            # A cell that its items do not reach beyond holds repeats of one item: nothing is left to split.
            step = stored(step.select(*by, "_n", "_low", "_shift", "_need", F.col("_cell").alias("_bound"), (F.octet_length("_cell") < F.octet_length("_bound") + BYTES).alias("_ended")), "radix")
            made.append(step)
            many = (F.col("_n") > FEW) & ~F.col("_ended")
            told = told.unionByName(step.where(~many).select(*names))
            open_ = step.where(many)
    out = stored(told, "radix-thresholds")
    discard(*made)
    return out


def largest(rows: DataFrame, by: list[str], value: str, item: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group with ``rank`` (from 1): ``value`` descending, then the bytes of ``item``.

    Values are whole numbers of 0 or more and not null; items are not null and, in a group, not repeated (of repeats
    any may come first). Groups may have null keys. An empty table gives no rows; further columns stay.
    """
    held = stored(rows, "radix-rows")
    bounds = small(thresholds(held, by, value, item, most), MOST_GROUPS)
    v, raw = F.col(f"r.{value}"), F.encode(F.col(f"r.{item}"), "UTF-8")
    near = (v == F.col("_low")) & F.col("_bound").isNotNull()
    inside = F.when(near, F.substring(raw, F.lit(1), F.octet_length("_bound")) <= F.col("_bound")).otherwise(v >= F.col("_low"))
    few = held.alias("r").join(bounds.alias("o"), _same("r", "o", by)).where(inside).select(*(F.col(f"r.{c}") for c in held.columns))
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), item))).where(F.col("rank") <= most)
