"""Source divergence audit: how the terms of each source differ from those of the other sources of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import text_portions
from .common import discard, prepare, small, stored, tidy
from .radix_select import largest

#: Bytes of terms, A to Z as a to z; all other ASCII bytes stand between terms. Every byte of other characters counts.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 0 for b in range(256))
#: Sources of a term that meet in one row of the pair kernel, and pairs that it works on at a time.
BLOCK, PAIRS = 512, 1 << 20
#: Tables of up to so many groups are broadcast; beyond that the pairs of a language are spread over SALTS keys.
MOST_GROUPS, SALTS = 200_000, 64
_PPB = 1_000_000_000


def _occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, term of each occurrence, text of each occurrence) of texts data[offsets[k] : offsets[k + 1]]."""
    low = np.frombuffer(data.tobytes().translate(_TERM), np.uint8)
    solid = low != 0
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = solid[first]
    before = np.concatenate([[0], np.cumsum(solid)])
    cut = np.append(before[np.flatnonzero(start)], before[-1])
    words = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(low[solid])]).dictionary_encode()
    own = np.diff(np.searchsorted(cut[:-1], before[offsets]))
    return words.dictionary, words.indices.to_numpy(), np.repeat(np.arange(len(own)), own)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (documents with it), summed up; null lang, source and text are empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (pc.fill_null(batch.column(k), "").dictionary_encode() for k in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            for a, b, data, offsets in text_portions(batch.column(2)):
                terms, term, text = _occurrences(data, offsets)
                if not len(term):
                    continue
                each, times = np.unique(text * len(terms) + term, return_counts=True)
                key = group[a:b][each // len(terms)] * len(terms) + each % len(terms)
                order = np.argsort(key, kind="stable")
                key, times = key[order], times[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                of, which = key[first] // len(terms), key[first] % len(terms)
                columns = [lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), terms.take(pa.array(which)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.add.reduceat(times, first)), pa.array(np.diff(np.append(first, len(key))))], ["lang", "source", "term", "n", "docs"])

    rows = docs.select(docs[lang_col], docs[source_col], docs[text_col]).mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + kinds)), digit by digit, so longs hold it up to 10^15 occurrences; null where there is no term."""
    size, rest, out = F.nullif(total + kinds, F.lit(0)), count + 1, F.lit(0)
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, size)
        rest = rest * 1000 % size
    return out + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _corrections(rows: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``: what the terms that two sources share add to the sums of their baselines.

    ``rows``: lang and two lists ``a``, ``b`` of (source, p, p0) of one term; p0 is the share of a term that the source
    does not have. Sums are made per batch, so what leaves a task grows with pairs of sources, not with terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            sides = [(s.offsets.to_numpy(), s.flatten()) for s in (batch.column(1), batch.column(2))]
            (at, left), (bt, right) = [(o - o[0], v) for o, v in sides]
            names = pa.concat_arrays([left.field(0), right.field(0)]).dictionary_encode()
            code, kinds = names.indices.to_numpy().astype(np.int64), len(names.dictionary)
            a_code, b_code = code[: len(left)], code[len(left) :]
            (p, p0), (q, q0) = [tuple(v.field(k).to_numpy(zero_copy_only=False) for k in (1, 2)) for v in (left, right)]
            row, widths = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.diff(bt)
            ends = np.cumsum(widths[row])
            lo = 0
            while lo < len(row):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
                reps = widths[row[lo:hi]]
                x = np.repeat(np.arange(lo, hi), reps)
                y = np.arange(len(x)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(bt[row[lo:hi]], reps)
                apart = a_code[x] != b_code[y]
                x, y = x[apart], y[apart]
                f = lambda u, v: (u - v) * (u - v) // v
                value = f(p[x], q[y]) - f(p[x], q0[y]) - f(p0[x], q[y]) + f(p0[x], q0[y])
                key = (lang.indices.to_numpy().astype(np.int64)[row[x]] * kinds + a_code[x]) * kinds + b_code[y]
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                pair = key[first]
                sums = np.add.reduceat(value, first) if len(first) else value
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(pair // kinds // kinds)), names.dictionary.take(pa.array(pair // kinds % kinds)), names.dictionary.take(pa.array(pair % kinds)), pa.array(sums)], ["lang", "source", "item", "value"])
                lo = hi

    return rows.mapInArrow(tidy(run), "lang string, source string, item string, value long")


def _with_others(groups: DataFrame, others: DataFrame) -> DataFrame:
    """``groups`` joined with the ``others`` (lang, item, ...) of their language; broadcast, or spread by salts where they are many."""
    few = small(others, MOST_GROUPS)
    if few is not others:
        return groups.join(few, "lang").where("source <> item")
    salted = others.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return groups.withColumn("_salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"]).drop("_salt").where("source <> item")


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value``, ``rank`` of every (lang, source) group of ``docs``.

    A language keeps the terms that ``least_docs`` of its documents hold. Each group, and each language, gives every kept
    term a smoothed share. Part pair ranks a group's other sources of the language by how far its shares lie from
    theirs, summed over all kept terms; part term ranks the ``most_terms`` terms it has more of than its language.

    Pairs: terms that neither source has add the same each, terms of one source only add what a histogram of its counts
    tells, and only terms that both have are met pair by pair, as corrections of those two sums. Terms: radix selection.

    Null lang, source and text are empty, so such rows form a group of their own; every row is a document, repeats and
    null ids too; empty texts have no terms; a language without kept terms has pairs of value 0; an empty table gives
    no rows; ties are ranked by the bytes of the item; further columns are not read.
    """
    key = lambda c: F.coalesce(docs[c], F.lit(""))
    counts = term_counts(docs, lang_col, source_col, text_col)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held")).where(F.col("_docs") >= least_docs).drop("_docs")
    terms = stored(kept, "audit-terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("lang_total"))
    each = terms.select("lang", "term", "total", F.inline("held"))
    hist = each.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("k")).alias("own_total"), F.collect_list(F.struct("n", "k")).alias("hist"))
    every = docs.select(key(lang_col).alias("lang"), key(source_col).alias("source")).distinct()
    groups = every.join(hist, ["lang", "source"], "left").join(langs, "lang", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("own_total", "kinds", "lang_total")})
    groups = stored(groups.withColumn("p0", share(F.lit(0), F.col("own_total"), F.col("kinds"))), "audit-groups")
    base = stored(groups.drop("hist"), "audit-bases")
    told = each.join(small(base, MOST_GROUPS), ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("own_total"), F.col("kinds")), "q": share(F.col("total"), F.col("lang_total"), F.col("kinds"))})
    over = told.where("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    top = largest(over, ["lang", "source"], "value", "item", most_terms).withColumn("part", F.lit("term"))

    lists = told.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("l")).where(F.size("l") > 1)
    blocks = lists.select("lang", F.transform(F.sequence(F.lit(1), F.size("l"), F.lit(BLOCK)), lambda k: F.slice("l", k, BLOCK)).alias("l"))
    shared = _corrections(blocks.select("lang", F.explode("l").alias("a"), "l").select("lang", "a", F.explode("l").alias("b")))

    def alone(mine: Column, other: Column, flip: bool) -> Column:
        """What the terms of one source alone add, above what terms of neither would."""
        f = (lambda p: excess(other, p)) if flip else (lambda p: excess(p, other))
        return F.coalesce(F.aggregate("hist", F.lit(0).cast("long"), lambda s, x: s + x["k"] * (f(share(x["n"], F.col("own_total"), F.col("kinds"))) - f(mine))), F.lit(0))

    paired = _with_others(groups, base.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")))
    p0, q0 = F.col("p0"), F.col("q0")
    ahead = paired.select("lang", "source", "item", (alone(p0, q0, False) + F.coalesce(F.col("kinds") * excess(p0, q0), F.lit(0))).alias("value"))
    behind = paired.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), alone(p0, q0, True).alias("value"))
    pairs = shared.unionByName(ahead).unionByName(behind).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    # A group has as many rows here as its language has sources, the square root of the result.
    pairs = pairs.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))})
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*names).unionByName(top.select(*names))
