"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A signature has CHUNKS * PER_CHUNK components of 16 bits. Two signatures that differ in at most 2 * CHUNKS - 1
components differ in at most one component of some chunk (pigeonhole), so indexing every chunk once with each of its
components left out finds all pairs within that distance. A pair at the threshold of 0.8 that lies beyond it (10 is
the mean, 19 the guaranteed distance) is still found unless every chunk has two errors or more: 2 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stored, tidy
from .components import components
from .shingles import mix, sets, signatures

CHUNKS, PER_CHUNK = 10, 5
SIZE = CHUNKS * PER_CHUNK
#: Pairs of more differing components are not compared: at a similarity of 0.8 that is 5 in ten million.
FARTHEST = 24
#: Rows of an index entry that are compared with each other at once; in the sweep every block of asking rows meets the whole entry.
BLOCK = 2048
#: Bytes of sets that the asking rows of a block in the sweep may have together.
MOST_HELD = 1 << 26
#: So many ids of documents with a shared index entry are sent to every task (some 40 MB); more are joined by exchange.
MOST_BROADCAST = 1_000_000
_HASH_BYTES = 6
_MET = "key long, part int, role int, cls long, label long, n long, sign binary, asks boolean"


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sets(batch.column(1).to_pylist(), width))
            signs = signatures(found, SIZE)
            wrap = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(wrap([s.sum(dtype=np.uint64) for s in found])), pa.array(wrap([mix(s).sum(dtype=np.uint64) for s in found])), pa.array([s.tobytes() for s in signs], pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "sign"],
            )

    return run


def index_keys(signs: np.ndarray) -> np.ndarray:
    """(texts, SIZE) keys: per chunk, one for each component left out. The other four fill 64 bits, so keys of one kind are equal exactly if these are."""
    parts = signs.reshape(-1, CHUNKS, PER_CHUNK).astype(np.uint64)
    out = np.empty((len(signs), CHUNKS, PER_CHUNK), np.uint64)
    for left in range(PER_CHUNK):
        packed = np.zeros((len(signs), CHUNKS), np.uint64)
        for k in range(PER_CHUNK):
            if k != left:
                packed = packed << np.uint64(16) | parts[:, :, k]
        salt = mix(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(PER_CHUNK) + np.uint64(left + 1))
        out[:, :, left] = mix(packed ^ salt)
    return out.reshape(len(signs), SIZE)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(index_keys(signs).reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), SIZE))], ["key", "cls"])


def _central(cls: np.ndarray, label: np.ndarray, n: np.ndarray, signs: np.ndarray, percent: int) -> np.ndarray:
    """(class, distance, centre) of the rows near the central row (of least distance to 32 rows spread over all) but of another component."""
    some = signs[np.unique(np.linspace(0, len(cls) - 1, 32).astype(int))]
    centre = sum((signs != x).sum(axis=1) for x in some).argmin()
    far = (signs != signs[centre]).sum(axis=1)
    fit = (label != label[centre]) & (far <= FARTHEST) & (100 * np.minimum(n, n[centre]) >= percent * np.maximum(n, n[centre]))
    return np.stack([cls[fit], far[fit], np.full(fit.sum(), cls[centre])])


def _propose(percent: int):
    """Rows sorted by key: what :func:`_central` says of each index entry, BLOCK rows at a time; never more rows than came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, key, out = [], 0, None, []

        def ended() -> None:
            if count > 1:
                out.append(_central(*(np.concatenate([h[k] for h in held]) for k in range(4)), percent))

        def made() -> pa.RecordBatch:
            every = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in every], ["cls", "far", "centre"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, cls, label, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            signs = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16).reshape(-1, SIZE)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[a] != key:
                    ended()
                    held, count, key = [], 0, keys[a]
                for s in range(a, b, BLOCK):
                    e = min(b, s + BLOCK)
                    held.append((cls[s:e], label[s:e], n[s:e], signs[s:e]))
                    count += e - s
                    if count >= BLOCK:
                        ended()
                        held, count = [], 0
            if len(out) > 256:
                yield made()
                out = []
        ended()
        yield made()

    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SIZE) for k in ("sign_a", "sign_b"))
        yield batch.select(["a", "b"]).filter(pa.array((a != b).sum(axis=1) <= FARTHEST))


def _shrunk(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.ascontiguousarray(np.sort(s & np.uint64((1 << 8 * _HASH_BYTES) - 1)).view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]).tobytes() for s in sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["cls", "set"])

    return run


def _wide(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // _HASH_BYTES, 8), np.uint8)
    out[:, :_HASH_BYTES] = np.frombuffer(x, np.uint8).reshape(-1, _HASH_BYTES)
    return out.reshape(-1).view(np.uint64)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = _wide(x), _wide(y)
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                yes.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return run


def _open_pairs(key: int, asks: tuple[np.ndarray, ...], others: tuple[np.ndarray, ...], percent: int) -> np.ndarray:
    """(asking rows, other rows) of entry ``key``: pairs to be compared here. Rows are (cls, label, n, sign, asks).

    These are of different components, near enough in size and signature, and share no earlier entry. Of two rows that
    ask the one of the smaller class does.
    """
    (cls, label, n, signs, _), (cls_b, label_b, n_b, signs_b, asks_b) = asks, others
    chunk, left = divmod(int((index_keys(signs[:1])[0].view(np.int64) == key).argmax()), PER_CHUNK)
    out = (label[:, None] != label_b) & ((cls[:, None] < cls_b) | ~asks_b) & (100 * np.minimum(n[:, None], n_b) >= percent * np.maximum(n[:, None], n_b))
    far = np.zeros(out.shape, np.uint8)
    for c in range(CHUNKS if out.any() else 0):
        part = np.zeros(out.shape, np.uint8)
        for k in range(c * PER_CHUNK, (c + 1) * PER_CHUNK):
            part += signs[:, k][:, None] != signs_b[:, k]
        if c < chunk:
            out &= part > 1
        elif c == chunk and left:
            out &= part > 0
        far += part
    return out & (far <= FARTHEST)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch, tuple[np.ndarray, ...]]]:
    """(key, whether a group begins, rows, their columns) of rows sorted by group and role: a group's asking rows at once, then its others batch by batch."""
    at, held, begins = None, [], False

    def columns(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        signs = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint16).reshape(-1, SIZE)
        return *(rows.column(k).to_numpy(zero_copy_only=False) for k in ("cls", "label", "n")), signs, rows.column("asks").to_numpy(zero_copy_only=False)

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.array([batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "part", "role")])
        cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key, part, role = group[:, a].tolist()
            if (key, part) != at:
                at, held = (key, part), []
            rows = batch.slice(a, b - a)
            if not role:
                held.append(rows)
                begins = True
            elif held:
                if begins:
                    rows_held = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield key, True, rows_held, columns(rows_held)
                    begins = False
                yield key, False, rows, columns(rows)


def _needed(percent: int):
    """Of the rows of open entries those with a pair to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, asking, use = [], None, None
        for key, begins, rows, cols in _met(batches):
            if begins:
                if asking is not None and use.any():
                    out.append(asking.filter(pa.array(use)))
                asking, mine, use = rows, cols, np.zeros(rows.num_rows, bool)
            else:
                pairs = _open_pairs(key, mine, cols, percent)
                if pairs.any():
                    use |= pairs.any(axis=1)
                    out.append(rows.filter(pa.array(pairs.any(axis=0))))
            if len(out) > 256:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if asking is not None and use.any():
            out.append(asking.filter(pa.array(use)))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _swept(percent: int):
    """Links among all pairs of these rows that are to be compared, on the full sets; per group as many as join its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for key, begins, rows, cols in _met(batches):
            sets_ = [_wide(x) for x in rows.column("set").to_pylist()]
            if begins:
                mine, size, root = cols, np.array([len(x) for x in sets_]), {}
                known, place = np.unique(np.concatenate(sets_), return_inverse=True)
                ids = np.split(place, np.cumsum(size)[:-1])
                mark = np.zeros(len(known), bool)
                continue

            def top(x: int, root: dict[int, int]) -> int:
                while x in root:
                    x = root[x]
                return x

            pairs = _open_pairs(key, mine, cols, percent)
            for j in np.flatnonzero(pairs.any(axis=0)).tolist():
                who, x = np.flatnonzero(pairs[:, j]), sets_[j]
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                at = at[known[at] == x]
                mark[at] = True
                common = np.add.reduceat(mark[np.concatenate([ids[k] for k in who])], np.cumsum([0, *size[who][:-1]]), dtype=np.int64)
                mark[at] = False
                for k in who[100 * common >= percent * (size[who] + len(x) - common)].tolist():
                    a, b = top(int(mine[1][k]), root), top(int(cols[1][j]), root)
                    if a != b:
                        root[a] = b
                        found.append((int(mine[0][k]), int(cols[0][j])))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept`` (that is the row itself).

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets (``percent`` from 80 on).
    Texts with one and the same set form a class, and one document stands for it, so copies never meet in pairs. Two
    rounds join most copies cheaply, with one pair per class each: the smallest class it shares an index entry with,
    then the nearest of its open entries' central classes; links are confirmed on the full sets. A sweep then settles
    the rest: every pair of an entry that is still of different components and within FARTHEST is compared on the full
    sets, inside a task, where the sets of such classes are sent; no pair becomes a row and none is left out.

    Null or empty texts have no shingles and are linked with nothing. Rows with a null id are answered but linked with
    nothing (``component_id`` null, ``kept`` true). Rows that repeat an id count as one document, linked by whatever
    any of its texts links. An empty table gives an empty result; further columns are not read.
    """
    spark = prepare(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    feats = stored(rows.mapInArrow(tidy(_features(width)), "doc_id long, n_shingles long, set_a long, set_b long, sign binary"), "near-features")
    same = ["n_shingles", "set_a", "set_b"]
    full = feats.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy(*same).agg(F.min(F.struct("doc_id", "sign")).alias("_m")).select(F.col("_m.doc_id").alias("cls"), *same, F.col("_m.sign").alias("sign")), "near-classes")

    keys = classes.select("cls", "sign").mapInArrow(tidy(_keys), "key long, cls long")
    entries = keys.groupBy("key").agg(F.min("cls").alias("first"), F.count("*").alias("_n")).where("_n > 1").select("key", "first")
    entries = stored(keys.join(entries, "key"), "near-entries")
    one = stored(classes.select("cls", F.col("n_shingles").alias("n"), "sign").join(entries.select("cls").distinct(), "cls", "left_semi"), "near-members")

    def meeting(rows: DataFrame) -> DataFrame:
        """Rows of open entries by group: those outside the entry's commonest component ask (role 0), all rows answer (role 1).

        The asking rows of an entry are dealt over parts of some BLOCK rows, and every part meets all rows of the entry.
        """
        per = rows.groupBy("key", "label").agg(F.count("*").alias("_n"), F.sum("n").alias("_size"))
        most = F.struct("_n", "label")
        asking = F.sum("_n") - F.max_by("_n", most), F.sum("_size") - F.max_by("_size", most)
        parts = per.groupBy("key").agg(F.max_by("label", most).alias("_most"), F.ceil(F.greatest(asking[0] / BLOCK, asking[1] * _HASH_BYTES / MOST_HELD)).cast("int").alias("_parts"))
        known = rows.join(parts, "key").withColumn("asks", F.col("label") != F.col("_most"))
        own = F.struct(F.lit(0).alias("role"), F.expr("cast(pmod(xxhash64(cls), _parts) as int)").alias("part"))
        every = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda p: F.struct(F.lit(1).alias("role"), p.alias("part")))
        met = known.withColumn("_place", F.explode(F.when(F.col("asks"), F.concat(F.array(own), every)).otherwise(every))).select("*", "_place.role", "_place.part")
        return met.selectExpr(*(c.split()[0] for c in _MET.split(", ")))

    def side(x: str) -> DataFrame:
        return one.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sign").alias(f"sign_{x}"))

    ids = one.select(F.col("cls").alias("doc_id"))
    ids = F.broadcast(ids) if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else ids
    full_sets = stored(rows.join(ids, "doc_id", "left_semi").mapInArrow(tidy(_shrunk(width)), "cls long, set binary"), "near-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        close = stored(sized.select("a", "b", "sign_a", "sign_b").mapInArrow(tidy(_close), "a long, b long"), "near-pairs")
        left = close.join(full_sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a")
        both = left.join(full_sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b")
        found = stored(both.select("a", "b", "set_a", "set_b").mapInArrow(tidy(_linked(percent)), "a long, b long"), "near-links")
        discard(close)
        return found

    def still_open(labels: DataFrame) -> DataFrame:
        labelled = entries.join(labels.withColumnRenamed("id", "cls"), "cls", "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
        mixed = labelled.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("key")
        return labelled.join(mixed, "key", "left_semi").join(one, "cls").select("key", "cls", "label", "n", "sign")

    firsts = entries.groupBy(F.col("cls").alias("b")).agg(F.min("first").alias("a")).where("a < b").select("a", "b")
    links = confirmed(firsts)
    dealt = still_open(components(links)).repartition(partitions, "key").sortWithinPartitions("key", F.xxhash64("cls")).select("key", "cls", "label", "n", "sign")
    central = dealt.mapInArrow(tidy(_propose(percent)), "cls long, far long, centre long").groupBy("cls").agg(F.min(F.struct("far", "centre")).alias("_m"))
    more = confirmed(central.select(F.least("cls", "_m.centre").alias("a"), F.greatest("cls", "_m.centre").alias("b")).distinct())
    if not more.isEmpty():
        links = links.unionByName(more)
    labels = components(links)
    whole = f"{_MET}, set binary"
    needed = meeting(still_open(labels)).repartition(partitions, "key", "part").sortWithinPartitions("key", "part", "role").mapInArrow(tidy(_needed(percent)), _MET)
    needed = needed.join(full_sets, "cls").selectExpr(*(c.split()[0] for c in whole.split(", ")))
    swept = stored(needed.repartition(partitions, "key", "part").sortWithinPartitions("key", "part", "role").mapInArrow(tidy(_swept(percent)), "a long, b long"), "near-links")
    if not swept.isEmpty():
        labels = components(links.unionByName(swept))
    discard(entries, one, full_sets)
    member = feats.join(classes.select(*same, "cls"), same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("cls", "doc_id")).alias("cls"))
    found = member.join(labels.withColumnRenamed("id", "cls"), "cls", "left")
    component = F.coalesce("label", "cls")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that a document with a smaller id stands for."""
    dropped = near_duplicates(docs, width, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_dropped"))
    return docs.join(dropped, docs[id_col] == dropped["_dropped"], "left_anti")
