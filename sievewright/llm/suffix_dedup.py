"""Suffix-array dedup: bytes covered by strings that an earlier document holds too, by threshold-bounded interval expansion.

Every LEAST-byte string is assigned to the smallest hash among its GRAM-byte strings, so equal strings have equal
keys, and neighbouring strings mostly share one. Keys that stand in a single document only are sifted out first; the
rest send their stretch of text (a window of some 65 bytes for 16 strings) to their key's bucket. There the windows'
Burrows-Wheeler transform gives the groups of equal LEAST-byte strings exactly.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import collection, prefix_boundaries, suffix_array
from .common import prepare, tidy, unused
from .files import task_number

LEAST, GRAM, RUN = 50, 20, 64
_U = np.uint64
_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SEEN = 1 << 19  # keys known to repeat that a task remembers, eight bytes each; what it forgets is asked for again
_PORTION, _SLAB, _BLOCK = 3 << 20, 1 << 17, 1 << 17  # slabs and blocks whose arrays stay in a core's cache


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _keys(data: np.ndarray) -> np.ndarray:
    """Key of the LEAST-byte string that starts at each place of ``data``."""
    a, b, c, d, e = (_U(0x9E3779B97F4A7C15 + 2 * k * 0x1234567) for k in range(5))
    h1 = _TABLE[data]
    h2 = h1[:-1] * a + h1[1:]
    h4 = h2[:-2] * b + h2[2:]
    h8 = h4[:-4] * c + h4[4:]
    h16 = h8[:-8] * d + h8[8:]
    m = _mixed(h16[: len(h4) - 16] * e + h4[16:])
    for step in (1, 2, 4, 8, 15):
        m = np.minimum(m[:-step], m[step:])
    return m


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, length, key) of each run of at most RUN places with one key, in blocks; a text's runs tell all its LEAST-byte strings."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < _BLOCK):
            size += len(texts[end])
            end += 1
        # A text too long for a block goes through it in pieces that overlap.
        reach = 1 << 20
        pieces = [(k, s, texts[k][s : s + reach + LEAST - 1]) for k in range(at, end) for s in range(0, max(1, len(texts[k]) - LEAST + 1), reach)]
        for group in [pieces] if end - at > 1 else [[p] for p in pieces]:
            data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
            if len(data) < LEAST:
                continue
            lengths = np.array([len(p) for _, _, p in group])
            firsts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(group)), lengths)
            place = np.flatnonzero(np.arange(len(data)) + LEAST <= (firsts + lengths)[owner])
            if not len(place):
                continue
            key, own = _keys(data)[place], owner[place]
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
            run = np.diff(np.concatenate([cut, [len(place)]]))
            parts = -(-run // RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, length = np.repeat(cut, parts) + nth * RUN, np.minimum(RUN, np.repeat(run, parts) - nth * RUN)
            which = own[begin]
            yield np.array([k for k, _, _ in group])[which], place[begin] - firsts[which] + np.array([s for _, s, _ in group])[which], length, key[begin]
        at = end


def _portions(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True):
            held.append(row)
            size += len(row[1] or "")
            if size >= _PORTION or len(held) == 60_000:
                yield held
                held, size = [], 0
    if held:
        yield held


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _short(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


_SIFT = "bucket int, known boolean, ids binary, idx binary, keys binary"


def _among(held: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of ``key`` stand in ``held`` (sorted)."""
    if not len(held):
        return np.zeros(len(key), bool)
    return held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key


def _sift(buckets: int):
    """Keys to ask for, per portion and bucket, each with its document of smallest id; and the documents of keys known to repeat, marked so, in buckets below 0.

    A key that repeats within a portion is known for all its documents, and for those of the task's later portions, so
    a task asks for it once, however many documents have it; what is known needs no bucket and is dealt evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, turn = np.zeros(0, np.uint64), task_number()
        for rows in _portions(batches, 2):
            rows.sort(key=lambda r: r[0])  # so that a stable sort by key leaves documents in the order of their ids
            ids = np.array([r[0] for r in rows], np.int64)
            every = list(segments([_bytes(r[1]) for r in rows]))
            if not every:
                continue
            doc, key = np.concatenate([e[0] for e in every]), np.concatenate([e[3] for e in every])
            order = np.argsort(key, kind="stable")
            doc, key = doc[order], key[order]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[doc[1:]] != ids[doc[:-1]])])
            doc, key = doc[fresh], key[fresh]  # each key once per document
            head = np.concatenate([[True], key[1:] != key[:-1]])
            several, told = np.concatenate([key[1:] == key[:-1], [False]]) & head, _among(seen, key)
            made = []
            known = ~head | several | told
            turn += 1
            if known.any():
                used, idx = np.unique(doc[known], return_inverse=True)
                made.append((-1 - turn % buckets, True, ids[used].tobytes(), idx.astype(np.uint16).tobytes(), _short(key[known])))
            # The first of a repeated key is asked for as well: it stands for its task.
            own, k = doc[head & ~told], key[head & ~told]
            bucket = (k >> _U(40)).astype(np.int64) % buckets
            by = np.argsort(bucket, kind="stable")
            if len(by):
                cuts = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1]]))
                for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
                    part = by[a:b]
                    used, idx = np.unique(own[part], return_inverse=True)
                    made.append((int(bucket[part[0]]), False, ids[used].tobytes(), idx.astype(np.uint16).tobytes(), _short(k[part])))
            new = key[several & ~told]
            seen = np.unique(np.concatenate([seen, new])) if len(seen) + len(new) <= _SEEN else np.sort(new)[:_SEEN]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["bucket", "known", "ids", "idx", "keys"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    held, bucket = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket and held:
                yield bucket, held
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield bucket, held


def _by_document(doc: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    doc, key = doc[order], key[order]
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    yield pa.RecordBatch.from_arrays([pa.array(doc[cuts], pa.int64()), pa.array([_short(key[a:b]) for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True)], pa.binary())], ["doc_id", "keys"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the keys that stand in another document too: those that are known as they come, others if their bucket has them twice."""

    def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["idx"], np.uint16)], _long(r["keys"])

    asked, at = [], None

    def settled() -> Iterator[pa.RecordBatch]:
        if asked:
            doc, mine = map(np.concatenate, zip(*asked, strict=True))
            order = np.argsort(mine, kind="stable")
            mine, doc = mine[order], doc[order]
            twice = np.concatenate([[False], mine[1:] == mine[:-1]])
            twice[:-1] |= twice[1:]
            yield from _by_document(doc[twice], mine[twice])

    for batch in batches:
        for r in batch.to_pylist():
            if r["known"]:
                yield from _by_document(*unpacked(r))
                continue
            if r["bucket"] != at:
                yield from settled()
                asked.clear()
            at = r["bucket"]
            asked.append(unpacked(r))
    yield from settled()


_WINDOWS = "bucket int, ids binary, starts binary, lengths binary, bytes binary"


def _windows(buckets: int):
    """The stretches of repeated keys, per portion and bucket; of equal stretches of a portion, the smallest document's and, marked whole (bucket -1), those of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _portions(batches, 3):
            texts = [_bytes(r[1]) for r in rows]
            wanted = [np.unique(np.concatenate([_long(k) for k in r[2]])) for r in rows]
            best: dict[bytes, list] = {}
            marked: dict[int, list] = defaultdict(list)
            for doc, start, length, key in segments(texts):
                low, cuts = key & _U((1 << 40) - 1), np.searchsorted(doc, np.unique(doc))
                keep = np.zeros(len(doc), bool)
                for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
                    w = wanted[doc[a]]
                    near = np.minimum(np.searchsorted(w, low[a:b]), len(w) - 1)
                    keep[a:b] = w[near] == low[a:b]
                home = ((key >> _U(40)).astype(np.int64) % buckets).tolist()
                for j in np.flatnonzero(keep).tolist():
                    s, n, i = int(start[j]), int(length[j]), rows[doc[j]][0]
                    window = texts[doc[j]][s : s + n + LEAST - 1]
                    held = best.get(window)
                    if held is None:
                        best[window] = [i, [s], home[j]]
                    elif held[0] == i:
                        held[1].append(s)
                    elif held[0] < i:
                        marked[i].append((s, n))
                    else:
                        marked[held[0]] += [(x, n) for x in held[1]]
                        held[:2] = i, [s]
            by: dict[int, list] = defaultdict(list)
            for window, (i, starts, bucket) in best.items():
                by[bucket] += [(i, s, len(window), window) for s in starts]
            made = [(bucket, np.array([x[0] for x in v], np.int64).tobytes(), np.array([x[1] for x in v], np.int64).tobytes(), np.array([x[2] for x in v], np.uint16).tobytes(), b"".join(x[3] for x in v)) for bucket, v in by.items()]
            made += [(-1 - i % buckets, np.full(len(v), i, np.int64).tobytes(), np.array([x[0] for x in v], np.int64).tobytes(), np.array([x[1] for x in v], np.uint16).tobytes(), b"") for i, v in marked.items()]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["bucket", "ids", "starts", "lengths", "bytes"])

    return run


def repeated_places(windows: list[bytes], docs: list[int]) -> list[np.ndarray]:
    """Per window the offsets whose LEAST-byte string also stands in a window of a smaller document (``docs``: smallest document of each)."""
    text, window = collection(windows)
    order = suffix_array(text, window, LEAST)
    new = prefix_boundaries(text, window, order, LEAST)
    group = np.cumsum(new) - 1
    doc = np.array(docs)[window[order]]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))
    hit = order[doc > least[group]]
    hit.sort()
    begin = np.cumsum([0, *(len(w) + 1 for w in windows)])
    cuts = np.searchsorted(hit, begin)
    return [hit[cuts[k] : cuts[k + 1]] - begin[k] for k in range(len(windows))]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places to remove per document: (first place, number of places) pairs."""
    for bucket, rows in _by_bucket(batches):
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        held: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for r in rows:
            ids, starts, lengths = np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["starts"], np.int64).tolist(), np.frombuffer(r["lengths"], np.uint16).tolist()
            at = 0
            for i, s, n in zip(ids, starts, lengths, strict=True):
                if bucket < 0:
                    out[i].append((s, n))
                else:
                    held[r["bytes"][at : at + n]].append((i, s))
                    at += n
        slab, size = [], 0

        def resolve() -> None:
            firsts = [min(i for i, _ in held[w]) for w in slab]
            for w, first, places in zip(slab, firsts, repeated_places(slab, firsts), strict=True):
                runs = []
                if len(places):
                    cut = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1] + 1]))
                    runs = list(zip(places[cut].tolist(), np.diff(np.concatenate([cut, [len(places)]])).tolist(), strict=True))
                for i, s in held[w]:
                    out[i] += [(s, len(w) - LEAST + 1)] if i > first else [(s + a, n) for a, n in runs]
            slab.clear()

        # Windows are resolved in slabs of whole keys: equal strings have equal keys.
        if held:
            names = list(held)
            keys = np.empty(len(names), np.uint64)
            for k in range(0, len(names), 10_000):
                part = names[k : k + 10_000]
                begin = np.cumsum([0, *map(len, part[:-1])])
                keys[k : k + len(part)] = _keys(np.frombuffer(b"".join(part), np.uint8))[begin]
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
            low = np.minimum.reduceat(np.array([min(i for i, _ in held[w]) for w in names])[order], first)
            high = np.maximum.reduceat(np.array([max(i for i, _ in held[w]) for w in names])[order], first)
            # A key whose other documents were copies of whole texts is left with one document: nothing can repeat.
            order = order[np.repeat(low < high, np.diff(np.concatenate([first, [len(order)]])))].tolist()
            for a, k in enumerate(order):
                if size >= _SLAB and keys[k] != keys[order[a - 1]]:
                    resolve()
                    size = 0
                slab.append(names[k])
                size += len(names[k])
            if slab:
                resolve()
        found = [(i, np.array(v, np.int64).tobytes()) for i, v in out.items() if v]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["doc_id", "runs"])


def removed_spans(runs: list[bytes]) -> list[tuple[int, int]]:
    """Maximal (start, end) runs of bytes that LEAST-byte strings at the given places cover."""
    pairs = np.concatenate([np.frombuffer(r, np.int64).reshape(-1, 2) for r in runs])
    start, end = pairs[:, 0], pairs[:, 0] + pairs[:, 1] + LEAST - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[first].tolist(), end[np.concatenate([first[1:] - 1, [len(start) - 1]])].tolist(), strict=True))


def _outcomes(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes], list[list]]]:
    """Batches (text in column ``at``, runs and whole in the last two) with the bytes before, the bytes that stay and the spans."""
    for batch in batches:
        raws, stay, cut = [], [], []
        for text, runs, whole in zip(*(batch.column(k).to_pylist() for k in (at, batch.num_columns - 2, batch.num_columns - 1)), strict=True):
            raw = _bytes(text)
            spans = [(0, len(raw))] if whole else removed_spans(runs) if runs else []
            raws.append(raw)
            cut.append(spans)
            stay.append(b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True)))
        yield batch, raws, stay, cut


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raws, stay, cut in _outcomes(batches, 1):
        rows = [(len(r), len(r) - len(k), len(c), hashlib.sha256(k).hexdigest(), k) for r, k, c in zip(raws, stay, cut, strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text``; without a renaming projection where none is needed, so that both joins share one exchange of the texts."""
    if (id_col, text_col, docs.schema[id_col].dataType.simpleString()) == ("doc_id", "text", "bigint"):
        return docs.select("doc_id", "text")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def _judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, runs) and (doc_id, whole) of ``rows`` (doc_id not null, text, further columns)."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions
    digests = rows.where(F.octet_length("text") >= LEAST).select("doc_id", F.md5("text").alias("_md5"), F.octet_length("text").alias("_n"))
    firsts = digests.groupBy("_md5", "_n").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_c")).where("_c > 1").select("_md5", "_n", "_first")
    copies = digests.join(firsts, ["_md5", "_n"]).where("doc_id > _first").select("doc_id", F.lit(True).alias("whole")).distinct()
    sifted = rows.select("doc_id", "text").mapInArrow(tidy(_sift(buckets)), _SIFT).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    keys = sifted.mapInArrow(tidy(_repeated), "doc_id long, keys binary").groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
    asked = keys.join(copies.select("doc_id"), "doc_id", "left_anti")
    windows = rows.join(asked, "doc_id").select("doc_id", "text", "keys").mapInArrow(tidy(_windows(buckets)), _WINDOWS)
    expanded = windows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_expand), "doc_id long, runs binary")
    return expanded.groupBy("doc_id").agg(F.collect_list("runs").alias("runs")), copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the bytes that stay).

    A byte is removed if a string of LEAST bytes that covers it also starts in a document with a smaller id; strings
    are judged on the input and never cross documents. Copies of a whole text are told by digest and removed but for
    the smallest id, so they send no windows. Within a task, documents that share a stretch send it once. Null text
    counts as empty, texts under LEAST bytes stay as they are. Rows with a null id are neither changed nor compared;
    rows that repeat an id are no source for each other, and what one of them loses at a place the others lose there too.
    """
    prepare(docs.sparkSession)
    every = _narrow(docs, id_col, text_col)
    rows = every.where("doc_id is not null")
    runs, copies = _judged(rows)
    told = rows.join(runs, "doc_id", "left").join(copies, "doc_id", "left").select("doc_id", "text", "runs", F.coalesce("whole", F.lit(False)).alias("whole"))
    loose = every.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("runs"), F.lit(False).alias("whole"))
    return told.unionByName(loose).mapInArrow(tidy(_finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def trimmed(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with ``text`` less its removed bytes and ``n_chars``, if there is one, to match.

    Where a cut falls inside a character its other bytes go too. Texts that lose nothing stay as they are, null included.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    rows = docs.where("doc_id is not null")
    runs, copies = _judged(_narrow(rows, "doc_id", "text"))
    doc, found, copy, all_ = unused(docs, "_doc", "_runs", "_copy", "_whole")
    runs, copies = runs.select(F.col("doc_id").alias(doc), F.col("runs").alias(found)), copies.select(F.col("doc_id").alias(copy), F.col("whole").alias(all_))
    told = rows.join(runs, rows["doc_id"] == runs[doc], "left").join(copies, rows["doc_id"] == copies[copy], "left").select(*(rows[n] for n in names), found, F.coalesce(all_, F.lit(False)).alias(all_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, stay, cut in _outcomes(batches, at):
            old = batch.column(at).to_pylist()
            texts = [k.decode("utf-8", "ignore") if c else t for t, k, c in zip(old, stay, cut, strict=True)]
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) if c and t is not None else n for t, c, n in zip(texts, cut, columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return told.mapInArrow(tidy(run), docs.schema).unionByName(docs.where("doc_id is null"))
