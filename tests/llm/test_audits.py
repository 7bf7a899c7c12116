"""The audits of sources and filters and packing along a curve against brute force on small tables with every odd case."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import curve_packing, filter_audit, radix_select, source_audit

public = pytest.importorskip("public_tokenizers")

#: Clashing names that operators use inside.
DDL = "doc_id long, text string, lang string, source string, n_chars long, term string, item string, n long, total long, part string, E boolean, _sha string, key long, ids string, width int, value long, rank int, p double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, *[None] * 14) for i, t, lang, source in rows], DDL)


def rows_of(seed, n=160):
    """Documents of three languages (one null, one with too few documents) and sources, with repeats, ties and odd texts."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 7))) for _ in range(80)] + ["Été", "É", "straße", "日本語", "a1b", "x$y", "ABC", "q" * 9]
    out = []
    for k in range(n):
        lang = ("en", "de", None, "rare")[min(3, k % 3 + (k == 5))]
        source = (None, "", "s1", "s2", "é", "zz")[rng.integers(0, 6)]
        size = int(rng.choice([0, 1, 3, 40, 260, 700]))
        out.append((k, " ".join(rng.choice(words, size)) if size else None if k % 2 else "", lang, source))
    out += [(0, *out[7][1:]), out[7], (None, *out[7][1:]), (None, None, None, None), (900, out[7][1], "de", "only"), (901, "!! 12 \x7f", "en", "no terms"), (902, "long " * 260_000 + "Tail", "en", "s1")]
    return out


def audited(rows, least, most):
    own, total, seen, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    lower = {k: k + 32 for k in range(65, 91)}
    for _, text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        own[g].update(found)
        total[g[0]].update(found)
        seen[g[0]].update(set(found))
    out = set()
    for g in groups:
        kept = [t for t, n in seen[g[0]].items() if n >= least]
        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}
        p = shares(own[g])
        pairs = []
        for h in groups:
            if h != g and h[0] == g[0]:
                q = shares(own[h])
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), h[1].encode(), h[1]))
        out |= {(*g, "pair", h, -v, k + 1) for k, (v, _, h) in enumerate(sorted(pairs))}
        q = shares(total[g[0]])
        terms = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if own[g][t] > 0 and p[t] > q[t])
        out |= {(*g, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:most])}
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_divergence(spark, monkeypatch, block):
    """Whole lists of sources, and lists that are cut into blocks; both ways of joining groups."""
    monkeypatch.setattr(source_audit, "BLOCK", block)
    if block == 2:
        monkeypatch.setattr(source_audit, "MOST_GROUPS", 0)
        monkeypatch.setattr(source_audit, "PAIRS", 7)
    rows = rows_of(1)
    got = [tuple(r) for r in source_audit.divergence(docs(spark, rows), most_terms=20).collect()]
    assert set(got) == audited(rows, 3, 20) and len(got) == len(set(got))
    assert source_audit.divergence(docs(spark, [])).count() == 0


def test_divergence_without_terms(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "one two", "en", None), (4, None, None, None)]
    assert {tuple(r) for r in source_audit.divergence(docs(spark, rows)).collect()} == audited(rows, 3, 200) and len(audited(rows, 3, 200)) == 6


def test_shares_are_exact_for_large_counts(spark):
    rows = [(c, t, v) for c in (0, 1, 10**9, 3 * 10**14) for t in (10**9, 3 * 10**14) for v in (1, 12345) if c <= t]
    got = spark.createDataFrame(rows, "c long, t long, v long").select("c", "t", "v", source_audit.share(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.t + r.v) for r in got)


@pytest.mark.parametrize(("few", "bits", "most"), [(1024, 10, 5), (2, 2, 5), (0, 10, 30), (0, 3, 1)])
def test_radix_selection(spark, monkeypatch, few, bits, most):
    """Ties that only bytes tell apart, prefixes of each other, a hot group, null keys, few cells a round."""
    monkeypatch.setattr(radix_select, "FEW", few)
    monkeypatch.setattr(radix_select, "BITS", bits)
    rng = np.random.default_rng(few + bits)
    rows = [("hot", f"t{'x' * int(n % 7)}{n}", int(v)) for n, v in enumerate(rng.choice([0, 1, 7, 7, 7, 2**40, 2**59 + 5], 900))]
    rows += [(None, c, 3) for c in ("", "a", "aa", "aaa", "aaaa", "é", "日", "ab", "z")] + [("one", "only", 0), ("same", "r", 5), ("same", "r", 5), ("same", "r", 5)]
    got = radix_select.largest(spark.createDataFrame(rows, "g string, item string, value long"), ["g"], "value", "item", most).collect()
    want = []
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] or "", -r[2], r[1].encode())), key=lambda r: r[0]):
        want += [(*r, k + 1) for k, r in enumerate(group) if k < most]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def interactions(rows, labels):
    first, good, toxic = {}, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = collections.defaultdict(list)
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        parts[lang or ""].append(({x for x in fails if fails[x]}, i in good, i in toxic))
    out, removals = {}, collections.Counter()
    for part, held in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = held
            for k, x in enumerate(order):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removals[part, x] += len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), sum(x in d[0] for d in held) - len(gone), sum(d[0] == {x} for d in held), sum(d[1] for d in gone), sum(d[2] for d in gone))
    return {(*key, *v, removals[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


@pytest.mark.parametrize("most", [filter_audit.MOST_BROADCAST, 0])
def test_filter_audit(spark, monkeypatch, most):
    monkeypatch.setattr(filter_audit, "MOST_BROADCAST", most)
    rows = rows_of(2)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 160, 2)] + [(7, 0, 0), (7, 1, None), (None, 1, 1), (5000, 1, 1), (9, None, 1)]
    found = filter_audit.filter_audit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in found.collect()]
    assert set(got) == interactions(rows, labels) and len(got) == 600 * len({r[2] or "" for r in rows})


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs(spark, []), labels).count() == 0
    got = filter_audit.filter_audit(docs(spark, [(None, None, None, None)]), labels).collect()
    assert {tuple(r) for r in got} == interactions([(None, None, None, None)], [])


def test_hilbert_curve():
    """Every cell once, and neighbours along the curve differ by one step on one axis."""
    for axes, depth in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << depth), repeat=axes)))
        keys = curve_packing.hilbert_keys(cells, depth)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("capacity", [2048, 16])
def test_curve_packing(spark, capacity):
    from tokenizers import Tokenizer

    path, rows = public.path("byte_bpe_50k.json"), rows_of(3)
    pieces = curve_packing.pack_along_curve(docs(spark, rows), path, capacity, ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t, *_ in rows)
    sequences = collections.defaultdict(list)
    for r in pieces:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        sequences[r.sequence_id].append(r)
    # Documents put together again from their pieces; rows that repeat an id lie one behind the other on the curve.
    found, open_ = collections.Counter(), {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            open_[r.doc_id] = b""
        assert len(open_[r.doc_id]) == 4 * r.start
        open_[r.doc_id] += bytes(r.ids)
        if len(open_[r.doc_id]) == 4 * r.doc_tokens:
            found[r.doc_id, open_.pop(r.doc_id)] += 1
    assert not open_ and found == want
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
    tokens = sum(len(x) // 4 * n for (_, x), n in want.items())
    assert len(sequences) <= tokens // capacity + 8 * capacity.bit_length()
    assert curve_packing.pack_along_curve(docs(spark, []), path).count() == 0


def test_neighbours_on_the_curve_are_alike(spark):
    """Texts of two vocabularies, dealt at random, come apart along the curve."""
    rng = np.random.default_rng(4)
    words = [[f"{v}{k}" for k in range(60)] for v in ("alpha", "beta")]
    rows = [(k, " ".join(rng.choice(words[k % 2], 150)), None, None) for k in range(400)]
    got = [r.doc_id % 2 for r in curve_packing.curve_keys(docs(spark, rows), public.path("byte_bpe_50k.json"), 1).orderBy("key").select("doc_id").collect()]
    assert sum(a != b for a, b in itertools.pairwise(got)) < 100
    copies = docs(spark, [(k, "the same text", None, None) for k in range(5)])
    assert copies.transform(lambda d: curve_packing.curve_keys(d, public.path("byte_bpe_50k.json"), 1)).select("key").distinct().count() == 1
