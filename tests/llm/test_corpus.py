"""The corpus operators against brute force on small tables with every odd case."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import bpe_transducer, bwt, components, exact_dedup, histogram_shards, mil_quality, mjpeg_avi, near_dedup, packing, shingles, suffix_dedup, warc, wavelet_shards

public = pytest.importorskip("public_tokenizers")

#: Clashing names that operators use inside.
DDL = "doc_id long, text string, lang string, source string, n_chars long, _hash long, cls long, kept string, label string, _len int, whole string, keys string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], DDL)


def odd_texts():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    base, passage = prose(120), prose(30)
    near = base.split()
    rows = [None, "", "", " \n\t", "one", "two words", base, base, base.upper(), prose(90) + " " + passage + "\n" + prose(40), passage + prose(60), prose(50) + passage, "日本語のテキスト" * 30, "日本語のテキスト" * 30, "é" * 200, "x" * 5000, "x" * 4000, base[:200], prose(3000)]
    for k in (1, 3, 6, 9, 15):
        changed = list(near)
        for j in range(k):
            changed[7 * j] = f"new{k}x{j}"
        rows.append(" ".join(changed))
    return list(enumerate(rows)) + [(None, base), (None, None), (6, base)]


@pytest.fixture(scope="module")
def odd(spark):
    return odd_texts()


def test_exact_dedup(spark, odd, monkeypatch):
    got = exact_dedup.exact_dedup(docs(spark, odd)).collect()
    groups = collections.defaultdict(list)
    for i, t in odd:
        groups[t or ""].append(i)
    want = collections.Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    for most in (exact_dedup.MOST_BROADCAST, 0):  # both ways: broadcast and exchanged
        monkeypatch.setattr(exact_dedup, "MOST_BROADCAST", most)
        kept = exact_dedup.keep_unique(docs(spark, odd))
        assert kept.columns == docs(spark, []).columns
        assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter((i, t) for i, t in odd if i == max((x for x in groups[t or ""] if x is not None), default=None))
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs(spark, odd)).collect()) == want


def test_only_survivors_are_hashed(spark):
    """The whole-text hash stands above the semi join with the repeated (length, prefix) pairs."""
    plan = exact_dedup.survivors(docs(spark, odd_texts()), "doc_id", "text", 128)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(") < plan.index("Join LeftSemi")


def linked(rows, width, percent):
    sets = {}
    lower = {k: k + 32 for k in range(65, 91)}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = set(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else {tuple(w)} if w else set()
    top = {i: i for i in sets if i is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in top:
        for b in top:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return sets, {i: root(i) for i in top}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, odd, width):
    sets, want = linked(odd, width, 80)
    got = near_dedup.near_duplicates(docs(spark, odd), width, 80).collect()
    assert len(got) == len(odd)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
        if r.doc_id is not None:
            assert r.n_shingles == len(sets[r.doc_id])
    assert near_dedup.near_duplicates(docs(spark, []), width).count() == 0
    assert len({r.component_id for r in got}) < len(want)


def test_chained_near_copies_meet_in_one_component(spark):
    """The smallest id is not the centre: members are near the base, not near each other."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        changed = list(base)
        for j in rng.choice(300, 8, replace=False):
            changed[j] = f"n{k}_{j}"
        rows.append((k, " ".join(changed)))
    rows.append((99, " ".join(base)))
    _, want = linked(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows), 4, 80).collect()}
    assert got == want and len(set(want.values())) == 1


def crowded(cloud):
    """Texts around three centres, of which only the last two are linked (similarity 89 to 111).

    Each centre has texts of 88 to 112, which the two find nearer by signature than each other. The two differ in 18
    components and share index entries only with the first centre, whose texts are the most there.
    """
    rng = np.random.default_rng(1)
    fresh = iter(range(10**9))

    def changed(words, k):
        out = list(words)
        for j in rng.choice(len(out), k, replace=False):
            out[j] = f"w{next(fresh)}"
        return out

    def signs(texts):
        return shingles.signatures(list(shingles.sets([" ".join(x) for x in texts], 1)), near_dedup.SIZE)

    centre = [f"b{k}" for k in range(100)]
    ones = [changed(centre, 12) for _ in range(300)]
    one = ones[(signs(ones) != signs([centre])).sum(axis=1).argmin()]
    others = [changed(one, 11) for _ in range(2000)]
    far = (signs(others) != signs([one])).sum(axis=1)
    first, second, *keys = (set(x) for x in near_dedup.index_keys(signs([centre, one, *others])).tolist())
    other = others[next(k for k in np.argsort(-far).tolist() if second & keys[k] and second & keys[k] <= first)]
    texts = [changed(x, 12) for x, n in ((centre, 3 * cloud), (one, cloud), (other, cloud)) for _ in range(n)]
    return [(k, " ".join(x)) for k, x in enumerate([*texts, centre, one, other])]


def test_link_behind_many_nearer_texts(spark):
    rows = crowded(200)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows), 1, 80).collect()}
    assert got == {i: i - (i == len(rows) - 1) for i, _ in rows}


@pytest.mark.parametrize("limit, value", [("BLOCK", 32), ("MOST_HELD", 1 << 14)])
def test_blocks_of_a_large_entry_meet(spark, monkeypatch, limit, value):
    """Entries of hundreds of rows in several blocks; the two linked rows do not ask in the same one or are met by all."""
    monkeypatch.setattr(near_dedup, limit, value)
    rows = crowded(200)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows), 1, 80).collect()}
    assert got == {i: i - (i == len(rows) - 1) for i, _ in rows}


def test_family_around_the_threshold(spark):
    """Hundreds of variants of one text, most of them just below the threshold of each other."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(600)]
    rows = []
    for k in range(300):
        changed = list(base)
        for j in rng.choice(600, rng.integers(8, 14), replace=False):
            changed[j] = f"n{rng.integers(0, 40)}_{j}"
        rows.append((k, " ".join(changed)))
    _, want = linked(rows, 4, 80)
    assert 3 < len(set(want.values())) < 297
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows), 4, 80).collect()}
    assert got == want


def test_repeated_ids_with_different_texts(spark):
    """A document of two texts joins the copies of both."""
    words = lambda k: " ".join(f"v{k}_{j}" for j in range(60))
    rows = [(1, words(1)), (1, words(2)), (2, words(1) + " more"), (3, words(2) + " more"), (4, words(4))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows), 4, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_index_guarantees_the_distance():
    """Any two signatures within 19 differing components share a key."""
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 16, (300, near_dedup.SIZE)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(near_dedup.SIZE, 2 * near_dedup.CHUNKS - 1, replace=False)
        row[at] ^= np.uint16(1)
    assert all(set(x) & set(y) for x, y in zip(near_dedup.index_keys(a).tolist(), near_dedup.index_keys(b).tolist(), strict=True))


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 7), (200, 201), (5, 5)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in (*range(61), 100)} == {0} and got[201] == 200


def test_suffix_dedup(spark, odd):
    rows = sorted(((i, (t or "").encode()) for i, t in odd if i is not None), key=lambda x: x[0])
    by_doc, want, n = collections.defaultdict(set), {}, suffix_dedup.LEAST
    for i, b in rows:
        by_doc[i] |= {b[k : k + n] for k in range(len(b) - n + 1)}
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if any(b[k : k + n] in by_doc[j] for j in by_doc if j < i):
                gone[k : k + n] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        want[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = suffix_dedup.remove_repeats(docs(spark, odd)).collect()
    assert len(got) == len(odd)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    whole = suffix_dedup.trimmed(docs(spark, odd))
    assert whole.columns == docs(spark, []).columns and whole.count() == len(odd)


def spans_by_brute_force(rows):
    """Per id (n_bytes, n_removed, n_spans, kept bytes) of rows with distinct ids."""
    n, first, out = suffix_dedup.LEAST, {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if first.setdefault(b[k : k + n], i) < i:
                gone[k : k + n] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), b"".join(b[k : k + 1] for k in np.flatnonzero(~gone)))
    return out


@pytest.mark.parametrize("case", ["no repeats", "one document", "one portion repeats", "one hot passage"])
def test_suffix_dedup_cases(spark, monkeypatch, case):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(n))
    shared = words(20)
    rows = {
        "no repeats": [(k, words(12)) for k in range(2)],
        "one document": [(3, shared + words(5) + shared)],
        "one portion repeats": [(k, words(30) + (shared if k in (1, 2) else "") + words(3)) for k in range(40)],
        "one hot passage": [(k, words(3) + shared + words(4)) for k in range(300)],
    }[case]
    table = docs(spark, rows).coalesce(1 if case == "one portion repeats" else 4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table).collect()}
    assert got == spans_by_brute_force(rows)


def test_a_line_in_every_document_is_asked_for_once_a_task(spark, monkeypatch):
    """Small portions and buckets: what a task knows to repeat goes past the buckets, and a hot key reaches its bucket once a task."""
    import pyarrow as pa

    rng = np.random.default_rng(10)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(n))
    line = words(12)
    rows = [(k, words(6) + line + words(6)) for k in range(600)]
    monkeypatch.setattr(suffix_dedup, "_PORTION", 4_000)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    sent = collections.Counter()
    for out in suffix_dedup._sift(8)(iter([batch])):
        for r in out.to_pylist():
            assert (r["bucket"] < 0) == r["known"]
            if not r["known"]:
                sent.update(suffix_dedup._long(r["keys"]).tolist())
    # A key may come once in a portion a few times before a portion has it twice.
    assert max(sent.values()) <= 8 and len(sent) > 600
    for seen in (suffix_dedup._SEEN, 1):  # a task that forgets asks again, with the same result
        monkeypatch.setattr(suffix_dedup, "_SEEN", seen)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()}
        assert got == spans_by_brute_force(rows)


def test_suffix_dedup_of_texts_over_a_megabyte(spark):
    """Repeated strings on both sides of, and across, the places where a long text is cut for its keys."""
    rng = np.random.default_rng(9)
    long = bytes(rng.integers(97, 123, 2_300_000, dtype=np.uint8)).decode()
    rows = [(1, long), (2, "x" * 70 + long[(1 << 20) - 300 : (1 << 20) + 300] + "y" * 70), (3, long[2_000_000:]), (4, long + "z" * 10)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == spans_by_brute_force(rows)


def test_prefix_boundaries_are_exact():
    rng = np.random.default_rng(2)
    windows = [bytes(rng.integers(97, 99, rng.integers(3, 40)).astype(np.uint8)) for _ in range(60)] + [b"ab" * 20, b"ab" * 15]
    for least in (2, 5, 11):
        text, window = bwt.collection(windows)
        order = bwt.suffix_array(text, window, least)
        new = bwt.prefix_boundaries(text, window, order, least)
        ends = np.flatnonzero(text == 0)
        suffix = [bytes((text[k : ends[window[k]]] - 1).astype(np.uint8)) for k in order]
        common = [0] + [next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y))) for x, y in zip(suffix[:-1], suffix[1:], strict=True)]
        assert [bool(b) for b in new] == [c < least for c in common]


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = odd + [*enumerate(TEXTS, 1000)]
    got = packing.pack_documents(docs(spark, rows), path, 64).collect()
    assert packing.pack_documents(docs(spark, []), path).count() == 0
    want = collections.Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 2


@pytest.mark.parametrize("top", [300, 1 << 20])
def test_wavelet_matrix(monkeypatch, top):
    monkeypatch.setattr(wavelet_shards, "_CHUNK", 1024)
    x = np.random.default_rng(1).integers(0, top, 5000)
    x[::50] = 7
    w = wavelet_shards.WaveletMatrix.from_bytes(b"head" + wavelet_shards.WaveletMatrix.build(x).to_bytes(), 4)
    assert w.bits == int(x.max()).bit_length()
    assert (w.all() == x).all() and (w.access(np.arange(5000)) == x).all() and w.access(41) == x[41]
    starts, ends = np.arange(0, 4000, 7), np.arange(1000, 5000, 7)
    assert w.occurrences(7) == np.flatnonzero(x == 7).tolist() and w.count(7, 100, 4000) == (x[100:4000] == 7).sum() and w.count(1 << 30) == 0
    assert w.count(7, starts, ends).tolist() == [(x[a:b] == 7).sum() for a, b in zip(starts, ends, strict=True)]
    with pytest.raises(IndexError):
        w.select(7, 5000)
    empty = wavelet_shards.WaveletMatrix.from_bytes(wavelet_shards.WaveletMatrix.build(np.zeros(0, np.uint32)).to_bytes())
    assert len(empty.all()) == 0 and empty.count(1) == 0


def test_wavelet_file_is_compressed():
    x = np.random.default_rng(1).zipf(1.3, 200_000)
    x = x[x < 50_000].astype(np.uint32)
    assert len(wavelet_shards.WaveletMatrix.build(x).to_bytes()) < 0.7 * 2 * len(x)


def test_wavelet_shards(spark, odd):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in odd if i is not None and (i, t) != (6, odd[6][1])] + [(6, odd[6][1]), *enumerate(TEXTS, 1000)]
    got = wavelet_shards.read_shards(wavelet_shards.write_shards(docs(spark, rows), path, shard_tokens=500)).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r.last_id, r.n_end_ids) == (0, ids.count(0))
        start += len(ids)
    assert wavelet_shards.read_shards(wavelet_shards.write_shards(docs(spark, []), path)).count() == 0


def test_histogram_sort(spark):
    rows = [(k, "hot" * 40 if k % 3 == 0 else f"text {k} " * (k % 23)) for k in range(900)] + [(None, None), (5, "a"), (5, "a")]
    text = F.coalesce("text", F.lit(""))
    base = docs(spark, rows).drop("_hash").withColumns({"size": F.octet_length(text).cast("long") + 8, "key_hash": F.xxhash64(text)})
    got = histogram_shards.histogram_sort(base, 12).collect()
    assert len(got) == len(rows)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append((r.slot, r.key_hash, r.doc_id))
    assert set(slots) == set(range(12)) and all(sorted(s for s, _, _ in v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)
    finer = histogram_shards.histogram_sort(base, 12, range_rows=20, most_heavy=1 << 20).select("doc_id", "shard", "slot").collect()
    assert collections.Counter((r.doc_id, r.shard, r.slot) for r in finer if r.doc_id != 5) == collections.Counter((r.doc_id, r.shard, r.slot) for r in got if r.doc_id != 5)
    order = [(h, -1 if d is None else d) for k in range(12) for _, h, d in sorted(slots[k])]
    assert order == sorted(order)
    assert histogram_shards.histogram_sort(base.where("false"), 12).count() == 0


TEXTS = ["hello <|endoftext|> world", "a\xa0\n b\u2003 c\u3000\t d\x85 e", "trailing \n\n ", "", "  a  b\n\n c", "日本語のテキスト  처리", "a\tb \n c　d", "x" * 300, " ", "'s I'll  don't\r\n", "\x1c a", "é̀ñ🙂🙂 👩‍👩‍👧 zz", "Plain words, and 12 numbers.\nNext line"]


def test_transducer_is_tiktoken(spark):
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe_transducer.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*enumerate(TEXTS), (None, None)]
    for r in bpe_transducer.encode_decode(docs(spark, rows), path, public.PATTERN, ids=True).collect():
        text = (dict(rows)[r.doc_id] or "") if r.doc_id is not None else ""
        ids = enc.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    other = r"\S+|\s+"
    for r in bpe_transducer.encode_decode(docs(spark, rows), path, other, ids=True).collect():
        assert r.ids == tiktoken.Encoding("other", pat_str=other, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(dict(rows)[r.doc_id] or "")
    assert bpe_transducer.encode_decode(docs(spark, []), path, public.PATTERN).count() == 0
    machine = bpe_transducer.Transducer(ranks)
    rng = np.random.default_rng(0)
    for k in range(200):
        word = bytes(rng.integers(0, 256, rng.integers(1, 400), dtype=np.uint8)) if k else b" " * 5000 + b"-" * 700
        assert machine.encode(word) == list(machine.stream(word)) == enc._core_bpe.encode_single_piece(word)
    for _ in range(500):
        word = bytes(rng.choice(list(b"etaoin shrdlu"), rng.integers(1, 25)).astype(np.uint8))
        assert machine.encode(word) == enc._core_bpe.encode_single_piece(word)
    stream = bpe_transducer.StreamDecoder(machine.token)
    assert "".join(stream.feed([i]) for i in enc.encode_ordinary("日本🙂")) + stream.feed([], True) == "日本🙂"


def test_media_round_trip(spark, odd):
    noise = np.random.default_rng(0).integers(0, 256, mjpeg_avi.FRAME * 3, dtype=np.uint8)
    images = mjpeg_avi.encode_frames(noise)
    assert (mjpeg_avi.decode_frames(images).ravel() == noise).all()
    found, size = mjpeg_avi.read_avi(mjpeg_avi.write_avi(images, 500))
    assert found == images and size == 500
    stored = mjpeg_avi.store_media(docs(spark, odd))
    got = mjpeg_avi.media_features(stored).collect()
    by_id = collections.defaultdict(set)
    for i, t in odd:
        raw = (t or "").encode()
        pad = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        by_id[i].add((len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:])))
    assert len(got) == len(odd) and all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in by_id[r.doc_id] for r in got)
    assert mjpeg_avi.media_features(mjpeg_avi.store_media(docs(spark, []))).count() == 0
    assert all(r.feature == f"frames={(len(dict(odd)[18].encode()) + 3071) // 3072};fps=10;clips_ms=" + ",".join(f"{c.start_ms}-{c.end_ms}" for c in mjpeg_avi.clip_rows(stored).where("doc_id = 18").orderBy("clip").collect()) for r in got if r.doc_id == 18)
    clips = mjpeg_avi.clip_rows(stored).where("doc_id = 18").orderBy("clip").collect()
    assert clips[0].start_ms == 0 and all(a.end_ms == b.start_ms for a, b in zip(clips, clips[1:], strict=False))


def test_other_code_tables():
    """A common JPEG table of lengths 2 to 9, another frame size, and a file that mixes both kinds of frames."""
    import struct

    table = b"\x00" + bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7) + bytes([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11])
    codes = {size: f"{code:0{length}b}" for (length, code), size in mjpeg_avi._codes(table).items()}

    def image(x):
        d = np.diff(x.astype(int), axis=1, prepend=0)
        d[1:, 0], d[0, 0] = np.diff(x[:, 0].astype(int)), int(x[0, 0]) - 128
        bits = "".join(codes[s] + (f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else "") for v in d.ravel().tolist() for s in [abs(v).bit_length()])
        data = bytes(int(bits[k : k + 8].ljust(8, "1"), 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        frame = struct.pack(">HBHHB3B", 11, 8, *x.shape, 1, 1, 0x11, 0)
        return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4" + struct.pack(">H", 2 + len(table)) + table + b"\xff\xc3" + frame + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0) + data + b"\xff\xd9"

    rng = np.random.default_rng(6)
    small = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    assert (mjpeg_avi.decode_image(image(small)) == small).all()
    frames = np.cumsum(rng.integers(-3, 4, (2, mjpeg_avi.HEIGHT, mjpeg_avi.WIDTH)), axis=2).astype(np.uint8)
    own = mjpeg_avi.encode_frames(frames[:1])
    images, _ = mjpeg_avi.read_avi(mjpeg_avi.write_avi([*own, image(frames[1])], 1))
    assert (mjpeg_avi.decode_frames(images) == frames).all() and (mjpeg_avi.decode_image(own[0]) == frames[0]).all()
    with pytest.raises(ValueError):
        mjpeg_avi.decode_image(image(small).replace(b"\xff\xc3", b"\xff\xc0"))


def test_shots_at_changes():
    frames = np.zeros((12, mjpeg_avi.HEIGHT, mjpeg_avi.WIDTH), np.uint8)
    frames[5:] = 200
    assert mjpeg_avi.shots(frames) == [(0, 5), (5, 12)]


def test_warc(spark):
    big = "<p>" + "segment " * 9000
    rows = [(1, "u1", big), (2, "u2", big), (3, None, "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", "é" * 800), (9, "u9", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, payload int")
    listed = warc.write_archives(warc.record_kinds(pages), segment_bytes=4096, archive_bytes=200)
    assert listed.count() > 1
    got = {r.page_id: r for r in warc.resolved(warc.read_archives(listed)).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 9) if i in (1, 2) else ("response", None))
    assert warc.unchunked(warc.chunked(b"x" * 10_000, 999)) == b"x" * 10_000
    assert warc.resolved(warc.read_archives(warc.write_archives(warc.record_kinds(pages.where("false"))))).count() == 0


def test_warc_odd_pages(spark):
    """Null and repeated ids, repeated rows, one id with two payloads; everything segmented."""
    big, other = "<p>" + "segment " * 900, "<i>" + "another " * 900
    rows = [(None, "a", big), (None, "b", other), (None, "c", other), (7, "d", big), (7, "e", other), (7, "e", other), (8, None, other), (9, "f", None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.resolved(warc.read_archives(warc.write_archives(warc.record_kinds(pages), segment_bytes=1024)))
    want = collections.Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [x for x, _, h in rows if h == html and x is not None]
        top = max(same, default=None) if len(raw) >= 1000 else None
        revisit = top is not None and i != top
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert collections.Counter(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want


def test_quality_learns_from_labels(spark):
    rng = np.random.default_rng(4)
    good = lambda: " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(150)) + "."
    rows = [(k, good() if k % 4 else good().upper().replace(" ", "!! ")) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows + [(None, None), (500, "")])
    model = mil_quality.train(table, labels)
    got = mil_quality.score(table, model).collect()
    assert len(got) == 242 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 20 and np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert mil_quality.train(table, labels.where("false")) is None and {r.score for r in mil_quality.score(table, None).collect()} == {0.5}


def test_quality_gradient():
    """Training's gradient against differences, weight by weight."""
    rng = np.random.default_rng(0)
    bags, labels = [rng.normal(size=(n, mil_quality.WIDTH)) for n in (1, 3, 5)], np.array([0.0, 1.0, 1.0])
    model = mil_quality.fit([b.astype(np.float32) for b in bags], labels, epochs=2)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, grad = mil_quality.gradients(model, bags, labels)
    for name, w in model.w.items():
        for at in rng.choice(w.size, min(w.size, 12), replace=False):
            held, step = w.flat[at], 1e-5
            w.flat[at] = held + step
            up, _ = mil_quality.gradients(model, bags, labels)
            w.flat[at] = held - step
            down, _ = mil_quality.gradients(model, bags, labels)
            w.flat[at] = held
            assert abs((up - down) / (2 * step) - grad[name].flat[at]) < 1e-6


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc ,.X"), n)) for n in (0, 1, 700, 5000, 40, 2048 * 512 + 900)]
    model = mil_quality.fit([rng.normal(size=(n, mil_quality.WIDTH)).astype(np.float32) for n in (2, 3)], np.array([0, 1], np.float32), epochs=2)
    together = model.score(texts * 3 + texts[::-1])
    alone = [float(model.score([t])[0]) for t in texts]
    assert together.tolist() == alone * 3 + alone[::-1]


def test_shingle_sets_do_not_depend_on_blocks():
    texts = ["A b C d e", "a B c D e f", "", None, "x y", "é ü ñ ö " * 50]
    together = [s.tolist() for s in shingles.sets(texts, 4)]
    assert together == [next(iter(shingles.sets([t], 4))).tolist() for t in texts]
    assert len(set(together[0]) & set(together[1])) == 2 and together[2] == [] and len(together[4]) == 1
