"""Long texts in every operator, plain recomputations of scores and shards, packing at its real size, clashing columns in the pipeline."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievewright.llm import bpe_transducer, chunks, curve_packing, exact_dedup, filter_audit, histogram_shards, mil_quality, mjpeg_avi, near_dedup, packing, source_audit, warc, wavelet_shards

public = pytest.importorskip("public_tokenizers")
DDL = "doc_id long, text string, lang string, source string, n_chars long, _hash long, cls long, kept string, label string, _len int, whole string, keys string"


@pytest.fixture(scope="module")
def long_rows():
    """Two copies of a text of 1.3 MB, one of its like with another end, and short ones."""
    rng = np.random.default_rng(20)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 10))) for _ in range(3000)])
    long = " ".join(rng.choice(words, 200_000))
    return [(1, long), (2, "short text"), (3, long), (4, long + " and an end"), (5, None)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame([(i, t, "en", "s", *[None] * 8) for i, t in long_rows], DDL)


def test_long_texts_are_deduplicated(long_docs, long_rows):
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(long_docs).collect()}
    assert got == {i: ({1: 3}.get(i, i), 2 if i in (1, 3) else 1, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in long_rows}
    near = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(long_docs, 4, 80).collect()}
    words = dict(long_rows)[1].split(" ")
    assert near[1] == near[3] == (1, len(set(zip(words, words[1:], words[2:], words[3:], strict=False)))) and near[4][0] == 1 and near[2] == (2, 1) and near[5] == (5, 0)


def test_long_pages_come_back(long_docs, long_rows):
    pages = long_docs.select(F.col("doc_id").alias("page_id"), F.lit("https://a/b").alias("url"), F.col("text").alias("html"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(warc.read_archives(warc.write_archives(warc.record_kinds(pages)))).collect()}
    raw = {i: (t or "").encode() for i, t in long_rows}
    assert got == {i: (len(b), hashlib.sha1(b).hexdigest(), "revisit" if i == 1 else "response", 3 if i == 1 else None) for i, b in raw.items()}


def test_long_texts_are_encoded(long_docs, long_rows):
    import tiktoken
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4") for i, t in long_rows}
    ended = {i: np.append(v, 0).astype("<u4") for i, v in ids.items()}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet_shards.read_shards(wavelet_shards.write_shards(long_docs, path)).collect()}
    starts = dict(zip(ended, np.cumsum([0, *map(len, ended.values())]).tolist(), strict=False))
    assert got == {i: (starts[i], len(v), zlib.crc32(v)) for i, v in ended.items()}
    pieces = collections.defaultdict(dict)
    for r in curve_packing.pack_along_curve(long_docs, path, ids=True).collect():
        pieces[r.doc_id][r.start] = bytes(r.ids)
    assert {i: b"".join(v for _, v in sorted(p.items())) for i, p in pieces.items()} == {i: np.append(v, 1).astype("<u4").tobytes() for i, v in ids.items()}
    path = public.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(path), special_tokens={})
    for r in bpe_transducer.encode_decode(long_docs, path, public.PATTERN).collect():
        want = enc.encode_ordinary(dict(long_rows)[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())


def test_long_texts_as_media(long_docs, long_rows):
    for r in mjpeg_avi.media_features(mjpeg_avi.store_media(long_docs)).collect():
        raw = (dict(long_rows)[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_long_texts_in_audits(long_docs):
    rows = source_audit.divergence(long_docs, least_docs=2).collect()
    assert rows == [] or {r.part for r in rows} == {"term"}
    labels = long_docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    told = {(r.filter_order, r.step): r for r in filter_audit.filter_audit(long_docs, labels).collect()}
    assert told["EABCD", 1].removed == 1 and told["ABCDE", 1].removed == 2 and told["ABCDE", 1].good_lost == 2


@pytest.mark.parametrize("ids", ["distinct", "null", "one"])
def test_shards_against_a_sorted_walk(spark, ids):
    """Boundaries are those of a walk along the sorted rows: within the tolerance of their target, or next to the row that crosses it."""
    rng = np.random.default_rng(21)
    rows = [(k if ids == "distinct" else None if ids == "null" else 7, int(rng.integers(8, 5000)), int(rng.choice([0, 5, -9, *rng.integers(-(1 << 62), 1 << 62, 300)]))) for k in range(700)]
    got = histogram_shards.histogram_sort(spark.createDataFrame(rows, "doc_id long, size long, key_hash long"), 8).collect()
    assert collections.Counter((r.doc_id, r.size, r.key_hash) for r in got) == collections.Counter(rows)
    if ids != "distinct":  # rows with one key have no order among themselves
        for k in range(8):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
        return
    walk = sorted(got, key=lambda r: (r.key_hash, r.doc_id))
    assert [(r.shard, r.slot) for r in walk] == [(s, k) for s in range(8) for k in range(sum(r.shard == s for r in walk))]
    total, slack, below, ends = sum(r.size for r in walk), 0.001 * sum(r.size for r in walk) / 8, 0, {}
    for r in walk:
        below += r.size
        ends[r.shard] = (below, r.size)
    for s in range(7):
        end, last = ends[s]
        following = next(r.size for r in walk if r.shard == s + 1 and r.slot == 0)
        target = total * (s + 1) / 8
        assert end - slack - last <= target <= end + following + slack


def test_shards_refuse_clashing_columns(spark):
    base = spark.createDataFrame([(1, 2, 3)], "doc_id long, size long, key_hash long")
    for name in ("shard", "Slot"):
        with pytest.raises(ValueError, match=name):
            histogram_shards.histogram_sort(base.withColumn(name, F.lit(1)), 2)
    inner = base.withColumns({c: F.lit(9) for c in ("_cell", "_hash", "_id", "_size", "_part", "_in", "_own", "_heavy", "_row", "_offset", "a.b")})
    got = histogram_shards.histogram_sort(inner, 2).collect()
    assert [r.asDict() for r in got] == [inner.first().asDict() | {"shard": got[0].shard, "slot": 0}]


def test_scores_against_a_plain_recomputation(spark):
    """Attention written out passage by passage in doubles."""
    rng = np.random.default_rng(22)
    good, bad = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)], ["$$$", "###", "BUY", "NOW", "!!!"]
    texts = {k: " ".join(rng.choice(good if k % 2 else bad, int(rng.integers(1, 400)))) for k in range(60)} | {60: None, 61: "", 62: "é" * 700}
    docs = spark.createDataFrame([(i, t, *[None] * 10) for i, t in texts.items()], DDL)
    model = mil_quality.train(docs, spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int"))
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    for r in mil_quality.score(docs, model).collect():
        raw = (texts[r.doc_id] or "").encode()
        top, low = 0.0, 0.0
        for s in range(0, len(raw) or 1, mil_quality.PASSAGE):
            part = raw[s : s + mil_quality.PASSAGE]
            x = mil_quality.passage_features(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))[0].astype(np.float64)
            h = np.tanh(np.clip((x - model.mean) / model.scale, -6, 6) @ w["W"] + w["b"])
            e = np.exp(sum(w["a"] * np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))))
            top, low = top + e * h, low + e
        want = 1 / (1 + np.exp(-(top / low @ w["c"] + w["d"][0])))
        assert abs(r.score - want) < 1e-4 and r.predicted == int(r.score >= 0.3)


def test_packing_at_its_real_size(spark):
    """Sequences of 2,048 and several packers: no more than one in a hundred above the lower bound, and a few per packer."""
    rng = np.random.default_rng(23)
    lengths = np.minimum(2048, np.exp(rng.normal(5.5, 1.2, 9000)).astype(int) + 1).tolist()
    pieces = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    for packers in (1, 3):
        got = packing.pack(pieces, packers).collect()
        filled = collections.Counter()
        for r in got:
            filled[r.sequence_id] += r.length
        assert len(got) == 9000 and max(filled.values()) <= 2048
        for _, held in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
            at = 0
            for r in held:
                assert r.offset == at
                at += r.length
        assert len(filled) <= 1.01 * sum(lengths) / 2048 + 3 * packers


def test_stages_with_clashing_columns(spark, tmp_path):
    """Further columns with names that stages use inside are carried along, or not read, and change nothing."""
    from test_corpus import odd_texts

    rows = [(i, t) for i, t in odd_texts() if i is not None]
    bare = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    more = bare.withColumns({c: F.lit(k).cast("long") for k, c in enumerate(("_hash", "cls", "_id", "_len", "_prefix", "_sha", "_doc", "_runs", "_copy", "_whole", "score", "component_id", "piece"))})
    spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda df: collections.Counter((r.doc_id, r.text, r.n_chars) for r in df.select("doc_id", "text", "n_chars").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, str(tmp_path))
        assert got.columns == more.columns and key(got) == key(stage(spark, bare, str(tmp_path))), name
    assert corpus_pipeline.STAGES[-1][1](spark, more, str(tmp_path)).count() == corpus_pipeline.STAGES[-1][1](spark, bare, str(tmp_path)).count()


class Counted:
    """A tokenizer that counts the texts it is asked for."""

    def __init__(self, inner):
        self.inner, self.asked = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **options):
        self.asked += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


ODD_PIECES = ["a\tb", "\x0b", "x y", "　z", " ", "éé", "́a", "İßΣ", "it's'll", "don't.", "<|endoftext|>", "a<|endoftext|≯", "<|ENDOFTEXT|>", "\x00\x01", "\x1c", "\u0085", "中文", "가", "12.5%", "\U0001f600‍", "q" * 5000]


def counted_encoder(monkeypatch, name, cut):
    """The encoder that workers use for ``cut``, and what counts its texts."""
    from tokenizers import Tokenizer

    made = []

    class Opened:
        @staticmethod
        def from_file(path):
            made.append(Counted(Tokenizer.from_file(path)))
            return made[-1]

    plain = Tokenizer.from_file(public.path(name))
    with monkeypatch.context() as m:
        m.setattr("tokenizers.Tokenizer", Opened)
        memory = chunks.library_memory.__wrapped__(public.path(name), cut)
    assert memory.cut is chunks.CUTS[cut]
    return memory.encode, made[0], lambda pieces: [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(pieces, add_special_tokens=False)]


def test_bare_pieces_are_encoded_side_by_side(monkeypatch):
    encode, seen, alone = counted_encoder(monkeypatch, "word_bpe_49k.json", "bare")
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeABC,.'äß7"), rng.integers(1, 12))) for _ in range(4000)]
    seen.asked = 0
    assert encode(words) == alone(words)
    assert seen.asked <= 100
    for pieces in (ODD_PIECES, [*words[:300], *ODD_PIECES, *words[300:600]], words[:1], ["\t"], ["<|endoftext|>"] * 3):
        assert encode(pieces) == alone(pieces)


def test_glued_pieces_are_encoded_side_by_side(monkeypatch):
    encode, seen, alone = counted_encoder(monkeypatch, "byte_bpe_50k.json", "glued")
    rng = np.random.default_rng(4)
    words = ["".join([rng.choice([" ", "\n", "  ", "\n\t "]), *rng.choice(list("abcdeABC,.'äß7"), rng.integers(1, 12))]) for _ in range(4000)]
    seen.asked = 0
    assert encode(words) == alone(words)
    assert seen.asked <= 100
    spaced = [" " + p for p in ODD_PIECES]
    for pieces in (ODD_PIECES, spaced, [*words[:300], *ODD_PIECES, *spaced, *words[300:600]], words[:1], ["  "], [" a", "  ", " b", "c", " d", " e"], ["<|endoftext|>"] * 3):
        assert encode(pieces) == alone(pieces)


def test_texts_of_shards_are_asked_for_side_by_side(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, made = Tokenizer.from_file(public.path("byte_bpe_50k.json")), []
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh,ß"), rng.integers(2, 10))) for _ in range(5000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(100)] + ["", "  ", *ODD_PIECES]
    monkeypatch.setattr(Tokenizer, "from_file", lambda path: made.append(Counted(tokenizer)) or made[-1])
    memory = chunks.library_memory.__wrapped__("any", "glued", 1_500_000)
    made[0].asked, raw = 0, [t.encode() for t in texts]
    ids, ends = memory(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert made[0].asked <= len(texts) + 100
    assert [ids[i:j].tolist() for i, j in itertools.pairwise([0, *ends.tolist()])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
