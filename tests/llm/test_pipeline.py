"""The pipeline's stages: what each keeps, and their chain over the smallest tables."""

import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_chain(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, before = docs.columns, docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == names and 0 < docs.count() <= before, name
        before = docs.count()
        if name == "exact":
            rows = docs.collect()
            assert len({r.text for r in rows}) == len(rows)
            assert all(r.doc_id == max(i for i, t in texts.items() if t == r.text) for r in rows if sum(t == r.text for t in texts.values()) > 1)
        if name == "repeats":
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_labelled_good_documents_stay(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, DATA).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.3 * len(bad)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_against_brute_force(spark):
    """Exact, near, repeats and pack over the whole smallest table; an extra row each for null, empty, repeated texts."""
    from test_corpus import linked, spans_by_brute_force
    from tokenizers import Tokenizer

    from sievewright.llm import catalogue

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, ""), (10**6 + 3, "only a few words")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema))
    stages, texts = dict(corpus_pipeline.STAGES), lambda df: {r.doc_id: r.text for r in df.collect()}
    held = texts(docs)
    best = {}
    for i, t in held.items():
        best[t or ""] = max(i, best.get(t or "", i))
    assert texts(stages["exact"](spark, docs, DATA)) == {i: held[i] for i in best.values()}
    _, label = linked(list(held.items()), 5, 80)
    assert set(texts(stages["near"](spark, docs, DATA))) == {i for i in held if label[i] == i}
    spans = spans_by_brute_force(list(held.items()))
    assert texts(stages["repeats"](spark, docs, DATA)) == {i: spans[i][3].decode("utf-8", "ignore") if spans[i][1] else t for i, t in held.items()}
    tokenizer, pieces = Tokenizer.from_file(catalogue.tokenizer("word_bpe_49k.json")), {}
    for r in stages["pack"](spark, docs, DATA).collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in held.items()}
