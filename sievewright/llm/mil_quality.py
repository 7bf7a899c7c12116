"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of 512 bytes. Each passage is encoded from its byte classes and their successions; a
gate learns, from document labels alone, how much each passage counts; the weighted passage is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, tidy

PASSAGE = 512
_BLOCK = 512  # passages at once, so that their arrays stay in a core's cache
_COARSE = 12


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Fine class of each byte (every ASCII mark has its own) and coarse class."""
    fine, coarse = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            fine[b], coarse[b] = 0, 0
        elif b >= 0x80:
            fine[b], coarse[b] = 1, 1
        elif "a" <= c <= "z":
            fine[b], coarse[b] = 2, 2
        elif "A" <= c <= "Z":
            fine[b], coarse[b] = 3, 3
        elif "0" <= c <= "9":
            fine[b], coarse[b] = 4, 4
        elif c == " ":
            fine[b], coarse[b] = 5, 5
        elif c == "\n":
            fine[b], coarse[b] = 6, 6
        elif b in marks:
            fine[b], coarse[b] = 8 + marks.index(b), 8 if c in ".,;:'\"" else 9 if c in "!?" else 10 if c in "()[]{}<>|/\\" else 11
        else:
            fine[b], coarse[b] = 7, 7
    return fine, coarse


_FINE, _PAIR = _classes()
_FINES = 40
WIDTH = _FINES + _COARSE * _COARSE + 2


def passage_features(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row of features per passage data[start : start + length] (passages lie end to end; empty ones are zeros)."""
    n = len(starts)
    owner = np.repeat(np.arange(n), lengths)
    size = np.maximum(lengths, 1)[:, None]
    one = np.bincount(owner * _FINES + _FINE[data], minlength=n * _FINES).reshape(n, _FINES) / size
    coarse = _PAIR[data].astype(np.int64)
    inside = np.ones(len(data), bool)
    inside[starts[lengths > 0]] = False
    inside = inside[1:] if len(data) else inside
    pair = np.bincount((owner[1:] * _COARSE * _COARSE + coarse[:-1] * _COARSE + coarse[1:])[inside], minlength=n * _COARSE * _COARSE).reshape(n, -1) / size
    # How much repeats within the passage: distinct 4-byte strings against all.
    if len(data) >= 4:
        word = data[:-3].astype(np.uint32) | data[1:-2].astype(np.uint32) << 8 | data[2:-1].astype(np.uint32) << 16 | data[3:].astype(np.uint32) << 24
        same = owner[:-3] == owner[3:]
        keys = (owner[:-3][same].astype(np.uint64) << np.uint64(32)) | word[same]
        distinct = np.bincount((np.unique(keys) >> np.uint64(32)).astype(np.int64), minlength=n)
    else:
        distinct = np.zeros(n)
    more = np.stack([distinct / size[:, 0], np.log1p(lengths) / 7], axis=1)
    return np.concatenate([np.sqrt(one), np.sqrt(pair), more], axis=1).astype(np.float32)


def bags(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(text's place, features of up to _BLOCK of its passages) over the whole texts; a null or empty text is one empty passage.

    Short texts are made into features together, as these do not depend on their neighbours; what is yielded always
    begins at a multiple of _BLOCK passages of its own text.
    """
    held, count = [], 0

    def done() -> Iterator[tuple[int, np.ndarray]]:
        every = [part[s : s + PASSAGE] for _, part in held for s in range(0, len(part) or 1, PASSAGE)]
        x, at = passage_features(np.frombuffer(b"".join(every), np.uint8), np.cumsum([0, *map(len, every)])[:-1], np.array([len(e) for e in every])), 0
        for k, part in held:
            n = max(1, -(-len(part) // PASSAGE))
            yield k, x[at : at + n]
            at += n

    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for s in range(0, len(raw) or 1, _BLOCK * PASSAGE):
            part = raw[s : s + _BLOCK * PASSAGE]
            own = len(part) // PASSAGE + 1
            if held and count + own > _BLOCK:
                yield from done()
                held, count = [], 0
            held.append((k, part))
            count += own
    if held:
        yield from done()


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def instance(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ self.w["W"] + self.w["b"])
        t, g = np.tanh(h @ self.w["V"]), 1 / (1 + np.exp(-(h @ self.w["U"])))
        return x, h, t, g, (t * g) @ self.w["a"]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 per text.

        Each text is weighed in products of its own, so its score does not depend on what is scored beside it. Logits
        of the gate are bounded by its weights, so sums over blocks need no rescaling.
        """
        top, low = np.zeros((len(texts), self.w["W"].shape[1])), np.zeros(len(texts))
        for k, x in bags(texts):
            _, h, _, _, logit = self.instance(x)
            e = np.exp(logit.astype(np.float64))
            top[k] += e @ h.astype(np.float64)
            low[k] += e.sum()
        z = (top / low[:, None] * self.w["c"].astype(np.float64)).sum(axis=1) + float(self.w["d"][0])
        return 1 / (1 + np.exp(-z))


def gradients(model: Model, own: list[np.ndarray], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the bags, and its gradient by each weight."""
    w, sizes = model.w, np.array([len(b) for b in own])
    first, owner = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(own)), sizes)
    x, h, t, g, logit = model.instance(np.concatenate(own))
    e = np.exp(logit - np.maximum.reduceat(logit, first)[owner])
    share = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(h * share[:, None], first)
    out = z @ w["c"] + w["d"]
    p = 1 / (1 + np.exp(-out))
    dz_out = (p - labels) / len(own)
    grad = {"c": z.T @ dz_out, "d": np.array([dz_out.sum()])}
    dz = np.outer(dz_out, w["c"])[owner]
    dshare = (dz * h).sum(axis=1)
    dlogit = share * (dshare - np.add.reduceat(share * dshare, first)[owner])
    grad["a"] = (t * g).T @ dlogit
    dtg = np.outer(dlogit, w["a"])
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    grad["V"], grad["U"] = h.T @ dt, h.T @ dg
    dh = (dz * share[:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    grad["W"], grad["b"] = x.T @ dh, dh.sum(axis=0)
    return float(np.mean(np.logaddexp(0, out) - labels * out)), grad


def fit(every_bag: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Gated attention trained on document labels with Adam."""
    every, rng = np.concatenate(every_bag), np.random.default_rng(seed)
    w = {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "a": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    model = Model(every.mean(axis=0), every.std(axis=0) + 1e-3, w)
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(every_bag))
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            _, grad = gradients(model, [every_bag[k] for k in own], labels[own])
            step += 1
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k in w:
                gk = grad[k] + (decay * w[k] if w[k].ndim > 1 else 0)
                m1[k] += 0.1 * (gk - m1[k])
                m2[k] += 0.001 * (gk * gk - m2[k])
                w[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, y, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "label": pa.array([y], pa.int32()), "bag": pa.array([np.concatenate([x for _, x in bags([t])]).tobytes()], pa.binary())})


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_bytes: int = 24 << 20) -> Model | None:
    """A model from a bounded sample of labelled documents that are not held out, each with its whole text.

    The sample holds the ``max_docs`` documents with the smallest hashed ids, less those from where their texts together
    pass ``max_bytes`` (their features, some 1.5 times that, reach the driver). Null texts count as empty. Rows with a
    null id or label are no labels; of several labels for an id the largest counts, of several rows for an id that with
    the smallest features. Without any labelled document, as in an empty table, there is no model.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    first = [(r[0], r[1]) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()]
    own, few = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), docs.sparkSession.createDataFrame(first, "doc_id long, label int")
    sizes = own.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).collect()
    sizes, picked, size = dict(map(tuple, sizes)), [], 0
    for i, y in first:
        size += sizes.get(i, 0)
        if i in sizes and (size <= max_bytes or not picked):
            picked.append((i, y))
    if not picked:
        return None
    sample = docs.sparkSession.createDataFrame(picked, "doc_id long, label int")
    found = own.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").mapInArrow(tidy(_bags), "doc_id long, label int, bag binary").collect()
    found = {r["doc_id"]: r for r in sorted(found, key=lambda r: (r["doc_id"], bytes(r["bag"])), reverse=True)}
    found = [found[i] for i in sorted(found)]
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in found], np.array([r["label"] for r in found], np.float32))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from ``threshold`` on), from the whole text alone.

    Null and empty texts are scored as one empty passage; equal texts get equal scores; without a model the score is
    0.5. Every row is answered, null ids (not held out) and repeats too; an empty table gives an empty result and
    further columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            s = model.score(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; all rows where there is no model."""
    prepare(docs.sparkSession)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
