"""Byte-level BPE by a lazily determinised transducer, and streaming decode through an incremental UTF-8 machine.

The transducer rests on two facts about BPE: every prefix of a word has one encoding, and a sequence of tokens is an
encoding exactly if each token encodes to itself and each two neighbours, encoded together, stay as they are. A state
holds the places at which a token that has not ended yet may have begun: for each, how far the token has got in the
trie of all tokens and which token ends before it. Reading a byte moves to another state and tells the one token of
the prefix's encoding that ends there. What lies before the earliest open place is certain once the open places share
it, so tokens leave after a lookahead no longer than the longest token. States and moves are made when first met.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import GPT2_PATTERN, Memory, text_portions
from .common import prepare

_BITS, _NONE = 21, (1 << 21) - 1
_LONG = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes one word (a match of the splitting pattern) at a time. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 400_000):
        if max(ranks.values()) >= _NONE or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks of two million or more, or a byte without a token")
        self.ranks, self.limit = ranks, limit
        self.token = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.fits: dict[int, bool] = {}
        self.step: dict[int, int] = {}  # trie: node << 8 | byte -> node
        self.ends_at: dict[int, int] = {}  # trie: node -> its token, if merges make it
        nodes = 1
        for b, i in ranks.items():
            node = 0
            for x in b:
                to = self.step.get(node << 8 | x)
                if to is None:
                    to = self.step[node << 8 | x] = nodes
                    nodes += 1
                node = to
            self.ends_at[node] = i
        self.inner = {edge >> 8 for edge in self.step}
        self.clear()

    def clear(self) -> None:
        self.fits.clear()
        self.moves: dict[int, int] = {}  # state << 8 | byte -> state << _BITS | token that ends here
        self.open: list[tuple[int, ...]] = [(_NONE,)]  # per state: node << _BITS | token before the place, earliest place first
        self.number: dict[tuple[int, ...], int] = {self.open[0]: 0}

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of the last merge that makes ``token``; a single byte has an empty second part; None: no merges make it."""
        found = self.halves.get(token, 0)
        if found == 0:
            parts, ranks, halves = [token[k : k + 1] for k in range(len(token))], self.ranks, (token, b"")
            while len(parts) > 1:
                low, at = min((ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
                if low == 1 << 60:
                    halves = None
                    break
                if len(parts) == 2:
                    halves = parts[0], parts[1]
                elif low >= ranks[token]:
                    raise ValueError("a token's parts must rank before it")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.halves[token] = halves
        return found

    @cache  # noqa: B019  one machine per worker, bounded by the vocabulary
    def spine(self, token: int, side: int) -> tuple[tuple[bytes, ...], tuple[int, ...]]:
        """Parts at one edge of ``token`` (0: left, 1: right), from its single byte up to itself, and the ranks of those behind the first."""
        out = [self.token[token]]
        while len(out[-1]) > 1:
            out.append(self.split(out[-1])[side])
        out.reverse()
        return tuple(out), (*(self.ranks[x] for x in out[1:]), 1 << 60)

    def stays(self, left: int, right: int) -> bool:
        """Whether the two tokens, encoded together, stay as they are: both edges grow in rank order and no merge across them comes first."""
        ranks, last = self.ranks, 1 << 60
        (a, up_a), (b, up_b) = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            across, x, y = ranks.get(a[i] + b[j], last), up_a[i], up_b[j]
            if across < x and across <= y:
                return False
            if x == last and y == last:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def move(self, state: int, byte: int) -> int:
        step, ends_at, inner, fits, live, new = self.step, self.ends_at, self.inner, self.fits, [], -1
        for place in self.open[state]:
            node = step.get(place >> _BITS << 8 | byte)
            if node is None:
                continue
            left = place & _NONE
            if node in inner:
                live.append(node << _BITS | left)
            if new < 0 and (i := ends_at.get(node)) is not None:
                if left != _NONE:
                    ok = fits.get(left << _BITS | i)
                    if ok is None:
                        ok = fits[left << _BITS | i] = self.split(self.token[i]) is not None and self.stays(left, i)
                    if ok:
                        new = i
                elif self.split(self.token[i]) is not None:
                    new = i
        live.append(new)  # a token may begin behind this byte; the trie's root is node 0
        key = tuple(live)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.open)
            self.open.append(key)
        found = self.moves[state << 8 | byte] = to << _BITS | new
        return found

    def stream(self, word: bytes) -> Iterator[int]:
        """Tokens of ``word``, each as soon as it is certain; held are only the places since the last certain one."""
        state, ends, base = 0, [], 0  # ends[k]: token that ends behind byte base + k
        depth = {0: 0}

        def path(at: int) -> list[int]:
            out = []
            while at > base:
                out.append(ends[at - base - 1])
                at -= self.size[out[-1]]
            return out[::-1]

        for n, byte in enumerate(word, 1):
            found = self.moves.get(state << 8 | byte)
            found = self.move(state, byte) if found is None else found
            state = found >> _BITS
            ends.append(found & _NONE)
            if len(ends) % 64:
                continue
            for place in self.open[state]:
                node, x = place >> _BITS, 0
                if node not in depth:  # the open places' distances: depths of their nodes, found by their bytes
                    at = 0
                    for x in range(1, min(n, max(self.size.values())) + 1):
                        at = 0
                        for b in word[n - x : n]:
                            at = self.step.get(at << 8 | b, -1)
                            if at < 0:
                                break
                        if at == node:
                            break
                    depth[node] = x
            paths = [path(n - depth[place >> _BITS]) for place in self.open[state]]
            sure = 0
            while all(len(p) > sure and p[sure] == paths[0][sure] for p in paths):
                sure += 1
            for token in paths[0][:sure]:
                yield token
                del ends[: self.size[token]]
                base += self.size[token]
        yield from path(len(word))

    def encode(self, word: bytes) -> list[int]:
        if (i := self.ranks.get(word)) is not None:
            return [i]
        if len(self.open) > self.limit or len(self.moves) > 4 * self.limit or len(self.fits) > 4 * self.limit:
            self.clear()
        if len(word) > _LONG:
            return list(self.stream(word))
        moves, state, ends = self.moves, 0, []
        for byte in word:
            found = moves.get(state << 8 | byte)
            if found is None:
                found = self.move(state, byte)
            state = found >> _BITS
            ends.append(found & _NONE)
        out, at, size = [], len(word), self.size
        while at:
            out.append(ends[at - 1])
            at -= size[ends[at - 1]]
        return out[::-1]


class StreamDecoder:
    """Ids to text, some at a time; bytes of a character that is not complete yet wait for the next call."""

    def __init__(self, token: dict[int, bytes]):
        self.token, self.machine = token, codecs.getincrementaldecoder("utf-8")("surrogateescape")

    def feed(self, ids, final: bool = False) -> str:
        return self.feed_bytes(b"".join(map(self.token.__getitem__, ids)), final)

    def feed_bytes(self, data, final: bool = False) -> str:
        return self.machine.decode(data, final)


@cache
def _tools(path: str, pattern: str):
    """A worker's memory of words, and Arrow arrays of each id's bytes and of its decimal digits with a comma."""
    import regex

    words, machine = regex.compile(pattern).findall, Transducer(read_ranks(path))

    def encode(pieces: list[str]) -> list[bytes]:
        return [array("I", [i for w in words(p) for i in machine.encode(w.encode("utf-8", "surrogatepass"))]).tobytes() for p in pieces]

    ids = range(max(machine.token) + 1)
    return Memory("glued" if pattern == GPT2_PATTERN else "whole", encode, 600_000), pa.array([machine.token.get(i, b"") for i in ids], pa.large_binary()), pa.array([b"%d," % i for i in ids], pa.large_binary()), machine.token


def _spread(values: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Concatenated values of ``ids``, and where each begins."""
    out = values.take(pa.array(ids))
    if not len(out):
        return memoryview(b""), np.zeros(1, np.int64)
    return memoryview(out.buffers()[2]), np.frombuffer(out.buffers()[1], np.int64, len(out) + 1, 8 * out.offset)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256``.

    With ``ids`` also the ids themselves (``ids``: array of int). Each match of ``pattern`` is encoded by itself, no
    special tokens. Null text counts as empty (no ids); every input row gives one row, null ids and repeats too; an
    empty table gives an empty result and further columns are not read. Texts are cut into words at white space where
    the pattern is known to allow it and go whole through any other pattern.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, values, digits, token = _tools(ranks_path, pattern)
        for batch in batches:
            for a, b, data, offsets in text_portions(batch.column(1)):
                found, ends = memory(data, offsets)
                (raw, at), (decimal, mark), rows, first = _spread(values, found), _spread(digits, found), [], 0
                for e in ends.tolist():
                    decoder, digest = StreamDecoder(token), hashlib.sha256()
                    for k in range(at[first], at[e], 1 << 16):
                        digest.update(decoder.feed_bytes(raw[k : min(k + (1 << 16), at[e])]).encode("utf-8", "surrogateescape"))
                    digest.update(decoder.feed_bytes(b"", True).encode("utf-8", "surrogateescape"))
                    text = decimal[mark[first] : max(mark[first], mark[e] - 1)]
                    rows.append((e - first, hashlib.sha256(text).hexdigest(), digest.hexdigest(), *([found[first:e].tolist()] if ids else [])))
                    first = e
                kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if ids else [])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col]).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
