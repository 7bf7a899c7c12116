"""Cutting texts where a tokenizer's pieces end anyway, and a bounded memory of what each piece encodes to.

Texts stay Arrow buffers: cuts are places in their bytes, equal pieces are found by dictionary encoding, and Python
sees only the distinct pieces of a portion.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the splitting pattern of the byte-level vocabularies; cutting at white space is proved for it alone.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_GAP, _SOLID = bytearray(256), bytearray(256)
for _b in range(256):
    _GAP[_b] = _b in (9, 10, 11, 12, 13, 32)
    _SOLID[_b] = _b > 32
_GAP, _SOLID = bytes(_GAP), bytes(_SOLID)
#: Last bytes of the white space outside ASCII (U+0085, U+00A0; U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_WIDE2 = np.array([0xC285, 0xC2A0])
_WIDE3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
_PORTION = 4 << 20
#: Pieces encoded side by side as one text, and characters of each of them at most.
_JOINED, _LONGEST = 100, 1000


def _mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), np.bool_)


def before_spaces(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 ``data`` where a run of white space follows a character that is none.

    No match of GPT2_PATTERN reaches from such a character into the run behind it, and what matches in a run does not
    depend on what stands before it; so each piece, a run and the word behind it, can be split by itself.
    """
    cut = np.flatnonzero(_mapped(data[1:], _GAP) & _mapped(data[:-1], _SOLID)) + 1
    last = data[cut - 1].astype(np.int64)
    if (wide := last >= 0x80).any():
        two = np.where(cut > 1, data[np.maximum(cut - 2, 0)], 0).astype(np.int64) << 8 | last
        three = np.where(cut > 2, data[np.maximum(cut - 3, 0)], 0).astype(np.int64) << 16 | two
        cut = cut[~(wide & (np.isin(two, _WIDE2) | np.isin(three, _WIDE3)))]
    return cut


def _glued(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, piece offsets, first piece of each text) with pieces that keep their white space."""
    mark = np.zeros(len(data) + 1, bool)
    mark[before_spaces(data)] = True
    mark[offsets] = True
    cut = np.flatnonzero(mark)
    return data, cut, np.searchsorted(cut, offsets)


def _bare(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with runs of spaces and line feeds, which every definition counts as white space, left out."""
    solid = (data != 32) & (data != 10)
    before = np.concatenate([[0], np.cumsum(solid)])
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = solid[first]
    cut = np.append(before[np.flatnonzero(start)], before[-1])
    return data[solid], cut, np.searchsorted(cut, before[offsets])


def _whole(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = np.unique(offsets)
    return data, cut, np.searchsorted(cut, offsets)


CUTS = {"glued": _glued, "bare": _bare, "whole": _whole}


def _listed(values: pa.BinaryArray) -> list[bytes]:
    """What ``to_pylist`` gives, without a scalar for each value; none may be null."""
    if not len(values):
        return []
    offsets, raw = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset), values.buffers()[2]
    raw = raw.to_pybytes() if raw is not None else b""
    return [raw[i:j] for i, j in pairwise(offsets.tolist())]


class Memory:
    """What each piece encodes to. ``encode`` takes a list of distinct pieces and gives their ids as little-endian bytes.

    Pieces of up to ``longest`` bytes live in two generations of ``limit`` // 2: a full young one becomes the old one,
    whose pieces come back when they are met again.
    """

    def __init__(self, cut: str, encode: Callable[[list[str]], list[bytes]], limit: int = 800_000, longest: int = 64):
        self.cut, self.encode, self.limit, self.longest, self.young, self.old = CUTS[cut], encode, limit, longest, {}, {}

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.young) >= self.limit // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        new = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            if (ids := old.get(pieces[k])) is None:
                new.append(k)
            else:
                found[k] = young[pieces[k]] = ids
        for s in range(0, len(new), 20_000):
            part = new[s : s + 20_000]
            for k, ids in zip(part, self.encode([pieces[k].decode() for k in part]), strict=True):
                found[k] = ids
                if len(pieces[k]) <= self.longest:
                    young[pieces[k]] = ids
        return found

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends of each text among them) of texts data[offsets[k] : offsets[k + 1]]."""
        data, cut, first = self.cut(data, offsets)
        pieces = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        known = pa.array(self._known(_listed(pieces.dictionary)), pa.binary())
        spread = known.take(pieces.indices)
        ends = np.frombuffer(spread.buffers()[1], np.int32, len(spread) + 1, 4 * spread.offset) if len(spread) else np.zeros(1, np.int32)
        ids = np.frombuffer(spread.buffers()[2] or b"", "<u4")[ends[0] // 4 : ends[-1] // 4] if len(spread) else np.zeros(0, "<u4")
        return ids, (ends[first[1:]] - ends[0]) // 4


def text_portions(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts with about _PORTION bytes, straight from the array's buffers; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _PORTION, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _token_bytes(tokenizer) -> np.ndarray | None:
    """Bytes of normalised text that each id stands for; None where the vocabulary doesn't tell."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    model, normal = tokenizer.model, tokenizer.normalizer
    if not isinstance(model, BPE) or model.dropout or model.continuing_subword_prefix:
        return None
    known, added, suffix = tokenizer.get_vocab(with_added_tokens=False), tokenizer.get_added_tokens_decoder(), model.end_of_word_suffix or ""
    letters = set(ByteLevel.alphabet())
    if any(c not in known or c + suffix not in known for c in letters):
        return None
    sizes = np.zeros(max(*known.values(), *added) + 1, np.int64)
    for token, i in known.items():
        if i not in added:
            token = token.removesuffix(suffix)
            sizes[i] = len(token)
            if not token or not letters.issuperset(token):
                return None
    for i, token in added.items():
        text = token.content
        sizes[i] = len(text.encode())
        if not text or re.search(r"\s", text) or token.lstrip or token.rstrip or token.single_word or token.normalized or (normal and normal.normalize_str(text) != text):
            return None
    return sizes


def _bare_texts(pieces: list[str], normal) -> tuple:
    """(pieces that stand side by side, the others, texts of the former, bytes up to the end of each without spaces, once ``normal`` has passed; None where it moves them)."""
    text = " ".join(pieces)
    joint, alone = range(len(pieces)), []
    if text.split(" ") != text.split() or max(map(len, pieces)) > _LONGEST:
        fit = [len(p) <= _LONGEST and p.split() == [p] for p in pieces]
        joint, alone = [k for k, f in enumerate(fit) if f], [k for k, f in enumerate(fit) if not f]
    texts = [" ".join([pieces[k] for k in joint[s : s + _JOINED]]) for s in range(0, len(joint), _JOINED)]
    raw = " ".join(map(normal.normalize_str, texts) if normal else texts).encode()
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    return joint, alone, texts, np.append(gaps, len(raw)) - np.arange(len(joint)) if len(gaps) == len(joint) - 1 else None


def _glued_texts(pieces: list[str], normal) -> tuple:
    """The same for pieces with their white space, which need nothing between them; a text ends where :func:`before_spaces` has no cut."""
    if normal:
        return range(len(pieces)), [], [], None
    raw = [p.encode() for p in pieces]
    ends, data = np.cumsum(list(map(len, raw))), b"".join(raw)
    safe = np.zeros(len(data) + 1, bool)
    safe[before_spaces(np.frombuffer(data, np.uint8))] = True
    inner = ends[:-1]
    apart = ~safe[inner] | (ends[1:] - inner > _LONGEST) | (np.arange(1, len(pieces)) % _JOINED == 0)
    texts = [data[i:j].decode() for i, j in pairwise([0, *inner[apart].tolist(), len(data)])]
    return range(len(pieces)), [], texts, ends


#: What lays pieces side by side, for cuts under which they may.
_LAID = {"bare": _bare_texts, "glued": _glued_texts}


def library_encoder(tokenizer, cut: str) -> Callable[[list[str]], list[bytes]]:
    """``encode`` for a :class:`Memory` that cuts as ``cut`` says: the ids that the library gives each piece by itself.

    A call for a piece costs more than its ids. So pieces stand side by side in texts of at most _JOINED pieces, where
    the cut's law keeps them apart, and the bytes that the ids stand for tell where each piece ends. Pieces that the
    law does not keep apart have a text of their own, as all have where those ends do not fall between two ids.
    """
    sizes, laid, normal = _token_bytes(tokenizer), _LAID.get(cut), tokenizer.normalizer

    def encoded(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(pieces: list[str]) -> list[bytes]:
        joint, alone, texts, ends = laid(pieces, normal)
        if ends is None or not len(joint):
            return encoded(pieces)
        ids = b"".join(encoded(texts))
        reach = np.cumsum(sizes[np.frombuffer(ids, "<u4")])
        at = np.searchsorted(reach, ends)
        if at[-1] != len(reach) - 1 or (reach[at] != ends).any():
            return encoded(pieces)
        found = [b""] * len(pieces)
        for k, (i, j) in zip(joint, pairwise([0, *(4 * at + 4).tolist()]), strict=True):
            found[k] = ids[i:j]
        for k, own in zip(alone, encoded([pieces[k] for k in alone]), strict=True):
            found[k] = own
        return found

    return encoded if sizes is None or laid is None else encode


@cache
def library_memory(path: str, cut: str, limit: int = 800_000) -> Memory:
    """A worker's memory (of ``limit`` pieces, some 200 bytes each) of the tokenizers library's encoder at ``path``. Pieces are cut as asked only where that gives what whole texts give."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    probe = ["Ab cd's  12\n\nxy. z\n", " a\tb \n 'll 7%", "é ñ　 w"]
    encode = library_encoder(tokenizer, "whole")
    memory = Memory(cut, library_encoder(tokenizer, cut), limit)
    for text in probe:
        raw = np.frombuffer(text.encode(), np.uint8)
        if memory(raw, np.array([0, len(raw)]))[0].tobytes() != encode([text])[0]:
            return Memory("whole", encode, limit)
    return memory
