"""Token ids of whole batches with a public byte-level BPE vocabulary.

The tokenizer first cuts a text into pretokens (a word with the space before it, a run of
digits, of signs, of white space, an English contraction) and then encodes each by itself.
Here the cuts of a chunk are found at once from the classes of its characters; each
distinct pretoken is encoded once and the ids are put back in place.  Where a vocabulary
numbers its tokens in the order of its merges, as byte-level BPE does, ``tiktoken``
encodes the pretokens, several times faster than ``tokenizers`` and to the same ids;
others go to ``tokenizers``.  Texts that hold one of the vocabulary's special strings are
given to that library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cached_property

import numpy as np

from .kernels import codepoints, span_hashes

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: Unicode's White_Space property.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in the pretokens of byte-level BPE, in the order they are tried.
_CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Pretokens whose ids a worker keeps.
KEPT = 100_000

_classes: list[np.ndarray] = []


def _newer(table: np.ndarray, free: list[str]) -> None:
    """Classes of the letters and numbers that the tokenizer library has and this Python's older Unicode lacks."""
    from tokenizers.pre_tokenizers import ByteLevel

    cuts = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for k in range(0, len(free), 4096):
        text = "!".join(free[k : k + 4096]) + "!"
        for _, (low, high) in cuts(text):  # between signs only letters and numbers stand alone
            if high == low + 1 and text[low] != "!":
                table[ord(text[low])] = _LETTER if len(cuts("a" + text[low])) == 1 else _NUMBER


def _class_table() -> np.ndarray:
    if not _classes:
        table = np.zeros(0x110000, dtype=np.uint8)
        free = []
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))
            table[cp] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
            if kind == "Cn" and cp < 0x40000:  # no letter is beyond
                free.append(chr(cp))
        table[_SPACES] = _SPACE
        _newer(table, free)
        _classes.append(table)
    return _classes[0]


def starts_of(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mask of the characters that begin a pretoken; rows begin at ``at``."""
    n = len(points)
    kind = _class_table()[points]
    row = np.zeros(n + 1, dtype=bool)
    row[at] = True
    edge = row[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    start = edge.copy()
    space = kind == _SPACE
    # the last of a run of white space goes with what follows if it is a blank, else stands alone
    after = np.flatnonzero(edge[1:] & ~space[1:] & space[:-1] & ~row[1:n]) + 1
    start[after - 1] = True
    blank = points[after - 1] == 0x20
    start[after[blank]] = False
    # contractions begin at an apostrophe that is a sign by itself and not after a blank
    mark = np.flatnonzero((points == 0x27) & start & edge)
    mark = mark[(mark + 1 < n)]
    mark = mark[~row[mark + 1] & (kind[mark + 1] == _LETTER)]
    if len(mark):
        free = np.ones(len(mark), dtype=bool)
        for text in _CONTRACTIONS:
            fits = free.copy()
            for j, c in enumerate(text, 1):
                there = np.minimum(mark + j, n - 1)
                fits &= (mark + j < n) & (points[there] == ord(c))
                if j > 1:
                    fits &= ~row[there]
            end = mark[fits] + len(text) + 1
            start[mark[fits] + 1] = False
            inner = end[end < n]
            start[inner[(kind[inner] == _LETTER)]] = True
            free &= ~fits
    return start


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE writes bytes: printable ones themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_ranks(tokenizer) -> dict[bytes, int] | None:
    """Bytes of each token with its id, if ids follow the order of the merges."""
    model = json.loads(tokenizer.to_str())["model"]
    vocabulary, letters = model["vocab"], byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if model.get("type") != "BPE" or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    if any(c not in letters or vocabulary.get(c, 256) >= 256 for c in letters):
        return None
    made = [*letters, *(a + b for a, b in pairs)]
    return {bytes(letters[c] for c in token): vocabulary[token] for token in made}


class Encoder:
    """Encodes chunks of texts; one per worker process."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(self.tokenizer)
        self.pieces = None
        if ranks is not None:
            import tiktoken

            self.pieces = tiktoken.Encoding("pretokens", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            del self.tokenizer  # loaded again if a text needs it
        self.known: dict[int, int] = {}
        self.lens = np.zeros(0, dtype=np.int32)
        self.begin = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        if self.pieces is not None:
            ids = [self.pieces.encode_ordinary(t) for t in texts]
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.array([len(i) for i in ids], dtype=np.int32)
        base = len(self.pool)
        self.begin = np.concatenate([self.begin, base + np.cumsum(lens, dtype=np.int64) - lens])
        for k, h in enumerate(hashes, len(self.lens)):
            self.known[h] = k
        self.lens = np.concatenate([self.lens, lens])
        self.pool = np.concatenate([self.pool, np.fromiter((x for i in ids for x in i), dtype=np.uint32, count=int(lens.sum()))])

    def chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk, one after the other, and the offsets of the rows."""
        n_rows = len(offs) - 1
        points, at = codepoints(data, offs)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        if len(first) != len(points):  # not valid UTF-8
            return self._by_row([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)])
        begin = np.flatnonzero(starts_of(points, at))
        low = first[begin] if len(begin) else np.zeros(0, np.int64)
        high = np.append(low[1:], len(data)) if len(low) else low
        hashes, inverse = np.unique(span_hashes(data, low, high), return_inverse=True)
        if len(self.known) > KEPT:
            self.__init_cache()
        values = hashes.tolist()
        new = [i for i, h in enumerate(values) if h not in self.known]
        if new:
            example = np.zeros(len(values), dtype=np.int64)
            example[inverse] = np.arange(len(inverse))
            raw = data.tobytes()
            self._learn([values[i] for i in new], [raw[low[e] : high[e]].decode("utf-8") for e in example[new]])
        slot = np.fromiter((self.known[h] for h in values), dtype=np.int64, count=len(values))[inverse] if len(values) else np.zeros(0, np.int64)
        lens = self.lens[slot].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.begin[slot] - (ends - lens), lens) + np.arange(total)]
        rows = np.concatenate([[0], ends])[np.searchsorted(begin, at)] if len(begin) else np.zeros(n_rows + 1, np.int64)
        special = self._special_rows(data, offs)
        if special:
            parts = [self.whole(data[offs[r] : offs[r + 1]].tobytes().decode("utf-8")) if r in special else ids[rows[r] : rows[r + 1]] for r in range(n_rows)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, rows

    def __init_cache(self) -> None:
        self.known, self.lens, self.begin, self.pool = {}, self.lens[:0], self.begin[:0], self.pool[:0]

    def _special_rows(self, data: np.ndarray, offs: np.ndarray) -> set[int]:
        raw, found = data.tobytes(), set()
        for text in self.special:
            spot, mark = raw.find(text.encode()), text.encode()
            while spot >= 0:
                found.add(int(np.searchsorted(offs, spot, "right")) - 1)
                spot = raw.find(mark, spot + 1)
        return found

    def _by_row(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.whole(t) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
