"""Benchmark decontamination by a generalised suffix automaton over words.

The automaton holds every run of words of the benchmark's items.  A document's words are
streamed through it; at each word it knows the length of the longest run of item words
that ends there.  When that length reaches the window (13 words, or a whole item that is
shorter), the words of the window are hit.  Words that no item has send the automaton
back to its root, so stretches of known words too short for any window are passed over
without a step.

Items are taken in blocks of about ``BLOCK_WORDS`` words; each block's automaton is one
step of the plan with its own broadcast and Python worker.  A worker holds one block, but
the driver holds all items and automata, and an executor those of all blocks: the operator
is for benchmarks of a few blocks.  No step shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import small_batches
from .kernels import ALNUM, LOWER, chunks, span_hashes, word_spans

WINDOW = 13
BLOCK_WORDS = 200_000
#: A document is contaminated if one in this many of its words is hit.
COVERAGE = 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    """Words of an item, as the kernels see them."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(bytes(LOWER)))


class Automaton:
    """Suffix automaton of many sequences of numbers."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, sequence in items:
            last = 0
            for c in sequence:
                last = self._extend(last, c)
        # what a match that reaches a state says: windows of full length, and whole short items
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, sequence in items:
            n = min(window, len(sequence))
            state = length = 0
            for i, c in enumerate(sequence):
                state, length = self.step(state, length, c)
                if i + 1 >= n > 0:
                    at = self.shrink(state, n)
                    if n == window:
                        self.full.setdefault(at, set()).add(item)
                    else:
                        self.short.setdefault(at, []).append((n, item))
        self.window = window
        self.least = min((min(window, len(s)) for _, s in items if s), default=0)
        self.any_short = bool(self.short)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0

    def shrink(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, sequence: list[int]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, end, items) of each window that occurs."""
        state = length = 0
        for i, c in enumerate(sequence):
            state, length = self.step(state, length, c)
            if length >= self.window:
                found = self.full.get(self.shrink(state, self.window))
                if found:
                    yield i + 1 - self.window, i + 1, sorted(found)
            if self.any_short and length:
                at = state
                while at > 0:
                    for n, item in self.short.get(at, ()):
                        if n <= length:
                            yield i + 1 - n, i + 1, [item]
                    at = self.link[at]


class Block:
    """An automaton with the hashes of its words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        vocabulary = sorted({w for _, ws in items for w in ws})
        joined = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary], dtype=np.int64) if vocabulary else np.zeros(0, np.int64)
        hashes = span_hashes(joined, np.concatenate([[0], ends[:-1]]).astype(np.int64) if vocabulary else ends, ends)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        number = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = Automaton([(k, [number[w] for w in ws]) for k, ws in items], window)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no item has."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)

    def scan(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, list[str]]]:
        """(row, first word, end, items) of the windows in a chunk; words are counted over the chunk."""
        known = ids >= 0
        if not self.automaton.least or not known.any():
            return
        edge = np.ones(len(ids) + 1, dtype=bool)
        edge[1:-1] = (known[1:] != known[:-1]) | (rows[1:] != rows[:-1])
        cuts = np.flatnonzero(edge)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if known[a] and b - a >= self.automaton.least:
                for lo, hi, items in self.automaton.hits(ids[a:b].tolist()):
                    yield int(rows[a]), int(a + lo), int(a + hi), items


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list[Block]:
    """Automata of all items with words, in order of their ids; null ids count as empty."""
    out, held, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("k"), F.col(text_col).cast("string").alias("t"))
    for row in rows.orderBy("k", "t").toLocalIterator():
        if ws := words(row["t"] or ""):
            held.append((row["k"], ws))
            size += len(ws)
            if size >= BLOCK_WORDS:
                out.append(Block(held, window))
                held, size = [], 0
    return [*out, Block(held, window)] if held or not out else out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, id_cols: list[str], text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int = WINDOW) -> DataFrame:
    """(id columns, n_words, n_hit, items, spans) of every row.

    ``items`` are the ids, as sorted distinct strings, of items with a window in the text;
    ``spans`` the merged hit words as (start, end) in UTF-8 bytes of the text.  A null or
    empty text has no words.  An empty benchmark hits nothing.
    """
    session = docs.sparkSession.sparkContext
    picked = small_batches(docs).select(*id_cols, F.col(text_col).cast("string").alias("_llm_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("_llm_hit"), F.array().cast("array<string>").alias("_llm_items"))
    ids = picked.schema.fields[: len(id_cols)]
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in ids]
    found = blocks(benchmark, item_col, item_text_col, window)
    for k, block in enumerate(found):
        last = k == len(found) - 1
        shared = session.broadcast(block)

        def step(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            own: Block = shared.value
            for batch in batches:
                text, hit, items = batch.column(len(ids)), batch.column(len(ids) + 2).to_pylist(), batch.column(len(ids) + 3).to_pylist()
                n_words, spans = np.zeros(batch.num_rows, dtype=np.int64), [[] for _ in range(batch.num_rows)]
                for lo, hi, data, offs in chunks(text):
                    low = LOWER[data]
                    starts, ends, rows = word_spans(low, offs, ALNUM)
                    n_words[lo:hi] = np.bincount(rows, minlength=hi - lo)
                    first = np.searchsorted(rows, np.arange(hi - lo))
                    for row, a, b, which in own.scan(own.numbers(span_hashes(low, starts, ends)), rows):
                        hit[lo + row] += [a - int(first[row]), b - int(first[row])]
                        items[lo + row] += which
                    if last:
                        for row in range(hi - lo):
                            if h := hit[lo + row]:
                                merged = _union(list(zip(h[::2], h[1::2], strict=True)))
                                hit[lo + row] = [x for ab in merged for x in ab]
                                at = first[row]
                                spans[lo + row] = [int(x) for a, b in merged for x in (starts[at + a] - offs[row], ends[at + b - 1] - offs[row])]
                columns = [*batch.columns[: len(ids)]]
                if last:
                    n_hit = [sum(h[1::2]) - sum(h[::2]) for h in hit]
                    columns += [pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))]
                    names = ["n_words", "n_hit", "items", "spans"]
                else:
                    columns += [text, pa.array(n_words), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                    names = ["_llm_text", "n_words", "_llm_hit", "_llm_items"]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: len(ids)], *names])

        out = ["n_words long", "n_hit long", "items array<string>", "spans array<int>"] if last else ["_llm_text string", "n_words long", "_llm_hit array<int>", "_llm_items array<string>"]
        picked = picked.mapInArrow(step, ", ".join([*head, *out]))
    return picked


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    return (F.col(n_hit) > 0) & (F.col(n_hit) * COVERAGE >= F.col(n_words))


def remove(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit spans of contaminated texts taken out; all columns are kept.

    A span gives way to a line break.  Texts below the coverage limit stay as they are; a
    text with no word left is dropped with its row, unless it had none before.
    """
    reserved = [c for c in docs.columns if c != text_col]
    carried = docs.select(F.struct(*reserved).alias("_llm_row") if reserved else F.lit(True).alias("_llm_row"), F.col(text_col).alias("_llm_kept"))
    scanned = scan(carried, ["_llm_row", "_llm_kept"], "_llm_kept", benchmark, item_col, item_text_col, window)
    raw = F.col("_llm_kept").cast("binary")
    # the pieces between the spans: 0, start, end, start, end, ..., length
    edges = F.concat(F.array(F.lit(0)), F.col("spans"), F.array(F.octet_length("_llm_kept")))
    piece = lambda i: F.substring(raw, F.get(edges, 2 * i) + 1, F.get(edges, 2 * i + 1) - F.get(edges, 2 * i)).cast("string")
    cut = F.array_join(F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int")), piece), "\n")
    dirty = contaminated()
    kept = scanned.where(~dirty | (F.col("n_hit") < F.col("n_words")))
    text = F.when(dirty, cut).otherwise(F.col("_llm_kept"))
    return kept.select(*(text.alias(c) if c == text_col else F.col(f"_llm_row.`{c}`").alias(c) for c in docs.columns))
