"""Line deduplication by pairwise patience alignment.

A *block* is a run of lines that follow each other both in a document and in one earlier
document, of at least ``min_words`` words; it is deleted from the later.

Single lines are often common, so rare hashes are made of runs of lines: the shortest runs of
``min_words`` words that start, or end, with each line (*windows*).  Every line of a block
lies in one that both documents have.  Two documents overlap if they share a window, and a
document is paired with the earliest holder of each window it shares, so a passage of
thousands of documents makes one pair for each of them, and no block is missed: all windows
of a block are shared with some earlier document, whichever it is.

Each pair is aligned by a patience diff over the windows they share: windows that both have
once are anchors, the longest chain that rises in both is kept, and stretches between are
aligned again; a stretch without such windows takes its rarest one as anchor.  An aligned
window is a block common to both.  Passages that lie in another order, or are repeated, cross
the chain: what a pair shares and has not aligned is aligned again, until nothing is left.

Earlier means smaller id (null first), then smaller hash of the text.  Rows with the same
id and text are one document.  Blank lines are no lines; white space around a line does
not count.  Lines and windows are compared by 128 bits of hash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, small_batches
from .kernels import SPACED, U64, chunks, mix, powers, span_hashes, word_spans

#: Words that a block must have to be deleted.
MIN_WORDS = 50

_NEWLINE = np.ones(256, dtype=bool)
_NEWLINE[10] = False
_OTHER = np.random.default_rng(23).permutation(256).astype(np.uint8)  # a second reading of the bytes, for the second hash


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, number in the row, two hashes and number of words of each line that is not blank."""
    starts, ends, rows = word_spans(data, offs, SPACED)  # words
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), none.astype(U64), none
    breaks = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~_NEWLINE[data], out=breaks[1:])
    line = breaks[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    a, b, row = starts[head], ends[head + count - 1], rows[head]
    number = np.arange(len(head)) - np.searchsorted(row, row)
    return row, number, span_hashes(data, a, b), mix(span_hashes(_OTHER[data], a, b) + U64(1)), count


def windows(row: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end of the windows that no line can leave at one side and keep ``least`` words.

    For each line the shortest that starts with it and the shortest that ends with it, as far
    as its row has them.
    """
    total = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(words, out=total[1:])
    at = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + least)
    fits = end <= np.searchsorted(row, row, "right")
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    back = start >= np.searchsorted(row, row)
    found = np.unique(np.stack([np.append(at[fits], start[back]), np.append(end[fits], at[back] + 1)]), axis=1)
    return found[0], found[1]


def _window_hashes(line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lines of each window in order."""
    up, down = powers(len(line) + 1)
    total = np.zeros(len(line) + 1, dtype=U64)
    np.cumsum(mix(line) * up[:-1], out=total[1:])
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))


def _window_rows(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct window of a text: id, h, two hashes, its first lines, its lines; columns id, h, text."""
    for batch in batches:
        for lo, _, data, offs in chunks(batch.column(2)):
            row, number, one, two, words = lines(data, offs)
            a, b = windows(row, words, least)
            if not len(a):
                continue
            one, two = _window_hashes(one, a, b), _window_hashes(two, a, b)
            order = np.lexsort((a, two, one, row[a]))
            a, size, k1, k2 = a[order], (b - a)[order], one[order], two[order]
            r = row[a]
            new = np.ones(len(r), dtype=bool)
            new[1:] = (r[1:] != r[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            head = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(pa.array(np.append(head, len(r)), pa.int32()), pa.array(number[a], pa.int32()))
            at = pa.array(lo + r[head], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(k1[head].view(np.int64)), pa.array(k2[head].view(np.int64)), places, pa.array(size[head], pa.int32())],
                names=["id", "h", "one", "two", "places", "size"],
            )


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in both places; pairs are sorted by the first."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [y]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(mine: list[list[int]], theirs: list[list[int]]) -> list[tuple[int, int]]:
    """Patience diff of two documents over the lines they share.

    ``mine[k]`` and ``theirs[k]`` are the places of shared line (or run of lines) ``k`` in
    either; the result is the aligned places, rising in both.  It is empty only if nothing
    is shared.
    """
    own = {p: k for k, places in enumerate(mine) for p in places}
    other = {p: k for k, places in enumerate(theirs) for p in places}
    if not own or not other:
        return []
    matched: list[tuple[int, int]] = []
    work = [(min(own), max(own) + 1, min(other), max(other) + 1, list(range(len(mine))))]
    while work:
        a, b, c, d, shared = work.pop()
        # grow from the ends of the stretch, which follow matches or are the ends of what is shared
        while a < b and c < d and a in own and own[a] == other.get(c, -1):
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and b - 1 in own and own[b - 1] == other.get(d - 1, -1):
            matched.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a >= b or c >= d:
            continue
        inside = [([p for p in mine[k] if a <= p < b], [p for p in theirs[k] if c <= p < d], k) for k in shared]
        inside = [x for x in inside if x[0] and x[1]]
        if not inside:
            continue
        anchors = chain(sorted((x[0][0], x[1][0]) for x in inside if len(x[0]) == 1 and len(x[1]) == 1))
        if not anchors:
            rarest = min(inside, key=lambda x: (len(x[0]) * len(x[1]), x[0][0]))
            anchors = [(rarest[0][0], rarest[1][0])]
        matched += anchors
        kept = [k for _, _, k in inside]
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        for (p, q), (r, s) in zip(edges, edges[1:], strict=False):
            if r - p > 1 and s - q > 1:
                near = [k for k in kept if any(p < x < r for x in mine[k])]
                if near:
                    work.append((p + 1, r, q + 1, s, near))
    return sorted(matched)


def pair_blocks(shared: list[dict]) -> list[tuple[int, int]]:
    """First and last line, in the later document, of the blocks that alignment finds in a pair.

    ``shared`` has the windows of both: places in the later (``places``) and in the earlier
    document (``theirs``), and how many lines they span.
    """
    step = max(s["size"] for s in shared) + 1  # windows of one first line are told apart by their size
    mine = [[p * step + s["size"] for p in s["places"]] for s in shared]
    theirs = [[p * step + s["size"] for p in s["theirs"]] for s in shared]
    out: list[tuple[int, int]] = []
    while any(mine):
        found = {p for p, _ in align(mine, theirs)}
        out += [(p // step, p // step + p % step - 1) for p in found]
        mine = [[p for p in places if p not in found] for places in mine]
    return out


def blocks(shared: list[dict]) -> list[int]:
    """First and last line of each run of lines to delete, in turn, from a document, pair by pair."""
    pairs: dict[tuple, list[dict]] = {}
    for s in shared:
        pairs.setdefault((s["by_id"], s["by_h"]), []).append(s)
    out: list[int] = []
    for first, last in sorted(x for pair in pairs.values() for x in pair_blocks(pair)):
        if out and first <= out[-1] + 1:
            out[-1] = max(out[-1], last)
        else:
            out += [first, last]
    return out


def _cut(text: str, runs: list[int]) -> str:
    rows = text.split("\n")
    full = [i for i, line in enumerate(rows) if line.strip(" \t\r\v\f")]
    drop = np.zeros(len(rows), dtype=bool)
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        drop[full[a] : full[b] + 1] = True
    return "\n".join(line for line, gone in zip(rows, drop, strict=True) if not gone)


def deduplicate(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with shared blocks deleted from later documents, and ``_llm_runs``, the deleted lines.

    ``_llm_runs`` lists first and last deleted line in turn, lines that are not blank counted
    from 0; null where nothing was deleted.  No row is dropped: a text that is all shared
    becomes empty, a null text stays null.  Columns may have any names but ``_llm_...``.
    """
    text = F.col(text_col).cast("string")
    keyed = small_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).where(F.col("text") != "")
    id_type = dict(keyed.dtypes)["id"]
    found = cut(keyed.mapInArrow(partial(_window_rows, max(min_words, 1)), f"id {id_type}, h long, one long, two long, places array<int>, size int"), "windows")
    first = found.groupBy("one", "two").agg(F.min(F.struct("id", "h", "places")).alias("by"), F.max(F.struct("id", "h")).alias("last"))
    # windows of several documents, with their earliest: the pairs
    several = first.where((F.col("by.h") != F.col("last.h")) | ~F.col("by.id").eqNullSafe(F.col("last.id")))
    several = several.select("one", "two", F.col("by.id").alias("by_id"), F.col("by.h").alias("by_h"), F.col("by.places").alias("theirs"))
    later = found.join(several, ["one", "two"]).where((F.col("h") != F.col("by_h")) | ~F.col("id").eqNullSafe(F.col("by_id")))
    pair = F.struct("by_id", "by_h", "places", "theirs", "size")
    shared = later.dropDuplicates(["one", "two", "id", "h"]).groupBy("id", "h").agg(F.collect_list(pair).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [blocks(s) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.list_(pa.int32()))], names=["id", "h", "runs"])

    runs = shared.mapInArrow(run, f"_llm_id {id_type}, _llm_h long, _llm_runs array<int>").where(F.size("_llm_runs") > 0)
    joined = docs.withColumn("_llm_own", F.xxhash64(text)).join(runs, F.col(id_col).eqNullSafe(F.col("_llm_id")) & (F.col("_llm_own") == F.col("_llm_h")), "left")

    @F.pandas_udf("string")
    def without(texts, cuts):
        return texts.combine(cuts, lambda t, c: t if t is None or c is None else _cut(t, list(c)))

    cleaned = F.when(F.col("_llm_runs").isNotNull(), without(text, F.col("_llm_runs"))).otherwise(text)
    return joined.select(*(cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns), "_llm_runs")
