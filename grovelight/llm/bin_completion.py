"""Best-fit packing of token sequences by bin completion.

Documents are tokenized, ended by id 0, and cut into pieces of at most ``capacity``
tokens.  Pieces of one length are alike, so the packing problem is the number of pieces
of each length: a table of at most ``capacity`` rows, whatever the corpus.  On it the
driver runs bin completion.  The first incumbent is the best-fit solution: around the
largest piece left the fullest filling there is, used as often as its pieces allow at once,
so the number of steps does not grow with the corpus.  If it is above the lower bound, its
emptiest sequence is emptied: with some others, loose and full ones, it makes a residual,
which is searched depth-first for a packing in which those others are fuller than before
and the emptiest keeps less.  Around the largest piece left all undominated fillings are
tried, the fullest first, as long as the waste is less than it was.  Few sequences are
searched as a whole, until nothing better is left.

What comes out is a list of patterns.  Spark numbers the pieces of each length and a
lookup in that list gives every piece its sequence and offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, small_batches
from .kernels import chunks
from .pretokens import encoder

CAPACITY = 2048
END = 0
#: Nodes of the search: fillings tried, also dominated ones.
NODES = 40_000
#: Nodes of one residual, and the most sequences in one.
SHARE = 300
RESIDUAL = 32
#: Pieces of one length that are numbered in one group.
GROUP_ROWS = 50_000

Pattern = tuple[tuple[int, ...], int]


def pieces(docs: DataFrame, id_cols: list[str], text_col: str, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id columns, piece, start, length, ids_crc32[, ids]) of every document.

    Null and empty texts are the end id alone.  Only the first piece may be shorter than
    ``capacity`` when a document is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(batch.num_columns - 1), 1 << 20):
                ids, rows = encode.chunk(data, offs)
                owner, number, start, length, crc, kept = [], [], [], [], [], []
                for row in range(hi - lo):
                    own = np.append(ids[rows[row] : rows[row + 1]], np.uint32(END)).astype("<u4")
                    ends = [*range(len(own) % capacity or capacity, len(own), capacity), len(own)]
                    for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                        owner.append(lo + row)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].tobytes()))
                        if with_ids:
                            kept.append(own[a:b].astype(np.int32))
                columns = [c.take(pa.array(owner, pa.int64())) for c in batch.columns[:-1]]
                columns += [pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                columns += [pa.array(kept, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *names])

    names = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    picked = small_batches(docs).select(*id_cols, F.col(text_col).cast("string").alias("_llm_text"))
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return picked.mapInArrow(run, ", ".join([*head, "piece int", "start long", "length long", "ids_crc32 long", *(["ids array<int>"] if with_ids else [])]))


def fillings(left: np.ndarray, room: int, most: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated ways to fill ``room`` with at most ``most`` of waste, least waste first; None for a dominated one.

    A filling is dominated if another piece still fits, or if one of its pieces can be
    changed for a larger one that is left and fits.
    """
    sizes = np.flatnonzero(left[: room + 1])[::-1].tolist()
    have = [int(left[s]) for s in sizes]
    full = (1 << (room + 1)) - 1
    reach = [1] * (len(sizes) + 1)  # bit r of reach[i]: sizes from the i-th on have a sum of r
    for i in range(len(sizes) - 1, -1, -1):
        bits, copies, step = reach[i + 1], min(have[i], room // sizes[i]), 1
        while copies:
            step = min(step, copies)
            bits |= bits << (step * sizes[i])
            copies -= step
            step *= 2
        reach[i] = bits & full

    def sums(at: int, rest: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
            return
        for i in range(bisect_left(sizes, -rest, at, key=int.__neg__), len(sizes)):
            if not reach[i] >> rest & 1:
                return
            for n in range(min(have[i], rest // sizes[i]), 0, -1):
                if reach[i + 1] >> (rest - n * sizes[i]) & 1:
                    for more in sums(i + 1, rest - n * sizes[i]):
                        yield (sizes[i],) * n + more

    for waste in range(min(room, most) + 1):
        if reach[0] >> (room - waste) & 1:
            for filling in sums(0, room - waste):
                unused = [s for s, n in zip(sizes, have, strict=True) if filling.count(s) < n] if waste else []
                spare = any(y <= waste or any(x < y <= x + waste for x in set(filling)) for y in unused)
                yield None if spare else filling


def _times(left: np.ndarray, pattern: tuple[int, ...]) -> int:
    sizes, need = np.unique(np.array(pattern), return_counts=True)
    return int((left[sizes] // need).min())


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """The greedy solution: around each largest piece the fullest of its fillings."""
    left, out = left.copy(), []
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        pattern = (top, *next(f for f in fillings(left, capacity - top, capacity) if f is not None))
        left[top] += 1
        n = _times(left, pattern)
        for s in pattern:
            left[s] -= n
        out.append((pattern, n))
    return out


def _bound(left: np.ndarray) -> int:
    """Sequences needed for the sum of all pieces, and for those of more than half a sequence."""
    capacity = len(left) - 1
    return max(-(-int((left * np.arange(capacity + 1)).sum()) // capacity), int(left[capacity // 2 + 1 :].sum()))


def search(left: np.ndarray, goal: int, slack: int, nodes: int) -> tuple[list[tuple[int, ...]] | None, int]:
    """At most ``goal`` sequences that waste at most ``slack``, and one of what is left then; or None.

    Also the nodes not used: some, if all was searched in vain.
    """
    capacity = len(left) - 1
    half = capacity // 2 + 1

    def opened(left: np.ndarray, slack: int) -> tuple[int, np.ndarray, int, Iterator[tuple[int, ...] | None]]:
        top = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[top] -= 1
        return top, rest, slack, fillings(rest, capacity - top, slack)

    path: list[tuple[int, ...]] = []
    stack = [opened(left, slack)] if slack >= 0 and goal > 0 else []
    while stack and nodes > 0:
        top, rest, slack, options = stack[-1]
        try:
            filling = next(options)
        except StopIteration:
            stack.pop()
            path = path[:-1]
            continue
        nodes -= 1
        if filling is None:
            continue
        after = rest.copy()
        for s in filling:
            after[s] -= 1
        done = [*path, (top, *filling)]
        if len(done) == goal or not after.any():
            over = tuple(np.repeat(np.arange(capacity + 1), after)[::-1].tolist())
            if sum(over) <= capacity:
                return [*done, over] if over else done, nodes
        elif int(after[half:].sum()) <= goal - len(done) + 1:
            path = done
            stack.append(opened(after, slack - (capacity - top - sum(filling))))
    return None, nodes


def pack(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns (lengths, largest first, and how many sequences are filled so) for all pieces.

    Stops at the lower bound ``ceil(total / capacity)`` or a sharper one from pieces of
    more than half a sequence, when all of the search shows that there is nothing better, or
    after ``nodes`` nodes with the best solution so far.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] += n
    return improve(best_fit(left, capacity), left, nodes)


def improve(best: list[Pattern], left: np.ndarray, nodes: int) -> list[Pattern]:
    """``best``, a packing of ``left``, with its emptiest sequences emptied into others."""
    capacity = len(left) - 1
    bound, total = _bound(left), int((left * np.arange(capacity + 1)).sum())
    packed: Counter[tuple[int, ...]] = Counter()
    for pattern, n in best:
        packed[pattern] += n
    rng, size = np.random.default_rng(7), 2
    while (least := packed.total()) > bound and nodes > 0:
        if least <= RESIDUAL:  # all at once
            found, nodes = search(left, least - 1, (least - 1) * capacity - total, nodes)
            if found is None:
                break
            packed = Counter(found)
            continue
        last = min(packed, key=lambda p: (p[0] > capacity // 2, sum(p), p))
        others = [p for p in packed if p != last]
        loose = [p for p in others if sum(p) < capacity]
        some = [loose[k] for k in rng.permutation(len(loose))[: 1 + size // 2]]
        residual = list(dict.fromkeys([*some, *(others[k] for k in rng.permutation(len(others))[:size])]))[:size]
        taken = np.bincount([s for p in [*residual, last] for s in p], minlength=capacity + 1)
        waste = sum(capacity - sum(p) for p in residual)
        share = min(SHARE, nodes)
        found, unused = search(taken, len(residual), waste - 1, share)
        nodes -= max(share - unused, 1)
        if found is None:
            size = size * 2 if size < RESIDUAL else 2
            continue
        packed.subtract([*residual, last])
        packed.update(found)
        packed = +packed
    return sorted(packed.items(), reverse=True)


def placements(patterns: list[Pattern], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces go: keys (length and first number among its pieces), sequence and offset of that piece."""
    rank = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for s in pattern:
            rows.append((s << 40 | int(rank[s]), sequence, offset))
            rank[s] += n
            offset += s
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def assign(cut_pieces: DataFrame, key_cols: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table of pieces.

    Pieces of one length are numbered in groups dealt by a hash of their keys, about
    ``GROUP_ROWS`` rows each, with the counts of earlier groups added; so no length, however
    common, is numbered in one task.
    """
    rows = cut_pieces.groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in rows}
    keys, sequences, offsets = placements(pack(counts, capacity), capacity)
    groups = 8 + sum(counts.values()) // GROUP_ROWS
    dealt = cut_pieces.withColumn("_llm_group", F.pmod(F.xxhash64(*key_cols), F.lit(groups)))
    sizes = dealt.groupBy("length", "_llm_group").count()
    earlier = Window.partitionBy("length").orderBy("_llm_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_llm_group", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_llm_start"))
    within = Window.partitionBy("length", "_llm_group").orderBy(*key_cols)
    numbered = dealt.withColumn("_llm_rank", F.row_number().over(within) - 1).join(starts, ["length", "_llm_group"])
    numbered = numbered.withColumn("_llm_key", F.col("length") * F.lit(1 << 40) + F.col("_llm_rank") + F.col("_llm_start")).select(*cut_pieces.columns, "_llm_key")
    shared = cut_pieces.sparkSession.sparkContext.broadcast((keys, sequences, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_key, at_sequence, at_offset = shared.value
        for batch in batches:
            own = batch.column(batch.num_columns - 1).to_numpy()
            k = np.searchsorted(at_key, own, "right") - 1
            found = [pa.array(at_sequence[k] + (own - at_key[k])), pa.array(at_offset[k])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)
    return numbered.mapInArrow(place, f"{head}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Repeated rows and null ids are documents of their own.  An empty table packs to none.
    """
    stored = cut(pieces(docs.select(F.col(id_col).alias("_llm_id"), F.col(text_col).alias("_llm_t")), ["_llm_id"], "_llm_t", path, capacity), "pieces")
    return assign(stored, ["_llm_id", "piece"], capacity).withColumnRenamed("_llm_id", id_col)
